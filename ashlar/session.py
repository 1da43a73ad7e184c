"""Session factory.

Settings chosen for correctness (UTC, ANSI) and for adaptive plans; sizes that depend on the cluster are left to the
caller or to Spark's defaults.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "ashlar", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC time zone, AQE and Arrow on; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
