"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own (a temporary one in local mode only)."""
    if d := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return d.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        else:  # a cluster without the setting: the warehouse is shared too
            _LOCAL[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_ashlar"
    return _LOCAL[app]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM has gone at exit; nothing depends on this
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/ashlar-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ashlar_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    delete(df.sparkSession, df._ashlar_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose frames are gone (it otherwise waits for the driver's next collection).

    What the last query leaves is let go by a first collection and found by a second one, a moment later.
    """
    import gc

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)  # for Spark's cleaner
