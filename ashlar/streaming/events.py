"""Structured Streaming over event tables: windows with watermarks, sessions, and a stateful running total."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums per tumbling or sliding window; late rows beyond the watermark are dropped in streams."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = t.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = t.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """Per key and micro-batch the total so far, kept in state."""

    def step(k, parts: Iterator[pd.DataFrame], state):
        total, n = state.get if state.exists else (0.0, 0)
        for p in parts:
            total, n = total + float(p[value].sum()), n + len(p)
        state.update((total, n))
        yield pd.DataFrame({key: [k[0]], "total": [total], "n": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, total double, n long", "total double, n long", "update", "NoTimeout")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there, into memory: for tests and small tables."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
