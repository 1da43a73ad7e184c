"""Collecting with a deadline, and an execution report."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame


def collect(df: DataFrame, timeout: float | None = None) -> list[dict]:
    if timeout is None:
        return [r.asDict(recursive=True) for r in df.collect()]
    sc, tag, late = df.sparkSession.sparkContext, f"ashlar-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"collect took more than {timeout} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def collect_with_report(df: DataFrame) -> tuple[list[dict], dict]:
    """(rows, report): wall seconds, rows, stages and tasks of the job, and the formatted plan."""
    sc, tag = df.sparkSession.sparkContext, f"ashlar-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    began = time.perf_counter()
    try:
        rows = [r.asDict(recursive=True) for r in df.collect()]
    finally:
        seconds = time.perf_counter() - began
        sc.removeJobTag(tag)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # what the job ran, as far as Spark still holds it: stages and their tasks, skipped stages included
    tracker = sc._jsc.sc().statusTracker()
    stages = {i for j in tracker.getJobIdsForTag(tag) for info in [tracker.getJobInfo(j)] if info.isDefined() for i in info.get().stageIds()}
    infos = [tracker.getStageInfo(i) for i in stages]
    tasks = sum(i.get().numTasks() for i in infos if i.isDefined())
    return rows, {"seconds": seconds, "rows": len(rows), "stages": len(stages), "tasks": tasks, "plan": plan}
