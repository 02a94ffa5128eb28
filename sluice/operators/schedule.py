"""Job state and due checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import job_due


def due_jobs(state: DataFrame, now: Column, intervals: dict[str, int], retry_hours: int = 6) -> DataFrame:
    """Jobs that are due, of those with an interval (hours); jobs without state are."""
    jobs = state.sparkSession.createDataFrame(list(intervals.items()), "job_name string, interval_hours int")
    rows = jobs.join(state.select("job_name", "last_success", "last_failure"), "job_name", "left")
    out = F.lit(False)
    for name, hours in intervals.items():
        out = F.when(F.col("job_name") == name, job_due("last_success", "last_failure", hours, now, retry_hours)).otherwise(out)
    return rows.where(out)


def record_run(state: DataFrame, job: str, now: Column, ok: bool | None, seconds: float | None = None, error: str | None = None) -> DataFrame:
    """State after a job started (ok None), completed or failed; one row a job."""
    run = state.sparkSession.range(1).select(F.lit(job).alias("job_name"))
    rows = state.join(run.withColumn("_hit", F.lit(True)), "job_name", "full_outer")
    hit = F.col("_hit").isNotNull()
    new = {"status": F.lit({None: "running", True: "completed", False: "failed"}[ok])}
    if ok is None:
        new["last_started"] = now
    else:
        new["last_success" if ok else "last_failure"] = now
        new["duration_seconds"] = F.round(F.lit(seconds).cast("double"), 3)
        new["last_error"] = F.lit(None).cast("string") if ok else F.substring(F.lit(error or ""), 1, 1000)
    return rows.select(*[(F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in state.columns])
