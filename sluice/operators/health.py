"""Source health: scan transitions folded over ordered scan events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import health_priority

#: Consecutive failures that switch a source off.
DISABLE_AFTER = 10


def failure_streaks(events: DataFrame) -> DataFrame:
    """Each event (source_id, ts, seq, ok) with the failures in a row up to and with it."""
    order = Window.partitionBy("source_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("_run", F.sum(F.col("ok").cast("int")).over(order))
    within = Window.partitionBy("source_id", "_run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(within)).drop("_run")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per source: what its scan events leave behind.

    All of it is aggregates that combine on the map side: the streak counts the
    failures after the last success, so no history is sorted in one task.  A run
    of failures that a success of the same batch ends leaves nothing behind: a
    source that was switched off is not scanned, so only a late batch can hold one.
    """
    at = F.struct("ts", "seq")
    last_ok = events.where("ok").groupBy("source_id").agg(F.max(at).alias("ok_at"))
    rows = events.join(last_ok, "source_id", "left")
    later = ~F.col("ok") & (F.col("ok_at").isNull() | (at > F.col("ok_at")))
    newest = lambda c: F.max(F.struct("ts", "seq", F.col(c).alias("x")))["x"]
    return rows.groupBy("source_id").agg(
        F.max("ts").alias("last_scanned_at"), F.max("ok_at")["ts"].alias("last_successful_scan_at"),
        F.max(F.when(F.col("ok") & (F.col("opportunities_found") > 0), F.col("ts"))).alias("last_opportunity_found_at"),
        F.count_if(later).cast("int").alias("new_failures"), F.count_if("ok").cast("int").alias("successes"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("opportunities_found"))), F.lit(0)).cast("int").alias("new_found"),
        F.round(newest("duration_seconds"), 3).alias("last_scan_duration_seconds"),
        F.when(F.max(F.struct("ts", "seq", "ok"))["ok"], F.lit(200)).otherwise(newest("http_status")).cast("int").alias("last_http_status"),
        F.max(F.when(later, F.struct("ts", "seq", F.col("error_message").alias("x"))))["x"].alias("last_error"),
    )


def apply_scans(sources: DataFrame, events: DataFrame) -> DataFrame:
    """``sources`` (id) after their scan events.

    A success clears failures and the automatic switch-off; DISABLE_AFTER
    failures in a row switch a source off with the last error as the reason.
    """
    f = fold_events(events).withColumnRenamed("source_id", "_sid")
    rows = sources.join(f, sources.id == F.col("_sid"), "left")
    met, ok = F.col("_sid").isNotNull(), F.coalesce(F.col("successes"), F.lit(0)) > 0
    fails = F.when(ok, F.col("new_failures")).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + F.col("new_failures"))
    rows = rows.withColumn("_fails", F.when(met, fails).otherwise(F.col("consecutive_failures")).cast("int"))
    off = met & (F.col("new_failures") > 0) & (F.col("_fails") >= DISABLE_AFTER)
    text = F.concat(F.lit("Automatically disabled after "), F.col("_fails").cast("string"), F.lit(" consecutive scan failures. Latest error: "),
                    F.substring(F.coalesce("last_error", F.lit("")), 1, 300))
    new = {
        "consecutive_failures": F.col("_fails"),
        "is_active": F.when(off, False).otherwise(F.col("is_active")),
        "is_auto_disabled": F.when(off, True).when(met & ok, False).otherwise(F.col("is_auto_disabled")),
        "disabled_reason": F.when(off, text).when(met & ok, F.lit(None)).otherwise(F.col("disabled_reason")),
        "total_opportunities_found": F.coalesce("total_opportunities_found", F.lit(0)) + F.coalesce("new_found", F.lit(0)),
        **{c: F.coalesce(f[c], sources[c]) for c in ("last_scanned_at", "last_successful_scan_at", "last_opportunity_found_at", "last_scan_duration_seconds")},
        "last_http_status": F.when(met, f["last_http_status"]).otherwise(sources["last_http_status"]),
    }
    out = rows.select(*[(new[c] if c in new else sources[c]).alias(c) for c in sources.columns], met.alias("_met"))
    return out.withColumn("priority_score", F.when(F.col("_met"), priority()).otherwise(F.col("priority_score"))).drop("_met")


def priority() -> Column:
    return health_priority(F.col("confidence_score"), F.col("url_relevance_score"), F.col("total_opportunities_found"), F.col("consecutive_failures"),
                           F.col("last_successful_scan_at").isNotNull(), F.coalesce("is_auto_disabled", F.lit(False)))


def refresh_priorities(sources: DataFrame) -> DataFrame:
    return sources.withColumn("priority_score", priority())
