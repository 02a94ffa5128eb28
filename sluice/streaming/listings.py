"""Streaming forms: listings into the opportunities' table, scan events into source health.

Each micro-batch folds into a keyed table and rewrites the buckets it touches.  The
table's manifest holds a mark for every stream, committed with the rows, so a batch that
is replayed after a failure changes nothing, whatever other streams did meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify
from ..operators.upsert import upsert_opportunities
from ..schemas import OPPORTUNITIES
from ..sources.snapshots import KeyedTable, overwrite
from . import health_state


def once_per_batch(root: str, stream: str, update: Callable[[DataFrame, DataFrame], DataFrame], batch_key: str | None = None):
    """A foreachBatch function that merges each batch of ``stream`` into the table at ``root`` once."""

    def merge(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            KeyedTable(batch.sparkSession, root).merge(kept, update, stream, number, batch_key)
        finally:
            kept.unpersist()

    return merge


def stream_listings(listings: DataFrame, root: str, checkpoint: str, clock: Callable[[], tuple[Column, Column]], rules: classify.Rules = classify.Rules(), buckets: int = 64):
    """Start the query that keeps the opportunities at ``root`` up to date; makes the table if there is none.

    ``clock`` gives (now, as_of) for a batch.
    """
    spark = listings.sparkSession
    if not (table := KeyedTable(spark, root)).exists():
        table.create(spark.createDataFrame([], OPPORTUNITIES), "source_url", buckets)
    accepted = classify.classify(listings, rules)

    def update(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert_opportunities(stored, batch, *clock()).drop("action", "changed")

    return accepted.writeStream.foreachBatch(once_per_batch(root, checkpoint, update)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_health(events: DataFrame, root: str, checkpoint: str, late: str = "1 day", retry_hours: int | None = None, due_root: str | None = None):
    """Start the query that applies scan events to the sources at ``root`` (a keyed table by id).

    Health is keyed state of the stream, which starts from the table.  With ``due_root`` the
    sources whose time has come are kept there: (source_id, due_at), a row a source.
    """
    spark = events.sparkSession
    spark.conf.set(*health_state.PROVIDER)
    if due_root and not (table := KeyedTable(spark, due_root)).exists():
        table.create(spark.createDataFrame([], "source_id long, due_at timestamp"), "source_id", 16)
    # What a stream that goes on has state of is not read from here again.  Timers cost every source a call, so only who asks what is due has them.
    rows = health_state.health_stream(events, KeyedTable(spark, root).read(), late, retry_hours, timers=due_root is not None)
    into = once_per_batch(root, checkpoint, health_state.apply_health, "source_id")
    due = once_per_batch(due_root, checkpoint, lambda stored, batch: overwrite(stored, batch, "source_id")) if due_root else None

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        into(kept.where("kind = 'health'"), number)
        if due:
            due(kept.where("kind = 'due'").groupBy("source_id").agg(F.timestamp_micros(F.max("at")).alias("due_at")), number)
        kept.unpersist()

    return rows.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_rates(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Scans and failures per source and window of event time."""
    return events.withWatermark("ts", late).groupBy("source_id", F.window("ts", size)).agg(
        F.count("*").alias("scans"), F.count_if(~F.col("ok")).alias("failures")
    )
