"""Order over a whole table without a single-task sort.

Keys are dealt to ranges by Spark's own range partitioner; each range is sorted
on its own and only the first key of every range meets the others.  Ranges hold
keys alone, never rows, and there are as many as the keys need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions

#: Keys per range that is aimed at.
KEYS_PER_RANGE = 1_000_000


def successors(keys: DataFrame, key: str, per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """(key, next) for the distinct non-null values of ``key``, a number: the next larger one; the largest has the least.

    A table of the shared folder; an empty one for no keys.
    """
    spark = keys.sparkSession
    ids = materialise(keys.select(F.col(key).alias("key")).where("key is not null").distinct(), "keys")
    parts = max(shuffle_partitions(spark), -(-ids.count() // per_range))
    ranged = materialise(ids.repartitionByRange(parts, "key").withColumn("rg", F.spark_partition_id()), "ranged")
    # One row per range.
    firsts = ranged.groupBy("rg").agg(F.min("key").alias("first"))
    order = Window.orderBy("rg")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = firsts.select("rg", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("edge"))
    inside = Window.partitionBy("rg").orderBy("key")
    rows = ranged.withColumn("next", F.lead("key").over(inside)).join(edges, "rg")
    out = materialise(rows.select("key", F.coalesce("next", "edge").alias("next")), "successors")
    discard(ids, ranged)
    return out
