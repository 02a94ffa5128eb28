"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and two joins; links live in the shared folder
between rounds and never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``links`` that is not its own root.

    The root is the smallest node of the component.  Repeated links, loops and
    both directions of a link are fine; links with a null end are none.
    """
    a, b = F.col(left), F.col(right)
    now = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = _settle(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: every greater neighbour goes to the least of the neighbourhood.
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: so does every lesser one, and the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        then, after = _settle(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(now)
        now, before, mark = then, mark, after
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settle(links: DataFrame):
    kept = materialise(links, "links")
    return kept, tuple(kept.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
