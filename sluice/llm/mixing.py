"""Mixing sources to target weights by systematic sampling.

Each source gets a target share of all words; a document's expected copies are
its source's target over its source's size.  Expected copies are prefix-summed
within the source in order of document size, one random offset per source is
added, and a document is emitted once per integer boundary that its stretch of
the sum crosses.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, discard, materialise

#: A document is taken at most this often, a source at most this many times over.
MOST_COPIES = 3
#: Pieces that each size class of a source is cut into, so that no task gets a hot source whole.
SALTS_HEX = 2
#: Random offsets that a source may choose from by default.  With one, a source of some
#: thirty documents can miss its target by a tenth and more; see the README.
DRAWS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: source_size and target, from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn.  Targets
    share the total of all sizes by weight but stop at MOST_COPIES times the
    source's size; the excess is shared again by weight until none is above.
    The windows here see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("long")).withColumn("most", F.col("source_size") * MOST_COPIES)
    # Sources by cap over weight: those before the first that fits its share are capped.
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    per = per.withColumn("water", F.max(fits).over(whole))  # the first that fits: later levels only fall
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("most").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def offset(source: Column, draw: int = 0, seed: int = 7) -> Column:
    """A number in [0, 1) per source and draw, the same in every run."""
    name = F.concat(F.lit(f"{seed}/{draw}/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))).cast("decimal(20,15)")


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, draws: int = DRAWS) -> DataFrame:
    """doc_id, source, digest (of the text), size, source_size, target and copies of every row; no texts.

    Of ``draws`` random offsets a source uses the one whose words come nearest
    its target (ties: the first), so small sources with a few long documents
    stay near it too; with 1 it is plain systematic sampling.  Null and empty
    texts, null sources, repeated rows and empty tables are as in ``mix``.
    """
    # Texts are read and counted once.
    rows = materialise(docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), count_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(rows.select("source", "size"), weights)
    # Sizes in binary: length and leading bits make ordered classes.
    bits = F.bin(F.col("size"))
    rows = rows.withColumns({
        "_len": F.length(bits), "_top": F.substring(bits, 1, 4),
        "_salt": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, SALTS_HEX),
    })
    # One row per source: small beside the documents, but not bounded, so no broadcast hint.
    rated = rows.join(targets.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    rated = rated.withColumn("_x", rate.cast("decimal(20,15)"))
    totals = rated.groupBy("source", "_len", "_top", "_salt").agg(F.sum("_x").cast("decimal(38,15)").alias("_sum"))
    # Rows here: size classes times salts of a source, a few thousand at most.
    run = Window.partitionBy("source").orderBy("_len", "_top", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("source").alias("_s"), F.col("_len").alias("_l"), F.col("_top").alias("_t"), F.col("_salt").alias("_h"),
        F.coalesce(F.sum("_sum").over(run), F.lit(0)).cast("decimal(38,15)").alias("_base"),
    )
    inner = Window.partitionBy("source", "_len", "_top", "_salt").orderBy("size", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = rated.withColumn("_in", F.sum("_x").over(inner).cast("decimal(38,15)")).join(
        bases,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_len") == F.col("_l")) & (F.col("_top") == F.col("_t")) & (F.col("_salt") == F.col("_h")),
    )
    placed = materialise(
        placed.select("doc_id", "source", "digest", "size", "source_size", "target", "_x", (F.col("_base") + F.col("_in")).cast("decimal(38,15)").alias("_end")), "placed"
    )
    crossed = lambda u: (F.floor(F.col("_end") + u) - F.floor(F.col("_end") - F.col("_x") + u)).cast("long")
    discard(rows)
    drawn = placed.groupBy("source").agg(
        F.first("target").alias("t"), *[F.sum(crossed(offset(F.col("source"), d, seed)) * F.col("size")).alias(f"w{d}") for d in range(draws)]
    )
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{d}") - F.col("t")).alias("off"), F.lit(d).alias("d"), offset(F.col("source"), d, seed).alias("u")) for d in range(draws)]))
    chosen = drawn.select(F.col("source").alias("_s"), nearest["u"].alias("_u"))
    out = placed.join(chosen, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", crossed(F.col("_u")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, draws: int = DRAWS) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies.

    A null text has size 0 and a null source is a source of its own, last in
    order.  Documents of size 0 are never taken.  Repeated rows are documents
    of their own.  Texts may be of any length.  Columns of the four names are
    replaced.

    Texts are shuffled once, to meet their row of ``shares`` by id.  Rows that
    share an id are told apart by source, size and digest, and alike ones by number.
    """
    made = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in made]
    ident = F.coalesce(F.col("doc_id").cast("long"), F.col("digest"))
    by_id = Window.partitionBy("_id")
    number = lambda df: df.withColumn("_nth", F.row_number().over(by_id.orderBy("doc_id", "source", "size", "digest")))
    took = number(shares(docs, weights, seed, draws).withColumn("_id", ident)).withColumn("_n", F.count("*").over(by_id))
    took = materialise(took.select("_id", "_nth", "_n", F.struct("size", "source_size", "target", "copies").alias("_took")), "took")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    digest = F.xxhash64("text").alias("digest")
    alone = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), digest).alias("_id")).join(took.where("_n = 1"), "_id").select("_row.*", "_took.*")
    shared = took.where("_n > 1")
    if shared.isEmpty():
        return alone
    rows = docs.select(row, "doc_id", "source", digest, count_words(F.col("text")).alias("size")).withColumn("_id", ident)
    rows = rows.join(shared.select("_id").distinct(), "_id", "left_semi")
    return alone.unionByName(number(rows).join(shared, ["_id", "_nth"]).select("_row.*", "_took.*"))
