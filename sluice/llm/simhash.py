"""SimHash fingerprints.

Every term hash votes on 64 signed bits with its weight.  The weighted form is
all DataFrame expressions: votes are summed two bits to a long (32-bit fields),
so a document costs 33 sums and the shuffle carries 33 longs per document, never
a term.  Unweighted fingerprints of shingles are counted in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, fresh, materialise, release, small_batches, words
from .ordering import successors

_FIELD = 0x0000000100000001
#: Words of more characters are read as overlapping runs of PIECE characters: a text without
#: white space has terms of its own length, and an edit changes only those it touches.
LONG_WORD, PIECE = 24, 4


def vote(rows: DataFrame, keys: list[str], hash_col: str, weight_col: str | None = None) -> DataFrame:
    """Fingerprint (long) of each distinct ``keys`` from exploded term rows.

    ``hash_col``: long or null (no term).  A bit is 1 where the weights of the
    terms that have it exceed half of all; without terms the fingerprint is 0.
    Weights of a document must sum to less than 2**32.
    """
    weight = F.lit(1) if weight_col is None else F.col(weight_col)
    h = F.col(hash_col)
    spread = lambda i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_FIELD)) * weight
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(h.isNotNull(), weight.cast("long"))), F.lit(0)).alias("_w"),
        *[F.coalesce(F.sum(spread(i)), F.lit(0)).alias(f"_v{i}") for i in range(32)],
    )
    bit = lambda votes, i: F.when(votes * 2 > F.col("_w"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long"))
    low = [bit(F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)]
    high = [bit(F.shiftrightunsigned(F.col(f"_v{i}"), 32), i + 32) for i in range(32)]
    out = low[0]
    for b in low[1:] + high:
        out = out.bitwiseOR(b)
    return sums.select(*keys, out.cast("long").alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hex16(fp: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def units(word_col: Column) -> Column:
    """The words, long ones as their pieces."""

    def pieces(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - (PIECE - 1)), lambda i: F.substring(w, i, F.lit(PIECE)))

    long = lambda w: F.length(w) > LONG_WORD
    cut = F.flatten(F.transform(word_col, lambda w: F.when(long(w), pieces(w)).otherwise(F.array(w))))
    # Few texts have any: the others' words stay the array they are.
    return F.when(F.exists(word_col, long), cut).otherwise(word_col)


def weighted_terms(word_col: Column) -> Column:
    """Adjacent word pairs as (hash, weight): longer words say more, so they weigh more."""
    # The length must not overflow with the start: slice would give an empty array.
    following = F.slice(word_col, F.lit(2), F.greatest(F.size(word_col), F.lit(1)))
    return F.zip_with(
        word_col,
        following,
        lambda a, b: F.struct(
            F.xxhash64(a, b).alias("h"), (F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0))).cast("long").alias("w")
        ),
    )


def shingle_hashes(word_col: Column, size: int) -> Column:
    """XXH64 (seed 42) of every run of ``size`` words, space-joined, repeats included.

    Fewer words: the whole sequence; none: an empty array.
    """
    n = F.size(word_col)

    def joined(i):
        parts = [F.get(word_col, i)]
        for k in range(1, size):
            parts += [F.lit(" "), F.get(word_col, i + k)]
        return F.xxhash64(F.concat(*parts))

    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), joined)
    few = F.array(F.xxhash64(F.array_join(word_col, " ")))
    return F.when(n >= size, many).when(n > 0, few).otherwise(F.expr("cast(array() as array<bigint>)"))


def vote_arrays(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unweighted fingerprints (uint64) of the runs starts..ends of hashes: a bit is 1 if set in over half; of an empty run 0."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    at = 0
    while at < len(full):
        # As many runs as make about 100,000 hashes, one at least; a long run is summed in parts.
        lo = starts[full[at]]
        to = max(at + 1, int(np.searchsorted(ends[full], lo + 100_000, side="right")))
        own = full[at:to]
        if to == at + 1:
            votes = np.zeros((1, 64), np.int64)
            for s in range(int(lo), int(ends[own[0]]), 100_000):
                part = np.ascontiguousarray(flat[s : min(s + 100_000, int(ends[own[0]]))]).view(np.uint8).reshape(-1, 8)
                votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            part = np.ascontiguousarray(flat[lo : ends[own[-1]]]).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(np.unpackbits(part, axis=1, bitorder="little"), (starts[own] - lo).astype(np.int64), axis=0, dtype=np.int32)
        won = votes * 2 > (ends[own] - starts[own])[:, None]
        out[own] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()
        at = to
    return out


def shingle_fingerprints(docs: DataFrame, carry: list[str], shingle: int = 3, text_col: str = "text") -> DataFrame:
    """Each row's ``carry`` columns and its unweighted shingle fingerprint ``fp``.

    Repeated rows stay apart; a null text counts as empty.  Hashes are made in
    the JVM and their votes counted in Arrow batches: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    ws, sh = fresh(docs, "ws", "sh")
    split = docs.select(*carry, words(ascii_lower(F.col(text_col))).alias(ws))
    hashed = split.select(*carry, shingle_hashes(F.col(ws), shingle).alias(sh))

    def count(batches):
        for b in batches:
            got = b.column(len(carry))
            ends = got.offsets.to_numpy().astype(np.int64) - got.offsets[0].as_py()
            fp = vote_arrays(got.flatten().to_numpy().view(np.uint64), ends[:-1], ends[1:])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*carry, "fp"])
        release()

    fields = [T.StructField(f.name, f.dataType) for f in split.schema if f.name != ws]
    return hashed.mapInArrow(count, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def text_fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Weighted fingerprint per row; ``keys`` must tell rows apart."""
    ws, t = fresh(rows, "ws", "t")
    split = rows.select(*keys, words(F.col(text_col)).alias(ws)).select(*keys, units(F.col(ws)).alias(ws))
    terms = split.select(*keys, F.explode_outer(weighted_terms(F.col(ws))).alias(t))
    terms = terms.select(*keys, F.col(f"{t}.h").alias("_h"), F.col(f"{t}.w").alias("_wt"))
    return vote(terms, keys, "_h", "_wt")


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """All (query fp, fp, distance) within ``radius``, by permuted block tables.

    The 64 bits are cut into ``radius + 3`` blocks; two fingerprints within the
    radius agree on at least three of them, so each choice of three blocks
    is a table keyed by their bits.  ``fps`` and ``queries`` hold distinct longs
    in ``fp``; a pair is met in the first table where it agrees only.
    """
    from itertools import combinations

    n = radius + 3
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [_signed(sum(1 << b for b in range(cuts[i], cuts[i + 1]))) for i in range(n)]
    tables = list(combinations(range(n), 3))
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(sum(m % (1 << 64) for m in (masks[i] for i in c))))).alias("k"))
        for t, c in enumerate(tables)
    ])
    side = lambda df, name: df.select("fp", F.explode(keys).alias("e")).select(F.col("fp").alias(name), "e.t", "e.k")
    # Twenty rows a fingerprint: too many to broadcast on the strength of the fingerprints' size.
    pairs = side(queries, "query_fp").hint("merge").join(side(fps, "fp"), ["t", "k"])
    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    equal = lambda c: F.lit(True) if not c else equal(c[1:]) & (apart.bitwiseAND(F.lit(masks[c[0]])) == 0)
    first = F.coalesce(*[F.when(equal(c), F.lit(t)) for t, c in enumerate(tables)])
    distance = F.bit_count(apart).cast("int")
    return pairs.where((distance <= radius) & (F.col("t") == first)).select("query_fp", "fp", distance.alias("distance"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their next document and edited text.

    The edit replaces the last quarter (rounded down) of a text's code points by
    as many, or all, from the start of the next document by ascending doc_id
    (after the last: the first).  Of rows that share an id the one with the
    smallest md5 of its text is the document that others see.  A row with a null
    id has no next document: its last quarter is cut.  Null and empty texts stay
    empty; texts may be of any length; an empty table gives no rows.

    The order is found on ids alone.  Texts are shuffled once, by doc_id; of the
    next text only as much travels as the edit can use.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Numbered where the table is read: a task that runs again gives the same numbers.
    base = base.withColumns({"text_md5": F.md5("text"), "row": F.monotonically_increasing_id()})
    quarter = F.floor(F.length("text") / 4).cast("int")
    # Per id: which text others see, and how much of the next one it may take.
    per = materialise(base.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_md5").alias("seen_md5"), F.max(quarter).alias("need")), "ids")
    chain = successors(per, "doc_id")
    before = chain.join(per, chain.key == per.doc_id).select(F.col("next").alias("id"), F.col("key").alias("prev_id"), "need")
    facts = before.join(per.select(F.col("doc_id").alias("id"), "seen_md5"), "id").join(chain.withColumnRenamed("key", "id"), "id")
    known = base.where("doc_id is not null").join(facts.withColumnRenamed("next", "next_id"), F.col("doc_id") == F.col("id"))
    # No filter on the md5, which would become a join key: both uses of ``known`` read one shuffle of the texts.
    start = F.when(F.col("text_md5") == F.col("seen_md5"), F.struct("row", F.substring("text", F.lit(1), F.col("need")).alias("x")))
    given = known.groupBy("prev_id").agg(F.min(start)["x"].alias("given"))
    met = known.select("row", "doc_id", "next_id", "text_md5", "text").join(given.withColumnRenamed("prev_id", "_prev"), F.col("doc_id") == F.col("_prev")).drop("_prev")
    none = base.where("doc_id is null").select("row", "doc_id", F.lit(None).cast("long").alias("next_id"), "text_md5", "text", F.lit("").alias("given"))
    rows = met.unionByName(none)
    return rows.select(
        "row",
        "doc_id",
        "next_id",
        F.length("text").cast("long").alias("n_chars"),
        "text_md5",
        "text",
        F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("given", F.lit(1), quarter)).alias("edited"),
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, n_chars, text_md5, edited_sha256, fp, edited_fp per row.

    Null and empty texts have the fingerprint 0; repeated rows are rows each; a text's
    words must weigh less than 2**32 bytes twice over; an empty table gives no rows.
    """
    made = ["doc_id", "next_id", "n_chars", "text_md5", "edited_sha256"]
    rows = edited_pairs(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.select("row", F.struct(*made).alias("doc"), "text", "edited")
    version = lambda v, c: F.struct(F.lit(v).alias("v"), F.col(c).alias("b"))
    versions = rows.select("row", "doc", F.explode(F.array(version(0, "text"), version(1, "edited"))).alias("x")).select("row", "doc", "x.v", "x.b")
    # Votes are summed where the texts are and dealt out by row: a common doc_id is no hot key.
    fps = text_fingerprints(versions, ["row", "doc", "v"], "b")
    both = fps.groupBy("row", "doc").agg(
        F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp")
    )
    return both.select("doc.*", "fp", "edited_fp")
