"""Exact top-k inner-product search, term at a time.

Every component is a term.  A block of candidates is turned into postings
(term -> candidates and weights); each query row then scatters its weighted
postings into a dense score array, a partition picks the block's best k, and
the blocks' lists are merged.  Queries meet candidates block by block, so no
side is ever broadcast or collected whole.  A candidate is copied once for each
block of queries, a query once for each block of candidates; queries are the
fewer, so their blocks are few.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism

#: Components of one block: bounds a task's memory (postings, queries).
BLOCK_COMPONENTS = 1 << 23
#: What a score is held to where it does not fit a long.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component; null if the vector can take no part."""
    usable = vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(usable, whole)


def top_k(rows: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20) -> DataFrame:
    """The k best candidates of each query row by integer inner product.

    ``vec_col`` holds array<long>.  A candidate is every row but those with the
    query's own id.  Rows with a null id or vector take no part.  Vectors of
    different lengths meet on the components both have.  Repeated ids each
    count as a candidate, and each row of a repeated query has its own k
    answers.  Ties go to the smaller id.  A score beyond a long's range counts
    as the nearest long.  An empty table gives no rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("is_query")
    ).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    width = F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))
    n, wide, nq, wide_q = base.agg(F.count("*"), width, F.coalesce(F.count_if("is_query"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_query"), F.size("vec").cast("long"))), F.lit(0))).first()
    q = max(1, -(-wide_q // BLOCK_COMPONENTS))
    c = max(1, -(-wide // BLOCK_COMPONENTS), min(n, -(-2 * parallelism(spark) // q)))
    # Dealt by row: an id that many rows share is in all blocks alike.
    spread = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = base.where("is_query").select(spread(q, 1).alias("qb"), every(c).alias("cb"), "id", "row", "vec")
    candidates = base.select(every(q).alias("qb"), spread(c, 2).alias("cb"), "id", F.lit(0).cast("long").alias("row"), "vec")
    best = (
        queries.groupBy("qb", "cb")
        .cogroup(candidates.groupBy("qb", "cb"))
        .applyInArrow(_block_scorer(k), "query_id long, row long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _block_scorer(k: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by([("id", "ascending"), ("row", "ascending")])
            numbers = left.column("row").to_numpy()
            for row, (qid, ids, scores) in zip(numbers, term_at_a_time(_rows(left), _rows(right.sort_by("id")), k)):
                for x, v in zip(out, (np.full(len(ids), qid, np.int64), np.full(len(ids), row, np.int64), ids, scores)):
                    x.append(v)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), cols)))

    return score


def _rows(t: pa.Table):
    """Ids, row offsets and flat components of a sorted table."""
    t = t.combine_chunks()
    vec = t.column("vec").combine_chunks()
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = np.diff(vec.offsets.to_numpy())
    return t.column("id").to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), flat


def _held(x: int) -> int:
    return min(_MOST, max(_LEAST, x))


def _wide(off: np.ndarray, flat: np.ndarray, most: int) -> np.ndarray:
    """Rows with a component beyond ``most``."""
    beyond = np.flatnonzero((flat > most) | (flat < -most))
    return np.unique(np.searchsorted(off, beyond, side="right") - 1)


def term_at_a_time(queries, candidates, k: int):
    """Yield (query id, candidate ids, scores): each query's best k of the block, query rows in order."""
    qids, qoff, qflat = queries
    cids, coff, cflat = candidates
    n, lengths = len(cids), np.diff(coff)
    width = int(lengths.max(initial=0))
    # Components up to this give scores that fit a long; rows with a larger one are few and worked out in whole numbers of any size.
    safe = math.isqrt(_MOST // max(width, 1))
    wide_c, wide_q = _wide(coff, cflat, safe), set(_wide(qoff, qflat, safe).tolist())
    vector = lambda off, flat, i: flat[off[i] : off[i + 1]].tolist()
    wide_vectors = [vector(coff, cflat, i) for i in wide_c]
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    term = (np.arange(len(cflat)) - np.repeat(coff[:-1], lengths)).astype(np.int32)
    used = cflat != 0
    if len(wide_c):
        used &= ~np.isin(row, wide_c)
    row, term, weight = row[used], term[used], cflat[used]
    by_term = np.argsort(term, kind="stable")
    row, weight = row[by_term], weight[by_term]
    cut = np.searchsorted(term[by_term], np.arange(width + 1))
    narrow_q = int(np.abs(qflat[(qflat <= safe) & (qflat >= -safe)]).max(initial=0))
    bound = int(np.abs(weight).max(initial=0)) * narrow_q * max(width, 1)
    kind = np.int32 if bound < 2**31 else np.int64
    weight = weight.astype(kind)
    # A term that most candidates have is kept dense: no scatter needed.
    postings = []
    for t in range(width):
        at, w = row[cut[t] : cut[t + 1]], weight[cut[t] : cut[t + 1]]
        if 2 * len(at) > n:
            dense = np.zeros(n, kind)
            dense[at] = w
            at, w = None, dense
        postings.append((at, w))
    del row, term, by_term
    scores, work = np.zeros(n, kind), np.zeros(n, kind)
    for i, qid in enumerate(qids):
        q = qflat[qoff[i] : qoff[i + 1]][:width]
        if i in wide_q:
            own = q.tolist()
            s = np.array([_held(sum(map(mul, own, vector(coff, cflat, x)))) for x in range(n)], np.int64)
        else:
            scores[:] = 0
            for t in np.flatnonzero(q):
                at, w = postings[t]
                if at is None:
                    np.multiply(w, kind(q[t]), out=work)
                    np.add(scores, work, out=scores)
                else:
                    scores[at] += w * kind(q[t])
            s = scores
            if len(wide_c):
                s = scores.astype(np.int64)
                own = q.tolist()
                s[wide_c] = [_held(sum(map(mul, own, v))) for v in wide_vectors]
        own_from, own_to = np.searchsorted(cids, [qid, qid + 1])
        ids = cids
        if own_to > own_from:
            others = np.r_[0:own_from, own_to:n]
            s, ids = s[others], cids[others]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > edge)
            level = np.flatnonzero(s == edge)[: k - len(above)]
            pick = np.concatenate([above, level])
        else:
            pick = np.arange(len(s))
        yield qid, ids[pick].astype(np.int64), s[pick].astype(np.int64)
