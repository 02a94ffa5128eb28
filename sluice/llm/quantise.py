"""Product-quantised vector codes by a delta-maintained Lloyd iteration.

Vectors become integers and are cut into parts; every part position has a codebook.
Each round assigns every part to its nearest entry.  The previous round's assignments
stay with the vectors and the entries' running integer sums in a table of their own: a
round shuffles only what a changed part takes from one entry and brings to another,
summed up in the task before it is sent.  Sums are integers, so it does not matter in
what order they meet or how often a lost task runs again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond count as this, so that every sum of squares fits a long (up to 2,048 components).
MOST = 1 << 25


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component, as whole numbers; null if the vector or a component is null or not finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    doubles = F.transform(vector, lambda x: x.cast("double"))
    whole = F.transform(doubles, lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return F.when(~F.exists(doubles, bad), whole)


class Codebooks:
    """Entries of every part position: an array (parts, entries, length), with 0 to ENTRIES entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.squares = np.einsum("pel,pel->pe", entries, entries)
        self.exact_floats = entries.size == 0 or int(np.abs(entries).max()) ** 2 * entries.shape[2] < 1 << 51

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of every part, squared distance), ties to the lower entry."""
        parts, _, length = self.entries.shape
        code, far = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
        cut = vectors[:, : parts * length].reshape(len(vectors), parts, length)
        floats = self.exact_floats and (cut.size == 0 or int(np.abs(cut).max()) ** 2 * length < 1 << 51)
        for p in range(parts):
            x = cut[:, p]
            # Whole numbers below 2**53 are exact as floats, and those multiply much faster.
            dot = (x.astype(np.float64) @ self.entries[p].T.astype(np.float64)).astype(np.int64) if floats else x @ self.entries[p].T
            d = self.squares[p] - 2 * dot
            code[:, p] = np.argmin(d, axis=1)
            far[:, p] = d[np.arange(len(x)), code[:, p]] + np.einsum("nl,nl->n", x, x)
        return code, far

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries replaced by floor(sum / count); unused ones stay."""
        new = self.entries.copy()
        for (p, e), (n, total) in sums.items():
            if n > 0:
                new[p, e] = [s // n for s in total]
        return Codebooks(new)

    def sha256(self) -> str:
        """Hex sha256 of all components by part, entry and position, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _block(column) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _assign(books: Codebooks, carry: list[str]):
    """Rows with their new codes; at a task's end a row for every entry whose parts changed, by how much."""
    parts, entries, length = books.entries.shape

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        shape = None
        for b in batches:
            shape = b.schema
            if not b.num_rows:
                continue
            x = _block(b.column("ints"))
            code, _ = books.nearest(x)
            old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            cut = x[:, : parts * length].reshape(len(x), parts, length)
            for p in range(parts):
                plus = np.flatnonzero(code[:, p] != old[:, p]) if old.shape[1] else np.arange(len(x))
                if not len(plus):
                    continue
                np.add.at(n[p], code[plus, p], 1)
                np.add.at(sums[p], code[plus, p], cut[plus, p])
                if old.shape[1]:
                    np.subtract.at(n[p], old[plus, p], 1)
                    np.subtract.at(sums[p], old[plus, p], cut[plus, p])
            packed = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), b.column("ints"), packed, *none], names=[*carry, "ints", "code", "part", "entry", "n", "sums"])
        p, e = np.nonzero((n != 0) | (sums != 0).any(axis=2))
        if len(p):
            blank = [pa.nulls(len(p), shape.field(c).type) for c in (*carry, "ints", "code")]
            made = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*blank, *made], names=[*carry, "ints", "code", "part", "entry", "n", "sums"])

    return run


def _measure(books: Codebooks, carry: list[str]):
    def run(batches):
        for b in batches:
            x = _block(b.column("ints"))
            code, far = books.nearest(x)
            text = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), text, pa.array(far.sum(axis=1))], names=[*carry, "code", "error"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, carry: list[str]) -> tuple[DataFrame, list]:
    """(rows with whole-number vectors of one length, as a table; the ENTRIES first of them).

    Left out: vectors that are null or hold null or non-finite components, and those
    of another length than the first one's.  First: smallest id (null last), equal ids by vector.
    """
    rows = vectors.select(*[F.col(f"`{c}`") for c in carry], integers(F.col(vector_col)).alias("ints")).where("ints is not null")
    order = [F.col(f"`{id_col}`").asc_nulls_last(), F.col("ints").asc()]
    first = rows.select(F.size("ints")).orderBy(*order).first()
    kept = materialise(rows.where(F.size("ints") == (first[0] if first else 0)).withColumn("code", F.lit(b"")), "vectors")
    seeds = [r.ints for r in kept.select(f"`{id_col}`", "ints").orderBy(*order).limit(ENTRIES).collect()]
    return kept, seeds


def train(rows: DataFrame, seeds: list, carry: list[str], parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over ``rows`` (carry, ints, code): of each only its changes are shuffled."""
    length = len(seeds[0]) // parts if seeds else 0
    books = Codebooks(np.array([[s[p * length : (p + 1) * length] for s in seeds] for p in range(parts)], np.int64).reshape(parts, len(seeds), length))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    total, spark = None, rows.sparkSession
    # Nothing of a round is read once the codebooks are made.
    with scratch(spark):
        for r in range(rounds if seeds else 0):
            made = materialise(rows.mapInArrow(_assign(books, carry), f"{fields}, part int, entry int, n long, sums array<long>"), f"assigned{r}")
            change = made.where("part is not null").select("part", "entry", "n", "sums")
            whole = change if total is None else total.unionByName(change)
            place = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(length)]
            now = materialise(whole.groupBy("part", "entry").agg(F.sum("n").alias("n"), *place).select("part", "entry", "n", F.array(*[f"s{k}" for k in range(length)]).cast("array<bigint>").alias("sums")), "sums")
            # At most parts x ENTRIES rows.
            books = books.moved({(x.part, x.entry): (x.n, x.sums) for x in now.collect()})
            if total is not None:
                discard(total)
            if r:
                discard(rows)
            rows, total = made.where("part is null").select(*carry, "ints", "code"), now
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error per row; the codebooks).

    Rows whose vector is null or holds null or non-finite components are left out, as are
    vectors of another length than the first's; components that the parts do not
    share out evenly take no part.  Ids and labels may be null or repeated; with fewer
    than ENTRIES rows there are as many entries; an empty table has no rows and no entries.
    """
    small_batches(vectors.sparkSession)
    carry = list(dict.fromkeys([id_col, label_col]))
    rows, seeds = usable(vectors, id_col, vector_col, carry)
    books = train(rows, seeds, carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in carry]).schema.fields)
    return rows.mapInArrow(_measure(books, carry), f"{kinds}, code string, error long"), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with label_error: the errors summed over equal labels, nulls together."""
    # Fields for a join by equality that a null label can take part in.
    def key(c: Column) -> list[Column]:
        return [c.isNull().alias("_none"), F.coalesce(c.cast("string"), F.lit("")).alias("_key")]

    label = F.col(f"`{label_col}`")
    sums = coded.select(*key(label), "error").groupBy("_none", "_key").agg(F.sum("error").alias("label_error"))
    return coded.select("*", *key(label)).join(sums, ["_none", "_key"]).drop("_none", "_key")
