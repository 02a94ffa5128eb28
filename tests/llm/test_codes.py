"""Delta-maintained Lloyd against whole rounds over Python numbers."""

import hashlib
import math

import numpy as np

from sluice.llm import quantise


def plain(rows):
    """(id, code, error, label error) and the codebooks' digest, every round from scratch."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // 4
    cut = [[v[p * n : (p + 1) * n] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(4):
        for p in range(4):
            got = {}
            for c in cut:
                got.setdefault(nearest(p, c[p]), []).append(c[p])
            for e, xs in got.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    out, sums = [], {}
    for (i, _, y), c in zip(kept, cut):
        code = [nearest(p, c[p]) for p in range(4)]
        error = sum(far(c[p], books[p][e]) for p, e in enumerate(code))
        sums[y] = sums.get(y, 0) + error
        out.append((i, bytes(code).hex(), error, y))
    text = ",".join(str(x) for p in books for e in p for x in e)
    return [(i, c, e, sums[y]) for i, c, e, y in out], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, ddl="vec_id long, embedding array<double>, label int"):
    coded, books = quantise.compress(spark.createDataFrame(rows, ddl))
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in quantise.with_label_error(coded).collect()]
    want, sha = plain(rows)
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and books.sha256() == sha


def test_codes_are_those_of_whole_rounds(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * 0.05], i % 3 if i % 7 else None) for i in range(700)]
    rows += [(None, [0.5] * 8, None), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1)]
    check(spark, rows)


def test_ties_copies_and_few_rows(spark):
    check(spark, [(i, [float(i % 2)] * 4, 0) for i in range(300)])
    check(spark, [(1, [1.0, -2.5, 3.0, 0.0, 9.0], None)] * 3)
    check(spark, [(i, [1e-9 * (-1) ** i] * 4, i) for i in range(5)])


def test_nothing_to_code_and_other_lengths(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    coded, books = quantise.compress(empty)
    assert coded.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    mixed = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [2.0] * 8, 1), (4, [], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "2 AS ints", "3 AS part")
    assert sorted(r.vec_id for r in quantise.compress(mixed)[0].collect()) == [1, 3]


def test_huge_components_do_not_overflow(spark):
    rows = [(i, [1e30, -1e30, 3.4e38, 0.0], 0) for i in range(3)] + [(9, [-1e30] * 4, 0)]
    coded, _ = quantise.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: r.error for r in coded.collect()} == {0: 0, 1: 0, 2: 0, 9: 0}


def test_a_round_carries_changes_only():
    """What a task sends is empty where no assignment changes."""
    import pyarrow as pa

    books = quantise.Codebooks(np.array([[[0], [10]], [[0], [10]]], np.int64))
    batch = lambda code: pa.RecordBatch.from_pydict({"id": [1, 2], "ints": pa.array([[1, 9], [8, 0]], pa.list_(pa.int32())), "code": pa.array(code, pa.binary())})
    run = quantise._assign(books, ["id"])
    first = list(run([batch([b"", b""])]))
    assert len(first) == 2 and first[1].num_rows == 4
    codes = first[0].column("code").to_pylist()
    assert codes == [b"\x00\x01", b"\x01\x00"] and len(list(run([batch(codes)]))) == 1
    moved = list(run([batch([b"\x01\x01", b"\x01\x00"])]))[1].to_pydict()
    assert (moved["part"], moved["entry"], moved["n"], moved["sums"]) == ([0, 0], [0, 1], [1, -1], [[1], [-1]])
