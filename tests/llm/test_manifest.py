"""Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest

from sluice.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(enc, r)))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            now = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            beside = ""
            for levels, p in ((trees[s], i), (top, k)):
                for row in levels[:-1]:
                    a = p // arity * arity
                    left, right = "".join(row[a:p]), "".join(row[p + 1 : a + arity])
                    beside, now, p = beside + left + right, digest(left + now + right), p // arity
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest(beside), now, now == top[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: [str(x) for x in r])


ROWS = (
    [(None, None, "a", None, "X")] * 2 + [(5, "", "a", 1, None)] * 2 + [(5, "z", None, 1, "ABC"), (6, "é", "fr", 2, ""), (7, "😀", "x", 1, "A" * 100_000)]
    + [(i, "hot", None, 3, f"Ab{i}") for i in range(300)] + [(i, f"s{i % 40}", "x", 1, "T") for i in range(40)]
)


@pytest.mark.parametrize("arity", [16, 2, 3])
def test_manifest_is_the_plain_one(spark, arity):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert in_order(tuple(r) for r in merkle.verify(docs, arity).collect()) == in_order(plain(ROWS, arity))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS kids")
    (one,) = merkle.verify(docs.where("source = 'z'")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")
    assert merkle.verify(docs.limit(0)).collect() == [] and merkle.manifest(docs.limit(0)).root is None


def test_a_changed_row_is_found_out_and_only_it(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    was, now = merkle.manifest(docs), merkle.manifest(docs.replace("Ab7", "ab7"))
    assert was.root != now.root
    both = was.proofs().alias("a").join(now.leaves.alias("b"), on=["tree", "pos"])
    bad = both.where(merkle.fold(both["b.leaf"], both["a.path"]) != both["a.root"]).select("a.doc_id").collect()
    assert [r.doc_id for r in bad] == [7]


def test_partial_parents_in_any_order():
    """Nodes complete the same tree whatever the order and the task in which they come."""
    import random

    leaves = [digest(str(i)) for i in range(70)]
    whole = merkle.Partial(1, 4)
    want = {r for i, d in enumerate(leaves) for r in whole.put(0, 70, 0, i, d)}
    assert not whole.open
    for seed in range(5):
        at = list(range(70))
        random.Random(seed).shuffle(at)
        tasks, got, frontier = [merkle.Partial(1, 4) for _ in range(3)], set(), []
        for i in at:
            got |= set(tasks[i % 3].put(0, 70, 0, i, leaves[i]))
        for t in tasks:
            frontier += t.rest()
        last = merkle.Partial(1, 4)
        for tree, n, level, pos, _, d in frontier:
            got |= set(last.put(tree, n, level, pos, d))
        assert got == want and not last.open
