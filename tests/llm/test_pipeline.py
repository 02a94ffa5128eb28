"""The pipeline's stages on a small corpus, against brute force where it has one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    letters = {"en": "abcdefgh", "fr": "klmnopqr"}
    word = lambda l: "".join(rng.choice(letters[l]) for _ in range(rng.randint(2, 7)))
    say = lambda l, n: " ".join(word(l) for _ in range(n))
    shared = say("en", 70)
    rows = [(i, say(l := rng.choice(["en", "fr"]), rng.randint(60, 160)), l, f"s{i % 3}", 0) for i in range(60)]
    rows += [(60, rows[3][1], "en", "s0", 0), (61, rows[4][1] + " tail", "en", "s1", 0)]
    rows += [(70 + i, say("en", 80) + " " + shared + " " + say("en", 80), "en", None, 0) for i in range(3)]
    rows += [(80, None, None, "s0", 0), (81, "", "en", "s0", 0), (82, "123 456", "en", "s0", 0)]
    rows += [(83, say("fr", 90), "en", "s1", 0), (84, say("en", 90), None, "s1", 0)]
    return [(i, t, l, s, len(t or "")) for i, t, l, s, _ in rows], shared


def test_stages(spark):
    rows, shared = corpus()
    first = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    names, seen = [n for n, _ in corpus_pipeline.STAGES], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    lang, near, cut, mixed, packed = seen
    assert len(names) == 5 and all(d.columns == lang.columns == [f.split()[0] for f in DOCS.split(", ")] for d in seen[:4])
    told = {r.doc_id: r.lang for r in lang.collect()}
    assert set(told) == set(first) - {80, 81, 82} and told[83] == "fr" and told[84] == "en"
    kept = {r.doc_id for r in near.collect()}
    assert 60 not in kept and len({4, 61} & kept) == 1 and len(kept) >= 60 and {70, 71, 72} <= kept
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == kept and all(shared not in after[i].text for i in (70, 71, 72)) and all(len(r.text) == r.n_chars for r in after.values())
    assert all(after[i].text == first[i] for i in kept - {70, 71, 72})
    took = {}
    for r in mixed.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + 1
        assert r.text == after[r.doc_id].text
    assert max(took.values()) <= 3
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(took)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r["offset"], r["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_mixtures_without_a_main_language_go(spark):
    rng = random.Random(3)
    letters = {"a": "abcdef", "b": "ghijkl", "c": "mnopqr"}
    say = lambda l, n: " ".join("".join(rng.choice(letters[l]) for _ in range(4)) for _ in range(n))
    rows = [(i, say(l, 80), l, "s", 0) for i, l in enumerate("abc" * 12)]
    rows += [(100, " ".join(say(l, 60) for l in "abc"), "a", "s", 0), (101, say("a", 90) + " " + say("b", 60), "a", "s", 0)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), "")
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} - {100}


def test_near_copies_by_kind_of_edit(spark):
    """What the near-dedup stage drops is what all pairs by five-word shingles give, per similarity and kind of edit."""
    rng = random.Random(4)
    zipf = [f"w{int(1 / (1e-4 + rng.random()))}" for _ in range(30_000)]
    texts = []
    for k in range(90):
        base = rng.sample(zipf, rng.choice([60, 300, 900]))
        if k % 3 == 0:
            other = base + rng.sample(zipf, int(len(base) * rng.choice([0.05, 0.1, 0.2, 0.3])))
        elif k % 3 == 1:
            other = [w if rng.random() > rng.choice([0.005, 0.02, 0.04]) else "changed" for w in base]
        else:
            cut = int(len(base) * rng.choice([0.03, 0.1, 0.15, 0.25]))
            other = base[cut:]
        texts += [base, other]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [2 * k for k in range(90) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == set(range(180)) - {i + 1 for i in alike} and len(alike) > 30


def test_extra_columns_null_ids_and_no_tables_left(spark, tmp_path):
    import os

    from sluice.llm.common import shared_dir

    rows, _ = corpus(5)
    docs = spark.createDataFrame(rows + [(None, "abc de fgh " * 20, "en", "s0", 0), (None, None, None, None, None)], DOCS)
    docs = docs.withColumns({"_guess": F.lit(1), "key": F.lit("x"), "sh": F.lit(2), "_row": F.lit(3), "root": F.lit(4), "copies": F.lit(5)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns or {"_guess", "copies"} - set(out.columns)
        assert out.count() > 0
    docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    made = {d.split("-")[1] for d in set(os.listdir(root)) - before}
    assert made <= {"pieces", "stage4"}


def test_empty_and_run(spark, tmp_path):
    rows, _ = corpus(2)
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.where(F.col("length") > 2048).count() == 0
