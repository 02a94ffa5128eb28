"""The opN_ queries themselves on the smallest tables: SQL where there is some, else brute force."""

import glob
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import langid, mixing
from sluice.llm.queries import ORACLE_SQL, QUERIES, table

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "op1_maintext": "page_id url text n_chars", "op2_topk": "query_id rank vec_id score", "op3_langid": "doc_id held_out lang_pred score n_langs",
    "op4_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next n_within",
    "op5_tokens": "doc_id n_chars n_tokens edited_chars edited_tokens reencoded_chars", "op6_neardup": "doc_id fingerprint component_id",
    "op7_mix": "doc_id size source_size target taken", "op8_urlfilter": "page_id host path rule verdict",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_toxicity": "doc_id held_out score predicted n_readings", "op12_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_runs_with_its_columns(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    assert out.columns == COLUMNS[name].split()
    rows = sorted(repr(tuple(r)) for r in out.collect())
    kind = "pages" if "page_id" in out.columns else "documents"
    if name not in ("op2_topk", "op9_packing", "op13_codes"):
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {kind}").fetchone()[0]
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in out.columns]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_fingerprints_by_hand(spark):
    import xxhash

    docs = sorted((r.doc_id, r.text or "") for r in table(spark, DATA, "documents").collect())

    def fingerprint(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        w = [p for x in w for p in ([x[i : i + 4] for i in range(len(x) - 3)] if len(x) > 24 else [x])]
        votes, total = [0] * 64, 0
        for a, b in zip(w, [*w[1:], None]):
            h = xxhash.xxh64_intdigest(a.encode(), 42)
            h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
            weight = len(a.encode()) + len((b or "").encode())
            total += weight
            for i in range(64):
                votes[i] += weight * (h >> i & 1)
        return sum(1 << i for i in range(64) if 2 * votes[i] > total)

    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    texts = [t for _, t in docs]
    edited = []
    for k, t in enumerate(texts):
        q = len(t) // 4
        edited.append(t[: len(t) - q] + texts[(k + 1) % len(texts)][:q])
    fp, efp = list(map(fingerprint, texts)), list(map(fingerprint, edited))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_fingerprint"](spark, DATA).collect()}
    for k, (i, t) in enumerate(docs):
        within = sum(bin(x ^ fp[k]).count("1") <= 3 for x in fp) - 1 if i % 20 == 0 else None
        want = (len(t), hashlib.sha256(edited[k].encode()).hexdigest(), f"{fp[k]:016x}", f"{efp[k]:016x}", like(fp[k], efp[k]), like(fp[k], fp[(k + 1) % len(fp)]), within)
        assert got[i] == want, i


def test_mixture_is_the_likeliest():
    rng = np.random.default_rng(6)
    for _ in range(20):
        p, c = rng.random((40, 2)) + 0.01, rng.integers(1, 9, 40).astype(float)
        pi, ll = langid._mixture(p, c, rounds=400)
        grid = np.linspace(0, 1, 401)
        best = max(float(c @ np.log(p @ np.array([x, 1 - x]))) for x in grid[1:-1])
        assert ll >= best - 1e-3 and abs(pi.sum() - 1) < 1e-9


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op3_langid"](spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_one_offset_can_miss_the_target(spark):
    """Why a source chooses among offsets: by its words' distance from the target."""
    docs = table(spark, DATA, "documents")

    def worst(draws):
        per = mixing.shares(docs, draws=draws).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("t"))
        return max(abs(r.taken - r.t) / r.t for r in per.collect())

    one, many = worst(1), worst(mixing.DRAWS)
    print(f"worst source: one offset {one:.3f}, {mixing.DRAWS} offsets {many:.3f}")
    assert many <= one


def test_toxic_words_of_held_out_documents(spark):
    rows = QUERIES["op11_toxicity"](spark, DATA.replace("0.001", "0.1")).join(table(spark, DATA.replace("0.001", "0.1"), "labels"), "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic == 1)
    assert caught >= 0.85 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
