"""Each operator against brute force on small tables, with the awkward cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, htmltext, langid, mixing, neardup, packing, simhash, suffixes, tokencount, topk, urlfilter
from sluice.llm.queries import ORACLE_SQL, url_list

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, **extra):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c, x in extra.items():
        df = df.withColumn(c, F.lit(x))
    return df


# --- 1: main text ------------------------------------------------------------------

ARTICLE = "A first paragraph that is long enough to be the content of this page, as it has many words."
PAGES = {
    f"<article><h1>T &amp; &#233;</h1><p>{ARTICLE}<p>Short.<br>Two\n lines</article>": f"T & é\n{ARTICLE}\nShort. Two lines",
    f"<nav><a href=x>Home</a></nav><div class='content'><p>{ARTICLE}</p><p>{ARTICLE}</p></div><footer>&copy; x</footer>": f"{ARTICLE}\n{ARTICLE}",
    f"<header><p>{ARTICLE}</p></header><main><p>{ARTICLE} 2</p><div id='cookie-notice'><p>{ARTICLE}</p></div><form><p>{ARTICLE}</p></form></main>": f"{ARTICLE} 2",
    f"<main><p>{ARTICLE}</p><section class='comments'><article><p>{ARTICLE}</p></article></section></main>": ARTICLE,
    f"<script>var a='<p>{ARTICLE}</p>';</script><!-- <p>no</p> --><article><p>{ARTICLE}</p><div class='ad'>Buy</div></article>": ARTICLE,
    "": "", "   ": "", "<": "", "<p": "", "<article><p>1 < 2 & 3": "1 < 2 & 3",
}


def test_main_text(spark):
    assert [htmltext.main_text(p) for p in PAGES] == list(PAGES.values())
    df = spark.createDataFrame([(None,), ("<article><p>" + "word " * 50_000,)], "html string")
    assert [len(r.t) for r in df.select(htmltext.extract_text(F.col("html")).alias("t")).collect()] == [0, 249_999]


def test_wrapper_names_do_not_lose_the_article():
    two = f"<p>{ARTICLE}</p><p>{ARTICLE}</p>"
    wraps = [
        f"<div class='content with-sidebar'><article>{two}</article></div>", f"<main class='no-comments'>{two}</main>",
        f"<div id='page' class='has-banner'>{two}</div>", f"<div class='search banner'><div><main>{two}</main></div></div>",
        f"<form id=aspnet><article>{two}</article></form>", f"<div class='widget'><article>{two}<div class='share'>{ARTICLE}</div></article></div>",
    ]
    assert [htmltext.main_text(w) for w in wraps] == [f"{ARTICLE}\n{ARTICLE}"] * len(wraps)
    aside = f"<div class='comments'><article><p>{ARTICLE} 3</p></article></div><div style='display:none'><article>{two}</article></div>"
    assert htmltext.main_text(f"<article>{two}</article>{aside}") == f"{ARTICLE}\n{ARTICLE}"
    # What is named a notice goes; a name that only holds such a word is for the cut to weigh.
    near = lambda c: f"<article><p>{ARTICLE * 2}</p><p class='{c}'>{ARTICLE * 2}</p><p>{ARTICLE * 2}</p></article>"
    kept = [htmltext.main_text(near(c)).count("\n") == 2 for c in ("story-social-history", "lead", "notice", "ad-box", "share bottom", "article-comments")]
    assert kept == [True, True, False, False, False, False]


def test_the_cut_overrules_the_classifier_both_ways():
    short = f"<div><p>{ARTICLE}</p><p>Nine of ten</p><p>{ARTICLE} 2</p></div>"
    list_ = "".join(f"<li><a href=x{i}>Some link {i}</a></li>" for i in range(4))
    menu = f"<ul>{list_}<li>{ARTICLE}</li>{list_}</ul>"
    told = htmltext.labelled(short)
    assert told[1][1] < 0 and told[1][2] and htmltext.main_text(short) == f"{ARTICLE}\nNine of ten\n{ARTICLE} 2"
    told = htmltext.labelled(menu)
    assert told[4][1] > 0 and not told[4][2] and htmltext.main_text(menu) == ""
    assert htmltext.main_text(f"<div>{short}</div>{menu}") == f"{ARTICLE}\nNine of ten\n{ARTICLE} 2"


def test_deep_and_long_pages_take_linear_time(spark):
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.time()
        assert htmltext.main_text("<div>" * n + f"<p>{ARTICLE}" + "<b>" * n + "</i>" * n + f"<p>{ARTICLE}" * 50).count("\n") == 50
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.5
    df = spark.createDataFrame([(f"<p>{ARTICLE}",)] * 3, "html string")
    assert {r.t for r in df.select(htmltext.extract_text(F.col("html")).alias("t")).collect()} == {ARTICLE}
    assert df.limit(0).select(htmltext.extract_text(F.col("html")).alias("t")).count() == 0


PARAGRAPH = "<p>" + "A long enough paragraph of an article, with words and a full stop at its end. " * 3 + "</p>"


@pytest.mark.parametrize("page, holds, lacks", [
    ("<article><a title=it's>first</a>" + PARAGRAPH + "<p title='a'>b</p></article>", "first\nA long", "it's"),
    ("<article><!-->" + PARAGRAPH + "<!-- x --></article>", "A long", "x "),
    ("<article><!--->" + PARAGRAPH + "<!-- gone --!>" + PARAGRAPH + "</article>", "A long", "gone"),
    ("<article>" + PARAGRAPH + "<p><![CDATA[hidden]]></p></article>", "A long", "hidden"),
    ("<article>" + PARAGRAPH + "</ nothing></></article>", "A long", "nothing"),
    ('<article><p data-x=a="b>c</p>' + PARAGRAPH + "</article>", "c\nA long", "b>"),
    ("<p>Hi</p>", "Hi", "<"), ("plain words", "plain words", "<"), ("<nav><a href=x>Home</a></nav><p>Hi</p>", "Hi", "Home"),
])
def test_markup_by_the_rules_of_html(page, holds, lacks):
    got = htmltext.main_text(page)
    assert holds in got and lacks not in got


def test_pages_without_text_of_their_own_stay_empty():
    for page in ("<nav><a href=x>Home</a></nav>", "<p>Read more</p>", "<p>Alle Rechte vorbehalten</p>", "<p><a href=x>a</a></p>", "<footer>Hi</footer>"):
        assert htmltext.main_text(page) == ""


def test_unclosed_raw_elements_take_one_look():
    import time

    began = time.time()
    assert htmltext.main_text("<iframe>" * 100_000 + PARAGRAPH).startswith("A long")
    htmltext.main_text("<a ='" * 20_000), htmltext.main_text("<a b=" * 50_000), htmltext.main_text("<!--" * 50_000)
    assert time.time() - began < 5


def test_broken_markup_does_not_end_the_page():
    assert htmltext.main_text(f"<head><title>x</title><meta a=b><p>{ARTICLE}") == ARTICLE
    assert htmltext.main_text(f"<head><title>x</title></head><article><p>{ARTICLE}</article>") == ARTICLE
    for tag in ("select", "object", "svg", "canvas", "iframe", "noscript"):
        assert htmltext.main_text(f"<article><{tag}><p>{ARTICLE}</p></article>") == ARTICLE, tag
    assert htmltext.main_text(f"<article><p>{ARTICLE}</p><script>if (a) <p>{ARTICLE}</article>") == ARTICLE


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 7)
        a, b = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: E731, B023
        assert cost(htmltext.min_cut(n, a, b, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


# --- 2: top-k ------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 64)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.03, 0.5]) for _ in range(rng.choice([4, 4, 6]))]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (None, [1.0] * 4), (5, [0.5] * 4), (64, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    df = df.withColumn("v", topk.integer_vectors(F.col("embedding")))
    got = {}
    for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    good = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 20, 40):
        (own,) = [v for i, v in good if i == q]
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 20, 40} and all(len(x) == 7 for x in got.values()) and topk.top_k(df.limit(0), "vec_id", "v", F.lit(True)).count() == 0


def test_top_k_of_repeated_queries_and_large_components(spark):
    rows = [(i, [float(i % 7 - 3), 1.0, 0.25]) for i in range(30)] + [(20, [2.0, 0.0, 1.0]), (20, [2.0, 0.0, 1.0]), (31, [1e30, -1e30, 2.0]), (40, [1e10, 1e10, -1.0]), (33, [1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumn("v", topk.integer_vectors(F.col("embedding")))
    got = [(r.query_id, r["rank"], r.score, r.vec_id) for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") % 20 == 0, 4).collect()]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [held(int(np.floor(64 * x))) for x in v]) for i, v in rows]
    want = []
    for i, v in whole:
        if i % 20 == 0:
            best = sorted((-held(sum(a * b for a, b in zip(v, w))), j) for j, w in whole if j != i)[:4]
            want += [(i, k + 1, -s, j) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want) and len(got) == 4 * 5


# --- 3: languages -----------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(3)
    say = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    make = lambda l, n: " ".join("".join(rng.choice(say[l]) for _ in range(4)) for _ in range(n))
    train = spark.createDataFrame([(i, make(l, 60), l) for i in range(10) for l in say] + [(99, None, "xx"), (98, "qqq", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model[0] == ["xx", "yy", "zz"]
    texts = [make("xx", 50), make("zz", 3), make("xx", 60) + " " + make("yy", 40), None, "", "123 %%", make("yy", 40_000)]
    df = docs(spark, texts, lang_pred="old", score=9)
    got = sorted(langid.predict(df, model).collect())
    assert [r.lang_pred for r in got] == ["xx", "zz", "xx", "und", "und", "und", "yy"]
    assert set(got[2].lang_set) == {"xx", "yy"} and abs(got[2].lang_share[0] - 0.6) < 0.05 and got[0].lang_set == ["xx"]
    assert all(0 <= r.score <= 1 for r in got) and [r.score for r in got[3:6]] == [0, 0, 0]
    five = ["abcde", "fghij", "klmno", "pqrst", "uvwxyz"]
    many = spark.createDataFrame([(i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(80)), f"l{k}") for i in range(8) for k, a in enumerate(five)], "doc_id long, text string, lang string")
    mixture = " ".join(" ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(60)) for a in five)
    (told,) = langid.predict(docs(spark, [mixture]), langid.train(many)).collect()
    assert sorted(told.lang_set) == [f"l{k}" for k in range(5)] and all(abs(x - 0.2) < 0.05 for x in told.lang_share)
    twice = langid.predict(docs(spark, ["fgh jih"] * 2, [4, 4]), model).collect()
    assert [r.lang_pred for r in twice] == ["yy", "yy"] and langid.predict(df.limit(0), model).count() == 0
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    out = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_top_k_deals_a_common_id_to_all_blocks(spark, monkeypatch):
    """Rows of one id, queries among them, over several blocks: results as from all pairs, and no block holds them all."""
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 60)
    rng = random.Random(14)
    rows = [(20, [rng.randint(-9, 9) for _ in range(4)]) for _ in range(40)] + [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(1, 60) if i != 20]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") % 20 == 0, 5).collect())
    want = []
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


# --- 4 and 6: fingerprints --------------------------------------------------------


def test_shingle_fingerprints(spark):
    import re

    import xxhash

    texts = ["", None, "a", "A  b", "a b c", "x y z x y z x", " É ö\tü\x0b z \n", "w " * 30_000, "a\x1cb c\xa0d e"]
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.shingle_fingerprints(docs(spark, texts), ["doc_id"], 3).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), t


def test_edited_pairs(spark):
    rows = [(5, "abcd efgh ijkl"), (1, None), (9, "é" * 40), (9, "zz yy"), (None, "aaaa bbbb"), (None, None), (70, "w " * 50), (5, "abcd efgh ijkl")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("fp", F.lit("x"))
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, []).append(t or "")
    first = {i: min(v, key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i, v in by.items()}
    ids, want = sorted(first), []
    for i, t in rows:
        t, nx = t or "", None if i is None else ids[(ids.index(i) + 1) % len(ids)]
        q = len(t) // 4
        e = t[: len(t) - q] + (first[nx][:q] if nx is not None else "")
        want.append((str(i), str(nx), len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = simhash.fingerprint_edits(df).collect()
    assert sorted((str(r.doc_id), str(r.next_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    same = {r.fp for r in got if r.doc_id == 5}
    assert len(same) == 1 and simhash.fingerprint_edits(df.limit(0)).count() == 0


def near_pairs(fps, radius=3):
    return {(a, b): bin((a ^ b) % (1 << 64)).count("1") for a in fps for b in fps if bin((a ^ b) % (1 << 64)).count("1") <= radius}


def test_texts_without_spaces_have_terms_of_their_own_length(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + rng.randrange(3000)) for _ in range(900)]
    texts = ["".join(rng.choices(letters, k=rng.randint(600, 1500))) for _ in range(30)]
    rows = simhash.fingerprint_edits(docs(spark, texts)).collect()
    by_id = {r.doc_id: r for r in rows}
    like = lambda a, b: 1 - bin((a ^ b) % (1 << 64)).count("1") / 64
    edited = [like(r.fp, r.edited_fp) for r in rows]
    following = [like(r.fp, by_id[r.next_id].fp) for r in rows]
    assert sum(edited) / len(edited) > 0.75 and 0.4 < sum(following) / len(following) < 0.6
    assert len({r.fp for r in rows}) == len(rows)


def some_fingerprints(rng, n, groups=6):
    base, out = [rng.getrandbits(64) for _ in range(groups)], set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x - (1 << 64) if x >= 1 << 63 else x)
    return sorted(out)


def test_block_tables_find_all(spark):
    fps = some_fingerprints(random.Random(4), 120)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [(r.query_fp, r.fp, r.distance) for r in simhash.near_fingerprints(df, df).collect()]
    want = near_pairs(fps)
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def labels(fps, links):
    at = {x: i for i, x in enumerate(fps)}
    a, b = np.array([at[x] for x, _ in links], int), np.array([at[y] for _, y in links], int)
    return neardup.flood(len(fps), a, b).tolist()


@pytest.mark.parametrize("split_over", [512, 8, 1])
def test_links_join_what_all_pairs_would(spark, split_over):
    rng = random.Random(5)
    fps = sorted(set(some_fingerprints(rng, 200) + [0, 1, -1, -2] + [1 << i for i in range(12)] + [7 ^ (1 << i) for i in range(40, 60)]))
    df = spark.createDataFrame([(x, 0) for x in fps] + [(x, 3) for x in fps[:20]], "fp long, seed int")
    got = [(r.seed, r.a, r.b) for r in neardup.links_within(df, split_over).collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 6 or labels(fps, near_pairs(fps))[fps.index(a)] == labels(fps, near_pairs(fps))[fps.index(b)] for _, a, b in got)
    for seed, own in ((0, fps), (3, fps[:20])):
        assert labels(own, [(a, b) for s, a, b in got if s == seed]) == labels(own, list(near_pairs(own)))


def test_chains_meet_at_every_length():
    rng = random.Random(8)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        fp = np.array([x, y], np.uint64)
        rows, keys = neardup.chain_keys(fp)
        rest = np.zeros(len(keys), np.uint64)
        for length in (2, 3, 4):
            if length > 2:
                at, more = neardup.longer_chains(keys, rest, fp[rows], length)
                rows, keys, rest = rows[at], keys[at], more
            own = [set(zip(keys[rows == i].tolist(), rest[rows == i].tolist())) for i in (0, 1)]
            assert own[0] & own[1], length


def test_word_and_shingle_hashes():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abC \t\n\x0bé") for _ in range(rng.randint(0, 60))).encode() for _ in range(200)] + [b"", b"  ", b"x" * 100 + b" Y"]
    edge = np.r_[0, np.cumsum([len(b) for b in texts])]
    h, text = neardup.word_hashes(np.frombuffer(b"".join(texts), np.uint8), edge)
    sh, at = neardup.shingle_runs(h, text, len(texts))
    import re

    words, runs, k = {}, {}, 0
    for i, b in enumerate(texts):
        ws = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", b)]
        for w in ws:
            assert text[k] == i and words.setdefault(w, h[k]) == h[k]
            k += 1
        want = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)] or [tuple(ws)]
        assert len(want) == at[i + 1] - at[i] and all(runs.setdefault(a, x) == x for a, x in zip(want, sh[at[i] : at[i + 1]]))
    assert k == len(h) and len(set(words.values())) == len(words) and len(set(runs.values())) == len(runs)
    flat, cut = neardup.distinct_runs(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert flat.tolist() == [1, 3, 2] and cut.tolist() == [0, 2, 2, 3]


def test_votes_are_those_of_each_bit():
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 1 << 64, 250_000, np.uint64)
    edge = np.r_[0, np.sort(rng.integers(0, 40_000, 60)), 40_000, 200_000, 200_000, 250_000]
    for a, b, fp in zip(edge, edge[1:], simhash.vote_arrays(flat, edge[:-1], edge[1:])):
        assert all((int(fp) >> i & 1) == (2 * int((flat[a:b] >> np.uint64(i) & np.uint64(1)).sum()) > b - a) for i in range(64))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 50, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    texts = [" ".join(words), " ".join(near), "unrelated text of its own here", " ".join(words), "", None, " \n"]
    ids = [40, 10, 30, 20, 7, 8, None]
    df = docs(spark, texts, ids, component_id="x", fp=1)
    got = {(r.doc_id): r.component_id for r in neardup.near_duplicates(df.drop("component_id", "fp")).collect()}
    assert got[40] == got[20] and got[30] == 30 and got[7] == got[8] == got[None] == 7
    left = neardup.one_per_group(df).collect()
    assert sorted(r.doc_id for r in left) == [7, 10, 30] and left[0].component_id == "x"
    assert neardup.one_per_group(df.limit(0)).count() == 0 and neardup.near_duplicates(df.select("doc_id", "text").limit(0)).count() == 0
    twice = docs(spark, ["same row text"] * 3, [1, 1, 1])
    assert neardup.one_per_group(twice).count() == 1


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(6)
    sets, rows = {}, []
    for root in "ab":
        base = rng.sample(range(10_000), 60)
        for k in range(40):
            s = set(base[:50])
            for _ in range(rng.choice([0, 2, 4, 12])):
                s.discard(rng.choice(base))
                s.add(rng.randrange(10_000))
            sets[f"{root}{k:02d}"] = s
            rows.append((root, k // 2, f"{root}{k:02d}", sorted(s)))
    df = spark.createDataFrame(rows, "root string, id long, key string, sh array<long>").repartition(3)
    order = {k: (i, k) for _, i, k, _ in rows}
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    stay = []
    for k in sorted(sets, key=order.get):
        if not any(s[0] == k[0] and alike(s, k) for s in stay):
            stay.append(k)
    assert {r.key for r in neardup.near_copies(df).collect()} == set(sets) - set(stay)
    for chunk in (200, 700):
        gone = {r.key for r in neardup.near_copies(df, chunk).collect()}
        left = set(sets) - gone
        assert not any(x != y and x[0] == y[0] and alike(x, y) for x in left for y in left)
        assert all(any(order[s] < order[g] and s[0] == g[0] and alike(s, g) for s in sets) for g in gone)


def test_unlike_texts_of_a_large_group_do_not_meet(spark):
    """20,000 texts of one candidate group that share half their shingles, 40 like pairs among them: only those meet."""
    rng = random.Random(15)
    shared = list(range(10))
    rows, pairs = [], set()
    for i in range(20_000):
        own = [rng.randrange(1 << 40) + 100 for _ in range(10)]
        rows.append((1, i, f"k{i:05}", shared + own))
        if i < 40:
            pairs.add((f"k{i:05}", f"m{i:05}"))
            rows.append((1, 50_000 + i, f"m{i:05}", shared + own[:9] + [rng.randrange(1 << 40) + 100]))
    df = spark.createDataFrame(rows, "root long, id long, key string, sh array<long>").repartition(8)
    assert {(r.key, r.later) for r in neardup.meeting(df).collect()} == pairs
    assert {r.key for r in neardup.near_copies(df, chunk=2_000).collect()} == {b for _, b in pairs}


def test_near_copies_do_not_depend_on_chunks(spark):
    # Chains: each text is like the next one only, so every second one stays.
    rows = [("abc"[c], i, f"{'abc'[c]}{i:02d}", list(range(1000 * c + 10 * i, 1000 * c + 10 * i + 100))) for c in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "root string, id long, key string, sh array<long>").repartition(3)
    want = {r[2] for r in rows if r[1] % 2}
    for chunk in (10_000, 350, 100):
        assert {r.key for r in neardup.near_copies(df, chunk).collect()} == want, chunk
    links = [(f"k{i}", f"k{i + 1}") for i in range(9)] + [("k0", "k5")]
    assert {r.key for r in neardup.first_come(spark.createDataFrame(links, "key string, later string")).collect()} == {"k1", "k3", "k5", "k7", "k9"}
    assert neardup.first_come(spark.createDataFrame([], "key string, later string")).count() == 0


def test_copies_with_words_added_go(spark):
    rng = random.Random(12)
    zipf = [f"w{int(1 / (1e-4 + rng.random()))}" for _ in range(20_000)]
    texts = []
    for k in range(60):
        base = rng.sample(zipf, rng.choice([60, 300, 900]))
        more = rng.sample(zipf, int(len(base) * (0.1, 0.15, 0.2)[k % 3]))
        texts += [" ".join(base), " ".join(base + more if k % 2 else more + base)]
    left = {r.doc_id for r in neardup.one_per_group(docs(spark, texts)).collect()}
    assert left == set(range(0, 120, 2))


def test_band_keys_meet_with_the_similarity():
    rng = np.random.default_rng(3)
    pools = [rng.integers(0, 1 << 63, 110, np.uint64) for _ in range(200)]
    sets = [s for p in pools for s in (p[:100], p[10:])]
    keys = neardup.band_keys(np.concatenate(sets), np.arange(len(sets)) * 100)
    shared = (keys[::2] == keys[1::2]).mean()
    assert abs(shared - (90 / 110) ** neardup.ROWS) < 0.03 and (keys[::2] == keys[1::2]).any(axis=1).all()
    assert not (keys[:-2:2] == keys[2::2]).any()


# --- 5: token counts --------------------------------------------------------------


def test_token_tree():
    encode = tokencount._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    for k in range(500):
        alpha = ("ab c  \n\té'st1,. \x1c", "a日本1'²½s!_\x1c", "ab1'S,.'s't'll<>")[k % 3]
        s = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 200)))
        tree = tokencount.TokenTree(s, encode, rng.choice([4, 16, 50]))
        for _ in range(5):
            a, b = rng.randint(0, len(s) + 2), rng.randint(0, len(s) + 2)
            new = "".join(rng.choice(alpha) for _ in range(rng.choice([0, 1, 3, 40])))
            tree.edit(a, b, new)
            a = min(a, len(s))
            s = s[:a] + new + s[max(a, min(b, len(s))) :]
            assert tree.text() == s and tree.n_chars == len(s) and tree.n_tokens == len(encode(s))


@pytest.mark.parametrize("where", ["end", "start", "middle", "anywhere"])
def test_a_token_tree_grows_with_its_text(where):
    """After thousands of inserts the edit of a character still encodes under four leaves."""
    encode = tokencount._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng, tree, size = random.Random(7), tokencount.TokenTree("short", encode, 64), 64
    for i in range(10_000 if where == "end" else 2_000):
        at = {"end": tree.n_chars, "start": 0, "middle": tree.n_chars // 2, "anywhere": rng.randint(0, tree.n_chars)}[where]
        tree.edit(at, at, f" some words {i}")
    assert max(map(len, tree.leaf)) < 2 * size and sum(map(bool, tree.leaf)) < 4 * tree.n_chars / size
    for at in (0, 1, tree.n_chars // 3, tree.n_chars - 1):
        before = tree.encoded_chars
        tree.edit(at, at + 1, "x")
        assert tree.encoded_chars - before < 4 * size
    assert tree.n_tokens == len(encode(tree.text())) and tree.n_chars == len(tree.text())
    tree.edit(50, tree.n_chars - 50, "")
    tree.edit(40, 60, "")
    assert tree.n_tokens == len(encode(tree.text())) and tree.n_chars == 80
    tree.edit(0, 80, "")
    assert (tree.n_tokens, tree.n_chars, tree.text()) == (0, 0, "")
    tree.edit(0, 0, "again " * 300)
    assert tree.n_tokens == len(encode("again " * 300))


def test_token_counts(spark):
    long = "some words and more " * 20_000
    df = docs(spark, [None, "", long, "a b"])
    edit = F.array(F.struct(F.lit(3).alias("start"), F.lit(None).cast("int").alias("end"), F.lit("X y").alias("new")))
    call = lambda e: sorted((r.doc_id, *r.c) for r in df.select("doc_id", tokencount.count_tokens(F.col("text"), e, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("c")).collect())
    got, encode = call(edit), tokencount._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, t in enumerate(["", "", long, "a b"]):
        new = t[:3] + "X y" + t[3:]
        assert got[i][1:5] == (len(t), len(encode(t)), len(new), len(encode(new)))
    assert got[2][5] < 5_000 < len(long)
    assert df.limit(0).select(tokencount.count_tokens(F.col("text"), edit, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0
    tight = tokencount.TokenTree("日本語テキスト。123;" * 2_000, encode)
    built = tight.encoded_chars
    tight.edit(9_000, 9_010, "x1y")
    assert tight.encoded_chars - built < 5_000 and tight.n_tokens == len(encode(tight.text()))
    assert [r[1:5] for r in call(F.lit(None).cast("array<struct<start:int,end:int,new:string>>"))] == [(r[1], r[2], r[1], r[2]) for r in got]


# --- 7: mixing ----------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 29 == 0 else "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None, "é"])) for i in range(400)] + [(3, "w w", "a")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copies": F.lit(5), "_row": F.lit(1), "size": F.lit("x")}).repartition(5)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(2)).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r["copies"], r._row) for r in rs)
    assert len(got) == len(rows) and key(got) == key(again)
    total, per = sum(len((t or "").split()) for _, t, _ in rows), {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and (r["size"] or r["copies"] == 0)
        s = per.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r["size"] * r["copies"]
    assert abs(sum(s[2] for s in per.values()) - total) < 1e-6 * total
    assert all(s[0] == s[3] and s[2] <= 3 * s[3] + 1e-9 and abs(s[1] - s[2]) <= 0.1 * s[2] for s in per.values())
    assert mixing.mix(df.limit(0)).count() == 0 and {r["copies"] for r in mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 3.0 and abs(got["b"] / got["c"] - 2 / 3) < 1e-12 and got[None] == 30.0 and abs(sum(got.values()) - 211) < 1e-9


# --- 8: URLs ------------------------------------------------------------------------


def test_url_filter(spark):
    listed = [(r.host, r.path, r.verdict, r.is_rule) for r in url_list(spark).collect()]
    hosts = ["example.org", "a.example.org", "xexample.org", "org", "ORG", "b.com", "m.ads-track.example.com", "x.net", ""]
    tails = ["", "/", "/es/x", "/en/12", "/en/2?u=/es/", "/fr/", "#/de/", "/de/1#x", "?q"]
    us = [f"http://{h}{t}" for h in hosts for t in tails] + [None, "", "no-scheme", "://org/", "a://org/es/://com/fr/"] * 2
    df = spark.createDataFrame(list(enumerate(us)), "page_id long, url string").withColumns({"rule": F.lit(1), "_row": F.lit(2)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, url_list(spark)).collect()}
    assert len(got) == len(us)
    for i, u in enumerate(us):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        fit = [x for x in listed if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: (x[3], len(x[0] + x[1]), len(x[0])), default=None)
        assert got[i] == (host, path, best[0] + best[1] if best and best[3] else None, best[2] if best else "allow"), u
    assert urlfilter.judge(df.limit(0), url_list(spark)).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, url_list(spark).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("chars", [16 << 20, 0])
def test_url_filter_on_a_long_list_and_long_urls(spark, monkeypatch, chars):
    monkeypatch.setattr(urlfilter, "BROADCAST_CHARS", chars)
    listed = url_list(spark)
    assert listed.count() > 100_000
    long = "a." * 200_000 + "listed-7.example"
    us = [f"http://{long}/x", "http://m.listed-49999.example/", "http://listed-50000.example/p/100000", "http://listed-0.example", "http://x.org/" + "p" * 300_000, None]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string"), listed).collect()}
    assert got == {0: (None, "block"), 1: (None, "block"), 2: (None, "allow"), 3: (None, "block"), 4: ("org/", "allow"), 5: (None, "allow")}
    assert urlfilter.candidate_keys("a.b.c", "/xy", [(1, 0), (1, 2), (3, 1), (4, 0), (2, 9)]) == ["c", "c/x", "a.b.c/"]
    bloom, _, _ = urlfilter.build_filter(listed)
    hits = bloom.might_hold([f"unlisted-{i}.example" for i in range(50_000)]).mean()
    assert hits < 0.02


def test_bloom_has_no_false_negatives():
    bloom, keys = urlfilter.BlockedBloom(5_000), [f"h{i}/p" for i in range(5_000)]
    bloom.add(keys)
    assert bloom.might_hold(keys).all() and bloom.might_hold([f"x{i}" for i in range(20_000)]).mean() < 0.05


# --- 9: packing ---------------------------------------------------------------------


@pytest.mark.parametrize("groups", [1, 4, 32])
def test_plan_places_every_length_once(groups):
    rng = random.Random(groups)
    for _ in range(80):
        cap = rng.choice([10, 64, 300])
        h = {}
        for _ in range(rng.randint(0, 30)):
            h[rng.randint(1, cap)] = rng.choice([1, 2, 3, 50, 1000])
        plan, got = packing.make_plan(h, cap, groups), {}
        for n, room, entries in plan.blocks:
            at = 0
            for x, r, off in entries:
                assert off == at
                at += x
                got.setdefault(x, []).append((r, n))
            assert at + room == cap and room >= 0 and n > 0
        for x, n in h.items():
            r = 0
            for a, k in sorted(got[x]):
                assert a == r
                r += k
            assert r == n
        assert set(got) == set(h)


ADDED = ["<|ENDOFTEXT|>", "x <|EndOfText|> y", "A<|ENDOFTEXT|>.", "A<|endoftext|>B. Don'T", "<|StartOfText|><|startoftext|>", "<| endoftext |> É<|"]


def test_ids_are_the_tokenizers_own():
    path = P.path("word_bpe_49k.json")
    tok, rng = tokenizers.Tokenizer.from_file(path), random.Random(19)
    alphabet = ["<|", "|>", "endoftext", "ENDOFTEXT", "startOfText", "<|endoftext|>", " ", "A", "z", "É", "ß", ".", "'S", "'t", "\x00", "\x1c", "\xa0", "\u0301", "K", "7", "\n"]
    texts = ADDED + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4_000)]
    for t, ids in zip(texts, packing.encode_batch(texts, path)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("rank_rows", [100_000, 3])
def test_packing_round_trip(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    path = P.path("word_bpe_49k.json")
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "Don't STOP... now, a.b,c é ΣΑΣ Σ. <|endoftext|> x\x1cy\xa0z", "word, " * 9_000, *ADDED] + [" ".join(rng.choice(["alpha", "Béta,", "x1", "gamma."]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    df = docs(spark, texts + texts[3:5], [*range(len(texts)), 3, 4], piece=1, offset=2)
    rows = packing.pack(df, path).collect()
    tok, want = tokenizers.Tokenizer.from_file(path), []
    for i, t in [*enumerate(texts), (3, texts[3]), (4, texts[4])]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.1 * sum(w[3] for w in want) / 2048 + 2 and packing.pack(df.limit(0), path).count() == 0


# --- 10: repeats --------------------------------------------------------------------


def brute_repeats(texts, n):
    data, seen = [(t or "").encode() for t in texts], {}
    for b in data:
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = seen.get(b[p : p + n], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_blind_trie_and_deep_shallow():
    rng = random.Random(10)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(rng.randint(1, 40))]
        order, lcp = suffixes.blind_trie(strings)
        assert [strings[i] for i in order] == sorted(strings)
        common = lambda x, y: next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        assert lcp[1:] == [common(strings[order[k]], strings[order[k - 1]]) for k in range(1, len(order))]
        buf = bytes(rng.choice(b"ab") for _ in range(120))
        starts, group = np.arange(97), np.repeat([0, 1], [40, 57])
        order, lcp = suffixes.deep_shallow(buf, starts, group, 24, 16)
        want = sorted(range(97), key=lambda i: (group[i], buf[i : i + 24]))
        assert [buf[i : i + 24] for i in order] == [buf[i : i + 24] for i in want]
        for k in range(1, 97):
            i, j = order[k], order[k - 1]
            assert lcp[k] == (common(buf[i : i + 24], buf[j : j + 24]) if group[i] == group[j] else 0)


@pytest.mark.parametrize("hot", [2_048, 1])
def test_repeats(spark, hot):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts = [None, "", "a" * 700, "ab" * 400, "c" * 199]
    for _ in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.6:
            a = rng.randint(0, 60)
            t += " " + rng.choice(passages)[a : a + rng.randint(150, 400)] + " " + rng.choice(words)
        texts.append(t)
    texts += [texts[10], texts[10]]
    df = docs(spark, texts, kept="old", key=1, h=2, _text="z")
    out = sorted(suffixes.remove_repeats(df, hot_blocks=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "h").collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out] == brute_repeats(texts, 200) and {r.h for r in out} == {2}
    same = spark.createDataFrame([(1, "x y z " * 50)] * 2 + [(None, "q r s " * 60)], "doc_id long, text string")
    assert {r.n_removed for r in suffixes.remove_repeats(same).where("doc_id = 1").collect()} == {300}
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_repeats_of_equal_rows(spark):
    """Rows that are equal to the id, null ids too, beside texts that share a part of theirs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(400))
    texts = [long] * 12 + [long[300:700] + " other " + word()] * 3 + [word() + long[900:1150] + word(), long[:199], " ".join(word() for _ in range(80))]
    df = spark.createDataFrame([(None if i < 15 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int")
    for hot in (2_048, 0):
        out = suffixes.remove_repeats(df, hot_blocks=hot).orderBy("at").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out] == brute_repeats(texts, 200)


def test_repeated_ranges_of_equal_rows_are_kept_once(spark):
    text = " ".join(str(i * i) for i in range(2000))
    sizes = []
    for n in (2, 60):
        src = spark.range(n).select(F.lit(b"k").alias("key"), F.lit(text).alias("text"))
        (row,) = suffixes.repeated_ranges(src).collect()
        sizes.append(len(row.spans))
    assert sizes[0] == sizes[1]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from sluice.llm import common

    session = lambda master, conf=None, context=None: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context)
    )
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/")) == "hdfs://x" and common.shared_dir(session(master, None, "hdfs://y")) == "hdfs://y"
    assert common.shared_dir(session("local[4]")).startswith("file://")


def test_scratch_keeps_only_what_it_is_told(spark):
    from sluice.llm.common import materialise, scratch

    with scratch(spark) as keep:
        gone = materialise(spark.range(3), "a")
        kept = keep(materialise(gone, "b"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_sql_names_are_queries():
    from sluice.llm.queries import QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
