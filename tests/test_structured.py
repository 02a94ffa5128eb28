"""VARIANT forms against the Python ones, link rows against the tree's."""

import json
import random

from pyspark.sql import functions as F

from sluice.functions import htmldom, jsonld, linktable
from sluice.operators import structured


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.25 and depth < 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind < 0.35 and depth < 4:
        return {"@graph": [value(rng, depth + 1) for _ in range(rng.randint(0, 3))], **item(rng)}
    return item(rng) if kind < 0.9 else rng.choice([None, 3, "text", True])


def item(rng):
    names = [" Acme  Ltd ", "", None, {"name": "Org"}, {"name": ""}, [{"x": 1}, {"name": "Deep"}], [["In", "lists"]], [], {}]
    out = {"@type": rng.choice(["JobPosting", "jobposting", ["X", "Article"], "Person", [], None])}
    for key in ("title", "headline", "name", "description", "validThrough", "expires", "dateModified"):
        if rng.random() < 0.4:
            out[key] = rng.choice(["", f"{key} {rng.randint(0, 9)}", "  spaced \n out ", None, 7, False])
    for key in ("hiringOrganization", "publisher", "author"):
        if rng.random() < 0.4:
            out[key] = rng.choice(names)
    return out


def test_variants_are_read_like_objects(spark):
    rng = random.Random(6)
    pages = [[json.dumps(value(rng)) if rng.random() < 0.9 else "{broken" for _ in range(rng.randint(1, 3))] for _ in range(150)]
    rows = [(i, k, s) for i, scripts in enumerate(pages) for k, s in enumerate(scripts)]
    got = {r.id: (r.title, r.description, r.deadline, r.organisation_name) for r in structured.structured(spark.createDataFrame(rows, "id int, ordinal int, json string")).collect()}
    filled = 0
    for i, scripts in enumerate(pages):
        want = tuple(jsonld.structured(scripts).values())
        filled += any(want)
        assert got.get(i, ("",) * 4) == want, scripts
    assert filled > 40


def test_rounds_follow_the_nesting_and_need_no_python(spark):
    deep = '[[[{"@graph": [[{"@type": "WebPage", "name": "in"}]], "@type": "Article", "name": "out"}]]]'
    df = spark.createDataFrame([(1, 0, deep), (2, 0, "no"), (3, 0, None)], "id int, ordinal int, json string")
    out = structured.structured(df)
    assert [tuple(r)[:2] for r in out.collect()] == [(1, "in")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert structured.structured(df.limit(0)).count() == 0


def test_search_answers_name_their_problem(spark):
    good = '{"web": {"results": [{"title": " A  b ", "url": " https://x ", "description": null}, {"title": "", "url": "https://y"}, {"title": "z", "url": "ftp://q"}, 5]}}'
    rows = [("a", 200, good), ("b", 200, "<html>"), ("c", 401, good), ("d", 403, ""), ("e", 429, None), ("f", 500, good), ("g", None, None), ("h", 200, "{}"), ("i", 200, '{"web": {"results": {}}}'), ("j", 200, None)]
    got = sorted((r.query, r.problem, r.title, r.url, r.description) for r in structured.search_answers(spark.createDataFrame(rows, "query string, http_status int, payload string")).collect())
    none = (None, None, None)
    assert got == [("a", None, "A b", "https://x", ""), ("b", "invalid JSON", *none), ("c", "unauthorised", *none), ("d", "forbidden", *none), ("e", "rate limited", *none),
                   ("f", "HTTP 500", *none), ("g", "timeout", *none), ("j", "invalid JSON", *none)]
    assert [r[0] for r in spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, (-3, 0, 5, 99))), structured.asked_count))).collect()] == [1, 1, 5, 20]


def test_links_as_a_table(spark):
    linktable.register(spark)
    texts = ["<a href=' /x '>One <b>two</b></a><a>no</a><a href>bare</a>", "<p><a href='u'>open <script>var x</script> to the end", "", None, "no links", "<a href='&amp;q'>&lt;b&gt;</a>" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "id int, html string").createOrReplaceTempView("pages_t")
    got = {}
    for r in spark.sql("SELECT id, a.* FROM pages_t, LATERAL page_links(html) a ORDER BY id, ordinal").collect():
        got.setdefault(r.id, []).append((r.ordinal, r.href, r.link_text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(a["ordinal"], a["href"], a["link_text"]) for a in htmldom.anchors(t or "")]


def test_what_is_json_is_what_the_standard_reader_takes(spark):
    texts = ["{}", "{}}", "1", "1],[2", "{} {}", "1,2", "],[", "", " ", " [1] ", "[1]]", "{\"a\":1}, \"b\":2", "nul", "null", "\"x\"", "{'a':1}", "[1,]", "01", "tru"]

    def takes(x):
        try:
            json.loads(x)
        except ValueError:
            return False
        return True

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ok for r in df.select("t", structured.parsed(F.col("t")).isNotNull().alias("ok")).collect()}
    assert got == {t: takes(t) for t in texts}
