"""Fields of pages: only what is asked for is worked out, selectors by their signs, small pieces."""

from sluice.functions import htmldom

PAGE = """<html><head><title>T</title><meta name=author content='Acme Ltd'><script type='application/ld+json'>{"@type": "Article", "headline": "L"}</script></head>
<body class="content x"><div class='job-title' id=a>Head</div><div CLASS="x job-title  company-name">Beta Ltd</div><main><h1>One</h1><p itemprop='name'>n</p></main></body></html>"""
SELECTORS = (*htmldom.CRAWL_TITLES, *htmldom.PORTAL_TITLES, *htmldom.PORTAL_ORGANISATIONS, *htmldom.META_ORGANISATIONS, htmldom.CRAWL_UNWANTED, "div#a, .x", ".x.company-name", "body .job-title, [itemprop]", "DIV")


def test_signs_pick_what_every_node_held_against_every_selector_picks():
    root = htmldom.parse(PAGE)
    every = [[n for n in root.walk() if any(htmldom._matches(n, c) for c in htmldom._compiled(s))] for s in SELECTORS]
    assert htmldom.gather(root, SELECTORS) == every and sum(map(bool, every)) > 10


def test_only_what_is_asked_for_is_worked_out(monkeypatch):
    whole = htmldom.portal_fields(PAGE)
    assert list(whole) == list(htmldom.PORTAL_FIELDS) and whole["meta_organisation"] == "Acme Ltd" and whole["ld_title"] == "L"
    held = []
    monkeypatch.setattr(htmldom, "_matches", lambda n, c, f=htmldom._matches: held.append(n) or f(n, c))
    monkeypatch.setattr(htmldom, "_description", None)
    monkeypatch.setattr(htmldom, "_labelled", None)
    assert htmldom.portal_fields(PAGE, ("ld_title", "ld_deadline")) == {"ld_title": "L", "ld_deadline": ""}
    assert [n.tag for n in held] == ["script"]


def test_fields_come_in_pieces_and_in_order(spark, values):
    n = htmldom.PIECE * 2 + 3
    got = values("h string", [(f"<h1>T {i}</h1>" + PAGE * (i % 5 == 0),) for i in range(n)], htmldom.crawl_page("h", "title")["title"], htmldom.page_links("h"))
    assert got == [(f"T {i}", []) if i % 5 else (got[i][0], []) for i in range(n)]
    df = spark.range(1).select(htmldom.crawl_page(htmldom.F.lit(PAGE), "title").alias("f"))
    assert df.schema["f"].dataType.names == ["title"]


def test_a_scans_listings_are_classified_once(spark, monkeypatch):
    import os

    import pytest

    from sluice import registry
    from sluice.operators import classify

    data, calls = "/root/testdata/sf0.001", []
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    monkeypatch.setattr(classify, "classify", lambda *a, f=classify.classify: calls.append(1) or f(*a))
    assert registry.queries()["scan_counters"](spark, data).count() == 2 and len(calls) == 1
