"""Queries over pages against their SQL on pages that the smallest tables lack: cut references, shared addresses."""

import pytest

from sluice import registry

_LONG = "A text of some length, so that it counts as a page's body: " + "word " * 20


def page(k, title, url=None):
    body = f"<title>{title}</title></head><body><nav><a href=\"/x\">Menu</a></nav><article><h1>{title}</h1><p>{_LONG}{k} &quot;x&quot; &lt;cut&am</p></article><footer>&copy; 2020 &middot; all</footer></body></html>"
    return k, url or f"https://h{k}.example.org/en/{k}", f"<html><head>{body}"


PAGES = [
    page(1, "Cut at the end &amp"), page(2, "Said &quot;whole&quot; &amp; cut &quot"), page(3, "a &am"), page(4, "b &lt; &amp;amp; &amp;quot; &#65; R&D &copy;"),
    page(5, "One &amp; the same", "https://s.example.org/a#top"), page(7, "Other", "https://s.example.org/a#top"), page(8, "Third &amp", "https://s.example.org/a#top"),
    # A stored page whose like came first, one that comes first itself, and one that would be rejected.
    page(9, "First", "https://same.gov.rw/x"), page(24, "Second", "https://same.gov.rw/x"), page(48, "Alone", "https://alone.gov.rw/x"), page(57, "Alone again", "https://alone.gov.rw/x"), page(80, "None", "https://none.example.io/x"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["discovery_counters", "page_title", "page_fields", "portal_fields", "portal_fallbacks", "portal_scan"])
def test_pages_against_sql(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in registry.queries()[name](spark, tables).collect()) == want and want


def test_the_parser_reads_references_as_a_browser_does():
    from sluice.functions.htmldom import crawl_fields

    assert crawl_fields("<h1>a &amp</h1>")[0] == "a &" and crawl_fields("<h1>&lt;b&gt; &quot;</h1>")[0] == '<b> "'
