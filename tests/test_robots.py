"""robots files against the standard library's reader."""

import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from sluice.functions import robots

PATHS = ["/", "/a", "/a/b", "/private/", "/tmp?x=1", "/%7Ejoe/", "/~joe/", "/caf%C3%A9", "/café", "/a%2Fb", "", "/a b", "/q?", "/x#", "*", "/*.pdf", "/100%", "/a+b"]
AGENTS = ["*", "Sluice", "sluice-crawler", "OtherBot", "crawl", "SLUICE-CRAWLER/2.0"]


def body(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.random()
        if kind < 0.3:
            lines.append(rng.choice(["User-agent: ", "user-agent:", " User-Agent :  "]) + rng.choice(AGENTS))
        elif kind < 0.75:
            lines.append(rng.choice(["Disallow: ", "disallow:", "Allow: ", "ALLOW :"]) + rng.choice(PATHS) + rng.choice(["", "", " # why", "  "]))
        else:
            lines.append(rng.choice(["", "", "   ", "# remark", "Crawl-delay: 7", "crawl-delay: x", "Request-rate: 1/5", "Sitemap: /s.xml", "nonsense", "Host: x"]))
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_agrees_with_the_standard_reader(spark):
    rng = random.Random(4)
    files = [(f"https://h{i}.example", None, body(rng)) for i in range(250)]
    asked = [p for p in PATHS if p.startswith("/")] + ["", "/a/b/c?d=e#f", "/tmp?x=12", "/private", "/private/x", "/caf%c3%a9/menu", "/~joe/x", "/a%20b", "/a/"]
    rows = [(s, f"{s}{p}") for s, _, _ in files for p in asked]
    urls = spark.createDataFrame(rows, "s string, url string")
    got = {r.url: (r.allowed, r.delay) for r in robots.judged(urls, spark.createDataFrame(files, "site string, http_status int, body string"), "sluice-crawler/1.0").collect()}
    for s, _, text in files:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        for p in asked:
            want = parser.can_fetch("sluice-crawler/1.0", s + p)
            assert got[s + p][0] == want, (text, s + p, want)
        assert got[s][1] == parser.crawl_delay("sluice-crawler/1.0"), text


def test_what_a_missing_file_means(spark):
    files = [("http://a", 401, "x"), ("http://b", 404, "User-agent: *\nDisallow: /"), ("http://c", 503, None), ("http://d", None, None), ("http://e", 200, "User-agent: *\nDisallow: /")]
    urls = spark.createDataFrame([(f"http://{h}/x",) for h in "abcdef"] + [(None,), ("no url",)], "url string")
    got = {r.url: r.allowed for r in robots.judged(urls, spark.createDataFrame(files, "site string, http_status int, body string"), "sluice").collect()}
    assert got == {"http://a/x": False, "http://b/x": True, "http://c/x": False, "http://d/x": True, "http://e/x": False, "http://f/x": True, None: True, "no url": True}


@pytest.mark.parametrize("x", ["a b", "é😀", "/a+b", "100%", "%zz", "~_.-", "*", "", "a%2Fb"])
def test_quoting_is_the_standard_one(spark, x):
    from urllib.parse import quote, unquote

    df = spark.createDataFrame([(x,)], "x string").select(robots.quote(F.col("x")).alias("q"), robots.unquote(F.col("x")).alias("u"))
    assert tuple(df.first()) == (quote(x), unquote(x))
