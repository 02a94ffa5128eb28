"""Pages from a server on this machine, and from a capture."""

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from sluice.sources import pages


class Site(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        began = time.monotonic()
        path = self.path
        if path == "/slow":
            time.sleep(1.5)
        status = {"/gone": 404, "/broken": 500}.get(path, 200)
        kind = "application/pdf" if path.endswith(".pdf") else "text/plain" if path == "/robots.txt" else "text/html; charset=utf-8"
        body = b"User-agent: *\nDisallow: /private\nCrawl-delay: 0\n" if path == "/robots.txt" else f"<p>é {path}</p>".encode()
        if path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page1")
            self.end_headers()
        else:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)
        Site.seen.append((self.headers["Host"], path, began, time.monotonic()))

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def ports():
    servers = [http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site) for _ in range(2)]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [s.server_address[1] for s in servers]
    for s in servers:
        s.shutdown()


def answers(df):
    return {r.url.split("/", 3)[3]: (r.http_status, r.html, r.problem) for r in df.collect()}


def test_a_server_is_read_host_by_host(spark, ports):
    Site.seen.clear()
    urls = [f"http://127.0.0.1:{p}/{x}" for p in ports for x in ("page1", "page2", "gone", "a.pdf", "moved")]
    df = spark.createDataFrame(list(enumerate(urls)), "ordinal long, url string")
    rows = pages.fetch(pages.capped(df, 30), delay=0.2, timeout=5).collect()
    assert len(rows) == 10 and {(r.url.rsplit("/")[-1], r.http_status, r.problem) for r in rows} == {
        ("page1", 200, None), ("page2", 200, None), ("gone", 404, "HTTP 404"), ("a.pdf", 200, "not HTML"), ("moved", 200, None)}
    assert all((r.html is None) == (r.problem is not None) for r in rows) and any(r.html == "<p>é /page1</p>" for r in rows)
    for port in ports:
        own = sorted((a, b) for h, path, a, b in Site.seen if h.endswith(str(port)) and path not in ("/moved",))
        # One request at a time to a host, 0.2 s after the one before (a redirect is followed at once).
        gaps = [own[i + 1][0] - own[i][1] for i in range(len(own) - 1)]
        assert all(g > 0.15 for g in gaps[:3]), gaps


def test_no_answer_is_a_row(spark, ports):
    urls = [f"http://127.0.0.1:{ports[0]}/slow", "http://127.0.0.1:1/none", f"http://127.0.0.1:{ports[0]}/broken"]
    got = answers(pages.fetch(pages.capped(spark.createDataFrame(list(enumerate(urls)), "ordinal long, url string"), 30), delay=0, timeout=0.5, retries=1))
    assert got["slow"][2] == "timeout" and "refused" in got["none"][2].lower() and got["broken"] == (500, None, "HTTP 500")


def test_robots_caps_and_the_data_source(spark, ports, tmp_path):
    base = f"http://127.0.0.1:{ports[1]}"
    df = spark.createDataFrame([(i, u) for i, u in enumerate([f"{base}/private/x", f"{base}/page1", f"{base}/page1", "no url", None, f"{base}/page3", f"{base}/page4"])], "ordinal long, url string")
    n = iter(range(9))

    def keep(rows):
        at = f"{tmp_path}/k{next(n)}"
        rows.write.parquet(at)
        return spark.read.parquet(at)

    got = answers(pages.fetch_politely(df, per_host=3, keep=keep, delay=0.0, timeout=5))
    assert got == {"private/x": (None, None, "forbidden by robots.txt"), "page1": (200, "<p>é /page1</p>", None), "page3": (200, "<p>é /page3</p>", None)}
    pages.register(spark)
    read = spark.read.format("web_pages").option("delay", "0").option("perHost", "2")
    rows = read.option("urls", " ".join(f"http://127.0.0.1:{p}/{x}" for p in ports for x in ("page1", "gone", "page9"))).load()
    assert rows.rdd.getNumPartitions() == 2 and answers(rows) == {"page1": (200, "<p>é /page1</p>", None), "gone": (404, None, "HTTP 404")}
    assert spark.read.format("web_pages").option("urls", "").load().count() == 0


def test_a_capture_is_read_with_the_same_gate(spark):
    urls = pages.capped(spark.createDataFrame([(0, "http://A/x"), (1, "http://A/y"), (2, "http://b/z"), (3, "http://b/w"), (4, "http://b/none")], "ordinal long, url string"), 9)
    kept = spark.createDataFrame([("http://A/x", 200, "Text/HTML; charset=x", "1"), ("http://A/y", 403, "text/html", "2"), ("http://b/z", None, "image/png", "3"), ("http://b/w", 200, None, "4")], "url string, http_status int, content_type string, html string")
    assert answers(pages.replay(urls, kept)) == {"x": (200, "1", None), "y": (403, None, "HTTP 403"), "z": (None, None, "not HTML"), "w": (200, None, "not HTML"), "none": (None, None, "not captured")}
    assert answers(pages.replay(urls, kept, html_only=False))["z"] == (None, "3", None)
    assert pages.replay(urls.where(F.lit(False)), kept).count() == 0
