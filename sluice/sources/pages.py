"""Pages from the web, or from a capture of it: one row a URL asked for, failures included.

URLs are dealt out by host; a host is asked by one task, one URL after the other, with a
pause between.  Rows: url, host, ordinal, http_status, content_type, html, problem.  The
html is there only where nothing went wrong.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import robots

SCHEMA = "url string, host string, ordinal long, http_status int, content_type string, html string, problem string"
AGENT = "sluice-crawler/1.0"
#: Seconds between two requests to a host, seconds that a request may take, bytes read of a page.
DELAY, TIMEOUT, MOST_BYTES = 1.0, 20.0, 10_000_000
HTML_KINDS = ("text/html", "application/xhtml+xml")


def host(url: Column) -> Column:
    """Lower-cased host and port of a URL; empty if it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def problem(status: Column, content_type: Column, html_only: bool = True) -> Column:
    """What keeps an answer from being a page: an error status, or a content type that is not HTML (a missing one too); null if nothing."""
    bad = F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    if html_only:
        kind = F.lower(F.coalesce(content_type, F.lit("")))
        bad = bad.when(~(F.contains(kind, F.lit(HTML_KINDS[0])) | F.contains(kind, F.lit(HTML_KINDS[1]))), "not HTML")
    return bad


def capped(urls: DataFrame, per_host: int) -> DataFrame:
    """(url, host, ordinal) of the first ``per_host`` distinct URLs of each host by ordinal; URLs without a host are left out."""
    once = urls.where("url is not null").groupBy("url").agg(F.min("ordinal").alias("ordinal")).withColumn("host", host(F.col("url"))).where("host <> ''")
    place = F.row_number().over(Window.partitionBy("host").orderBy("ordinal", "url"))
    return once.withColumn("_n", place).where(F.col("_n") <= per_host).select("url", "host", "ordinal")


def replay(urls: DataFrame, captured: DataFrame, html_only: bool = True) -> DataFrame:
    """Rows of SCHEMA for ``urls`` (url, host, ordinal) from ``captured`` (url, http_status, content_type, html; one row a URL)."""
    kept = captured.select(F.col("url").alias("_url"), "http_status", "content_type", F.col("html").alias("_html"))
    rows = urls.join(kept, urls.url == F.col("_url"), "left")
    wrong = F.when(F.col("_url").isNull(), "not captured").otherwise(problem(F.col("http_status"), F.col("content_type"), html_only))
    return rows.select("url", "host", "ordinal", "http_status", "content_type", F.when(wrong.isNull(), F.col("_html")).alias("html"), wrong.alias("problem"))


# --- live -----------------------------------------------------------------------


def load(url: str, agent: str, timeout: float) -> tuple[int | None, str | None, str | None, str | None]:
    """(status, content type, body, problem) of one request; redirects are followed."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.5"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            kind, body = answer.headers.get("Content-Type"), answer.read(MOST_BYTES)
            return answer.status, kind, body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type"), None, None
    except TimeoutError:
        return None, None, None, "timeout"
    except (OSError, ValueError, LookupError) as e:
        reason = getattr(e, "reason", e)
        return None, None, None, "timeout" if isinstance(reason, TimeoutError) else f"{type(e).__name__}: {reason}"[:300]


def _answers(rows, agent: str, timeout: float) -> Iterator[tuple[tuple, float]]:
    """Answers to (url, host, ordinal, delay) in order, each with its delay: the pause between two requests to one host."""
    last: dict[str, float] = {}
    for url, at, ordinal, delay in rows:
        wait = last.get(at, 0.0) + delay - time.monotonic()
        if at in last and wait > 0:
            time.sleep(wait)
        status, kind, body, wrong = load(url, agent, timeout)
        # Only the host in turn is remembered: hosts come one after the other.
        last = {at: time.monotonic()}
        yield (url, at, ordinal, status, kind, body, wrong), delay


def fetch(urls: DataFrame, delay: float = DELAY, timeout: float = TIMEOUT, agent: str = AGENT, html_only: bool = True, retries: int = 0) -> DataFrame:
    """Rows of SCHEMA for ``urls`` (url, host, ordinal, optional delay in seconds): every host in one task, in order of ordinal.

    Requests that got no answer are made again ``retries`` times, after all others of their
    task.  The rows are asked for anew whenever they are computed: write them first.
    """
    pause = F.greatest(F.coalesce(F.col("delay").cast("double"), F.lit(0.0)), F.lit(delay)) if "delay" in urls.columns else F.lit(delay)
    dealt = urls.select("url", "host", F.col("ordinal").cast("long").alias("ordinal"), pause.alias("delay")).repartition("host").sortWithinPartitions("host", "ordinal", "url")

    def run(batches):
        again = []
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for answer, row_delay in _answers(rows, agent, timeout):
            if answer[6] and retries:
                again.append((*answer[:3], row_delay))
            else:
                yield _batch([answer])
        for left in range(retries, 0, -1):
            tried, again = again, []
            for answer, row_delay in _answers(tried, agent, timeout):
                if answer[6] and left > 1:
                    again.append((*answer[:3], row_delay))
                else:
                    yield _batch([answer])

    rows = dealt.mapInArrow(run, SCHEMA)
    wrong = F.coalesce("problem", problem(F.col("http_status"), F.col("content_type"), html_only))
    return rows.select("url", "host", "ordinal", "http_status", "content_type", F.when(wrong.isNull(), F.col("html")).alias("html"), wrong.alias("problem"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
    names = ("url", "host", "ordinal", "http_status", "content_type", "html", "problem")
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=list(names))


def fetch_politely(urls: DataFrame, per_host: int = 30, keep=None, **options) -> DataFrame:
    """``fetch`` of what robots.txt allows: the files are fetched first, rules and crawl delays hold, forbidden URLs are rows with a problem.

    ``keep`` writes a DataFrame and reads it back, so that no host is asked twice for its file.
    """
    agent = options.get("agent", AGENT)
    wanted = capped(urls, per_host)
    sites = wanted.select(robots.site(F.col("url")).alias("site"), "host").distinct().select(F.concat("site", F.lit("/robots.txt")).alias("url"), "host", F.lit(0).alias("ordinal"), "site")
    got = fetch(sites, **{**options, "html_only": False})
    files = got.select(F.regexp_replace("url", "/robots.txt$", "").alias("site"), "http_status", F.col("html").alias("body"))
    told = robots.judged(wanted, keep(files) if keep else files, agent)
    told = keep(told) if keep else told
    none = lambda kind: F.lit(None).cast(kind)
    refused = told.where("not allowed").select("url", "host", F.col("ordinal").cast("long").alias("ordinal"), none("int").alias("http_status"), none("string").alias("content_type"), none("string").alias("html"), F.lit("forbidden by robots.txt").alias("problem"))
    return fetch(told.where("allowed"), **options).unionByName(refused)


# --- as a data source ---------------------------------------------------------------


class _Host(InputPartition):
    def __init__(self, urls: list[tuple[str, str, int]]):
        super().__init__(urls)
        self.urls = urls


class PageReader(DataSourceReader):
    """A partition a host; for lists of URLs that the driver holds anyway.  Larger ones go through ``fetch``."""

    def __init__(self, options: dict):
        own = {k.lower(): v for k, v in options.items()}
        self.urls = [u for u in own.get("urls", "").split() if u]
        self.delay, self.timeout = float(own.get("delay", DELAY)), float(own.get("timeout", TIMEOUT))
        self.agent, self.most = own.get("agent", AGENT), int(own.get("perhost", 30))
        self.html_only = own.get("htmlonly", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list] = {}
        for i, u in enumerate(dict.fromkeys(self.urls)):
            at = urlsplit(u).netloc.rpartition("@")[2].lower()
            if at and len(hosts.setdefault(at, [])) < self.most:
                hosts[at].append((u, at, i, self.delay))
        # Spark needs one partition at least.
        return [_Host(urls) for urls in hosts.values()] or [_Host([])]

    def read(self, partition: _Host):
        for (url, at, ordinal, status, kind, body, wrong), _ in _answers(partition.urls, self.agent, self.timeout):
            if wrong is None and status is not None and status >= 400:
                wrong = f"HTTP {status}"
            elif wrong is None and self.html_only and not any(k in (kind or "").lower() for k in HTML_KINDS):
                wrong = "not HTML"
            yield url, at, ordinal, status, kind, None if wrong else body, wrong


class PageSource(DataSource):
    """``spark.read.format("web_pages").option("urls", "https://a https://b").load()``; options delay, timeout, agent, perHost, htmlOnly."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PageSource)
