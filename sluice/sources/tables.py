"""Captured pages, search payloads, seeds, state and JDBC tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import clean_text
from ..functions.urls import is_http

#: Search API payload: only what is read of it.
PAYLOAD = "web struct<results: array<struct<title: string, url: string, description: string>>>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` at ``path``: written beside it, then renamed over it, so readers see the old or the new file whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, aside = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    _, to = _fs(spark, path)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(aside.makeQualified(fs.getUri(), fs.getWorkingDirectory()), to.makeQualified(fs.getUri(), fs.getWorkingDirectory()), how)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a key."""
    if url.startswith(("postgres://", "postgresql://")):
        url = "jdbc:postgresql://" + url.split("://", 1)[1]
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def read_pages(spark: SparkSession, path: str, html_only: bool = True) -> DataFrame:
    """Captured pages (url, html, optional http_status and content_type) that loaded."""
    df = spark.read.parquet(path)
    if "http_status" in df.columns:
        df = df.where(F.col("http_status").isNull() | (F.col("http_status") < 400))
    if html_only and "content_type" in df.columns:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        df = df.where(F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml")))
    return df


def search_results(payloads: DataFrame, http_only: bool = False) -> DataFrame:
    """Rows (query, ordinal, title, url, description) of captured payloads (query, payload).

    Items that are no objects or lack a title or URL are left out.
    """
    body = payloads.select("query", F.from_json("payload", PAYLOAD).alias("p"))
    rows = body.select("query", F.posexplode("p.web.results").alias("ordinal", "r")).where("r is not null")
    rows = rows.select("query", "ordinal", clean_text("r.title").alias("title"), F.trim(F.coalesce("r.url", F.lit(""))).alias("url"), clean_text("r.description").alias("description"))
    rows = rows.where("title <> '' and url <> ''")
    return rows.where(is_http("url")) if http_only else rows


def response_problem(status: F.Column) -> F.Column:
    """What a search response's status means; null for a good one."""
    return (
        F.when(status == 401, "unauthorised").when(status == 403, "forbidden").when(status == 429, "rate limited")
        .when(status.isNull(), "timeout").when((status < 200) | (status >= 300), "request failed")
    )


def queries(spark: SparkSession, which: str = "search", first: int | None = None) -> DataFrame:
    """The configured search queries with their ordinal; the first n of them."""
    names = v.SEARCH_QUERIES if which == "search" else v.DISCOVERY_QUERIES
    return spark.createDataFrame(list(enumerate(names[:first])), "ordinal int, query string")


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(v.SEED_SOURCES, "organisation_name string, base_url string, monitor_url string, source_type string")


def parse_state(text: DataFrame) -> DataFrame:
    """Job state of JSON documents (value): a row a job; a broken document has none."""
    one = "struct<last_started: string, last_success: string, last_failure: string, status: string, last_error: string, duration_seconds: double>"
    doc = text.select(F.from_json("value", f"map<string, {one}>").alias("m"))
    rows = doc.select(F.explode("m").alias("job_name", "s"))
    ts = lambda c: F.try_to_timestamp(F.col(f"s.{c}")).alias(c)
    return rows.select("job_name", ts("last_started"), ts("last_success"), ts("last_failure"), "s.status", "s.last_error", "s.duration_seconds")


def write_state(rows: DataFrame, path: str) -> None:
    """Job state as one JSON document, moved into place whole; a row a job, so it comes to the driver."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    told = rows.select("job_name", F.to_json(F.struct(stamp("last_started"), stamp("last_success"), stamp("last_failure"), "status", "last_error", "duration_seconds")).alias("s"))
    states = {r.job_name: json.loads(r.s) for r in told.orderBy("job_name").collect()}
    replace_file(rows.sparkSession, path, json.dumps(states))
