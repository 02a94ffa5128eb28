"""Queries over keyed tables, streams, page sources, robots files and VARIANT answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_batch, queries_core, schemas, views
from .functions import linktable, robots
from .operators import structured, upsert
from .plans import scan
from .queries_core import as_of, now
from .session import shared_folder
from .sources import pages
from .sources.snapshots import KeyedTable
from .views import AS_OF, OPPORTUNITIES_SQL, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- keyed tables ------------------------------------------------------------------


@query(f"SELECT * EXCLUDE (action) FROM ({queries_batch.SQL['upsert_opportunities']})")
def upsert_keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """The upsert as a merge into a table of hash buckets, read back from its second generation."""
    table = KeyedTable(spark, shared_folder(spark, "opportunities"))
    table.create(views.opportunities(spark, d).where("id % 3 <> 0"), "source_url", 8, schemas.OPPORTUNITIES)

    def update(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert.upsert_opportunities(stored, batch, now(), as_of()).drop("action", "changed")

    table.merge(queries_batch._batch(spark, d), update, "batch", 0)
    return table.read().select("source_url", "organisation_name", "title", "deadline", "category", "match_score", "is_expired", "status")


#: Order lines as sightings of their order, one after the other; every third has no deadline.
_SIGHTINGS = f"""
    s AS (SELECT 'o/' || l_orderkey AS source_url, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
                 CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_suppkey % 5 * 300 - 600 AS INTEGER) END AS deadline FROM lineitem),
    e AS (SELECT source_url, status, deadline FROM opps WHERE id % 3 <> 0)"""


@query(f"""
    WITH RECURSIVE {OPPORTUNITIES_SQL}, {_SIGHTINGS}, k AS (
        SELECT source_url, 0 AS n, status, deadline FROM e
        UNION ALL SELECT DISTINCT s.source_url, 0, CAST(NULL AS VARCHAR), CAST(NULL AS DATE) FROM s WHERE s.source_url NOT IN (SELECT source_url FROM e)
    ), r AS (
        SELECT * FROM k
        UNION ALL
        SELECT r.source_url, s.n, CASE WHEN r.status IS NULL THEN CASE WHEN coalesce(coalesce(s.deadline, r.deadline) < DATE '{AS_OF}', false) THEN 'Expired' ELSE 'New' END
                 WHEN coalesce(coalesce(s.deadline, r.deadline) < DATE '{AS_OF}', false) AND r.status IN ('New', 'Seen', 'Interested') THEN 'Expired'
                 WHEN NOT coalesce(coalesce(s.deadline, r.deadline) < DATE '{AS_OF}', false) AND r.status = 'Expired' THEN 'New' ELSE r.status END, CAST(coalesce(s.deadline, r.deadline) AS DATE)
        FROM r JOIN s ON s.source_url = r.source_url AND s.n = r.n + 1
    )
    SELECT source_url, arg_max(status, n) AS status, max(n) > 0 AS seen FROM r GROUP BY source_url""")
def upsert_row_by_row(spark: SparkSession, d: str) -> DataFrame:
    """Every order line as a sighting of its order, applied as if one came after the other."""
    from pyspark.sql import Window

    li = read(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    deadline = F.when(F.col("l_partkey") % 3 != 0, F.date_add(F.to_date("l_shipdate"), (F.col("l_suppkey") % 5 * 300 - 600).cast("int")))
    rows = li.select(
        F.lit("t").alias("title"), F.lit("").alias("description"), F.lit("").alias("organisation_name"), F.lit("lines").alias("source_name"),
        F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("source_url"), deadline.alias("deadline"), n.cast("long").alias("ordinal"),
        F.lit("c").alias("category"), F.lit(1).alias("match_score"), F.lit("r").alias("match_reason"),
    )
    out = upsert.upsert_opportunities(views.opportunities(spark, d).where("id % 3 <> 0"), rows, now(), as_of(), row_by_row=True)
    return out.select("source_url", "status", (F.col("action") != "keep").alias("seen"))


@query(queries_batch.SQL["scan_health_fold"])
def health_stream(spark: SparkSession, d: str) -> DataFrame:
    """Scan events as a stream with keyed state into the sources' table."""
    from .streaming.listings import stream_health

    root = shared_folder(spark, "sources")
    KeyedTable(spark, root).create(views.sources(spark, d), "id", 8, schemas.SOURCES)
    parts = shared_folder(spark, "events")
    views.scan_events(spark, d).write.parquet(parts)
    stream = spark.readStream.schema(spark.read.parquet(parts).schema).parquet(parts)
    run = stream_health(stream, root, shared_folder(spark, "health"), late="60 days")
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    cols = ("id", "consecutive_failures", "total_opportunities_found", "is_active", "is_auto_disabled", "disabled_reason", "priority_score")
    return KeyedTable(spark, root).read().select(*cols)


@query(f"""
    SELECT 'portal' AS scanner, count(*) AS found, count_if(o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS relevant, count_if(o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0) AS saved,
           count_if(o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 <> 0) AS updated, count_if(o_orderkey % 7 = 0) AS classification_failures,
           count_if(o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS save_failures, CAST(NULL AS VARCHAR) AS problem FROM orders
    UNION ALL SELECT 'websites', NULL, NULL, NULL, NULL, NULL, NULL, 'failed'""")
def scan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A scan of all orders, half of them known, beside a scanner that fails while it runs."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    table = KeyedTable(spark, shared_folder(spark, "scanned"))
    table.create(views.opportunities(spark, d).where("id % 2 <> 0"), "source_url", 8, schemas.OPPORTUNITIES)
    rows = o.select(
        F.when(k % 7 != 0, F.concat(F.lit("Request for Proposal: External Audit Services "), k.cast("string"))).alias("title"),
        F.lit("Interested firms are invited. Submission deadline 12/03/2027. Technical proposal required.").alias("description"), F.lit("Acme").alias("organisation_name"),
        F.lit("orders").alias("source_name"), F.when(k % 5 != 0, F.concat(F.lit("o/"), k.cast("string"))).alias("source_url"), F.lit("2030-01-01").cast("date").alias("deadline"), k.alias("ordinal"),
    )
    broken = rows.withColumn("description", F.when(F.col("ordinal") % 3 == 0, F.raise_error(F.lit("no such page")).cast("string")).otherwise(F.col("description")))
    given = {"portal": lambda rows: rows, "websites": lambda rows: rows}
    inputs = {"portal": {"rows": rows}, "websites": {"rows": broken}}
    out = scan.scan_into(table, inputs, now(), as_of(), shared_folder(spark, "scan"), scanners=given)
    return out.withColumn("problem", F.when(F.col("problem").isNotNull(), "failed"))


# --- pages and robots files ----------------------------------------------------------

_SITE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_STATUS = "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END"
_KIND = "CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Text/HTML; charset=utf-8' WHEN 2 THEN NULL ELSE 'application/xhtml+xml' END"


@query(f"""
    WITH p AS (SELECT url, any_value(page_id) AS page_id, any_value(html) AS html FROM pages GROUP BY url HAVING count(*) = 1), g AS (
        SELECT url, page_id, html, page_id % 9 = 0 AS missing, {_STATUS} AS status, {_KIND} AS kind FROM p
    ), h AS (
        SELECT *, CASE WHEN missing THEN 'not captured' WHEN status >= 400 THEN 'HTTP 404' WHEN kind IS NULL OR kind = 'application/pdf' THEN 'not HTML' END AS problem FROM g
    )
    SELECT url, CASE WHEN NOT missing THEN CAST(status AS INTEGER) END AS http_status, CASE WHEN problem IS NULL THEN length(html) END AS n_chars, problem FROM h""")
def captured_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages asked for of a capture that lacks some and holds errors and other content types."""
    p, k = read(spark, d, "pages"), F.col("page_id")
    once = p.groupBy("url").agg(F.count("*").alias("n"), F.first("page_id").alias("page_id"), F.first("html").alias("html")).where("n = 1")
    asked = pages.capped(once.select("url", k.alias("ordinal")), 1 << 60)
    status = F.when(k % 7 == 0, 404).when(k % 7 != 1, 200)
    kind = F.when(k % 5 == 0, "application/pdf").when(k % 5 == 1, "Text/HTML; charset=utf-8").when(k % 5 > 2, "application/xhtml+xml")
    kept = once.where(k % 9 != 0).select("url", status.alias("http_status"), kind.alias("content_type"), "html")
    return pages.replay(asked, kept).select("url", "http_status", F.length("html").cast("long").alias("n_chars"), "problem")


_ROBOTS = {
    0: "# all\\nUser-agent: *\\nDisallow: /en/\\nAllow: /\\n", 1: "User-agent: other\\nDisallow: /\\n\\nUser-agent: Sluice\\nUser-agent: x\\nAllow: /de/\\nDisallow: /%64e\\nDisallow: /fr # no\\n\\nUser-agent: *\\nDisallow: /",
    2: "Disallow: /\\n\\nUser-agent: *\\n\\nDisallow: /\\n", 3: "User-agent: sluice-crawler\\nCrawl-delay: 5\\nDisallow:\\n\\nUser-agent: *\\nDisallow: /\\n",
}


@query(f"""
    WITH p AS (SELECT DISTINCT url, length({_SITE}) % 6 AS kind, {_SITE} AS site FROM pages), a AS (
        SELECT url, kind, CASE WHEN rest = '' THEN '/' ELSE rest END AS rest FROM (SELECT url, kind, substr(url, length(site) + 1) AS rest FROM p)
    )
    SELECT url, CASE kind WHEN 0 THEN NOT starts_with(rest, '/en/') WHEN 1 THEN starts_with(rest, '/de/') OR NOT (starts_with(rest, '/de') OR starts_with(rest, '/fr')) WHEN 4 THEN false ELSE true END AS allowed,
           CASE WHEN kind = 3 THEN 5 END AS delay FROM a""")
def robots_files(spark: SparkSession, d: str) -> DataFrame:
    """What robots files say of every page: for all, for us by name, rules without an agent, a delay alone, one that is closed, none."""
    p = read(spark, d, "pages").select("url").distinct()
    sites = p.select(robots.site(F.col("url")).alias("site")).distinct()
    kind = F.length("site") % 6
    body = F.coalesce(*[F.when(kind == k, F.lit(t.replace("\\n", "\n"))) for k, t in _ROBOTS.items()])
    files = sites.where(kind != 5).select("site", F.when(kind == 4, 403).otherwise(200).alias("http_status"), body.alias("body"))
    return robots.judged(p, files, pages.AGENT)


# --- structured answers -----------------------------------------------------------------


@query(r"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 4 = 3 THEN 'Inner ' || o_orderkey ELSE 'T ' || o_orderpriority END AS title,
           CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
           CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'Customer ' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'Org ' || o_custkey ELSE 'Deep ' || o_custkey END AS organisation_name
    FROM orders WHERE o_orderkey % 11 <> 0""")
def json_ld_variant(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD of every order: lists in lists, graphs, names as text, object or nested list, broken texts."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    who = F.col("o_custkey").cast("string")
    quoted = lambda x: F.to_json(F.struct(x.alias("x")))
    organisation = (
        F.when(k % 3 == 0, F.concat(F.lit('"Customer '), who, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('{"name": "Org '), who, F.lit('"}')))
        .otherwise(F.concat(F.lit('[{"x": 1}, [{"name": " Deep '), who, F.lit(' "}]]')))
    )
    title = F.regexp_extract(quoted(F.concat(F.lit("T  "), F.col("o_orderpriority"))), r'^\{"x":(.*)\}$', 1)
    one = F.concat(F.lit('{"@type": ["Thing", "JobPosting"], "title": "", "headline": '), title, F.lit(', "expires": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "publisher": '), organisation, F.lit("}"))
    inner = F.concat(F.lit('{"@graph": [[{"@type": "WebPage", "name": "Inner '), k.cast("string"), F.lit('"}], {"@type": "Person", "title": "no"}], "@type": "article", "title": '), title,
                     F.lit(', "validThrough": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "author": '), organisation, F.lit("}"))
    text = F.when(k % 11 == 0, F.concat(one, F.lit("}"))).when(k % 4 == 0, F.concat(F.lit("[[["), one, F.lit("]]]"))).when(k % 4 == 1, one).when(k % 4 == 2, F.concat(F.lit('[{"@type": "Person", "title": "no"}, '), one, F.lit("]"))).otherwise(inner)
    out = structured.structured(o.select(k.alias("id"), F.lit(0).alias("ordinal"), text.alias("json")))
    return out.select(F.col("id").alias("o_orderkey"), "title", "deadline", "organisation_name")


@query("""
    SELECT doc_id AS query, CASE doc_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unauthorised' WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'invalid JSON' END AS problem,
           CASE WHEN doc_id % 6 > 3 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS title FROM documents WHERE doc_id % 6 < 4 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def search_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a search answer, four in six of them failed in some way."""
    k = F.col("doc_id")
    item = F.struct(F.col("text").alias("title"), F.concat(F.lit("https://d.example/"), k.cast("string")).alias("url"))
    good = F.to_json(F.struct(F.struct(F.array(item).alias("results")).alias("web")))
    status = F.when(k % 6 == 1, 401).when(k % 6 == 2, 500).when(k % 6 > 2, 200)
    rows = read(spark, d, "documents").select(k.alias("query"), status.alias("http_status"), F.when(k % 6 == 3, F.concat(F.lit("<"), good)).otherwise(good).alias("payload"))
    return structured.search_answers(rows).select("query", "problem", "title")


@query(queries_core.SQL["link_extract"])
def link_table(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every page by the table function."""
    linktable.register(spark)
    p = read(spark, d, "pages")
    rows = spark.sql("SELECT p.page_id, a.href, a.link_text FROM {p} p, LATERAL page_links(p.html) a", p=p)
    return rows.groupBy("page_id", "href", "link_text").agg(F.count("*").alias("n"))
