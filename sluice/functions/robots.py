"""robots.txt: captured files to ordered rules, and what they say of URLs.

A file is read line by line: user-agent lines open an entry, rule lines follow, an
empty line or the next user-agent line behind a rule ends it.  All of it is column
expressions and one window over a file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_EDGES = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
RULES = "array<struct<path:string,allow:boolean>>"


def unquote(x: Column) -> Column:
    """%XX decoded as UTF-8; what is no such pair stays."""
    kept = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(kept)


def quote(x: Column) -> Column:
    """All but letters, digits and ``/_.-~`` as %XX of UTF-8."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tidy(x: Column) -> Column:
    """Without an empty query or fragment's mark."""
    return F.regexp_replace(F.regexp_replace(x, r"^([^#]*?)\?(?=#|$)", "$1"), "#$", "")


def asked(url: Column) -> Column:
    """What a rule is held against: path, query and fragment of a URL, decoded and quoted again; ``/`` for none."""
    rest = F.regexp_replace(F.regexp_replace(unquote(url), r"[\t\r\n]", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?", "")
    return F.coalesce(F.nullif(quote(_tidy(rest)), F.lit("")), F.lit("/"))


def site(url: Column) -> Column:
    """scheme://host of a URL: the site whose robots.txt counts."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def entries(files: DataFrame) -> DataFrame:
    """Entries of robots files (site, body): site, entry, agents, rules (in order: path quoted, allow), delay.

    Entries without a rule line are none.  A forbidding rule without a path allows all.
    Null and empty files have no entries; a site is one row of ``files``.
    """
    lines = files.select("site", F.posexplode(F.split("body", _LINE)).alias("pos", "raw"))
    bare = F.regexp_replace(F.regexp_replace("raw", "#.*$", ""), _EDGES, "")
    cut = lines.withColumn("line", bare).withColumn("key", F.regexp_replace(F.lower(F.substring_index("line", ":", 1)), _EDGES, ""))
    said = unquote(F.regexp_replace(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")), _EDGES, ""))
    has = F.contains("line", F.lit(":"))
    kind = (
        F.when(F.col("raw") == "", "blank").when(has & (F.col("key") == "user-agent"), "agent")
        .when(has & F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    told = cut.withColumns({"kind": kind, "value": said}).where("kind is not null")
    order = Window.partitionBy("site").orderBy("pos")
    told = told.withColumn("before", F.lag("kind").over(order))
    told = told.withColumn("entry", F.sum(F.when((F.col("kind") == "agent") & ~F.col("before").eqNullSafe("agent"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A rule counts if no empty line has come since the last user-agent line.
    told = told.withColumn("open", F.last(F.when(F.col("kind") != "rule", F.col("kind") == "agent"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rule = (F.col("kind") == "rule") & F.coalesce("open", F.lit(False))
    is_path = rule & F.col("key").isin("allow", "disallow")
    path = quote(_tidy(F.regexp_replace("value", r"[\t\r\n]", "")))
    one = F.struct("pos", path.alias("path"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"))
    days = F.regexp_extract("value", r"^[\s]*(\d{1,9})[\s]*$", 1)
    found = told.groupBy("site", "entry").agg(
        F.collect_list(F.when(F.col("kind") == "agent", F.col("value"))).alias("agents"), F.sort_array(F.collect_list(F.when(is_path, one))).alias("r"),
        F.max(F.when(rule & (F.col("key") == "crawl-delay") & (days != ""), F.struct("pos", days.cast("int").alias("d"))))["d"].alias("delay"), F.max(rule).alias("ruled"),
    )
    return found.where("ruled").select("site", "entry", "agents", F.transform("r", lambda x: F.struct(x["path"].alias("path"), x["allow"].alias("allow"))).cast(RULES).alias("rules"), "delay")


def policies(files: DataFrame, agent: str) -> DataFrame:
    """(site, rules, delay) that hold for ``agent``: of the first entry that names it, else of the first for ``*``.

    ``files``: site, http_status, body.  A file that may not be read (401, 403) or whose
    server fails (5xx) forbids all; other errors, and a file that did not come, allow all.
    """
    name = agent.split("/")[0].lower()
    any_agent = F.array_contains("agents", "*")
    ours = ~any_agent & F.exists("agents", lambda a: F.contains(F.lit(name), F.lower(a)))
    pick = F.struct((~ours).alias("other"), "entry", "rules", "delay")
    chosen = entries(files.where("http_status is null or http_status < 400")).where(ours | any_agent).groupBy("site").agg(F.min(pick).alias("p"))
    named = chosen.select("site", "p.rules", "p.delay")
    closed = files.where("http_status in (401, 403) or http_status >= 500").select("site", F.array(F.struct(F.lit("").alias("path"), F.lit(False).alias("allow"))).cast(RULES).alias("rules"), F.lit(None).cast("int").alias("delay"))
    return named.unionByName(closed)


def judged(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url) with ``allowed`` and ``delay``: the first rule that a URL starts with decides; without one it may be loaded.

    Rules join by site; a site with a third of all URLs is one row on the rules' side.
    """
    rules = policies(files, agent).withColumnsRenamed({"site": "_site", "rules": "_rules"})
    rows = urls.withColumns({"_at": site(F.col("url")), "_asked": asked(F.col("url"))}).join(rules, F.col("_at") == F.col("_site"), "left")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_asked"), r["path"])), F.lit(0))
    return rows.select(*urls.columns, F.coalesce(first["allow"], F.lit(True)).alias("allowed"), "delay")
