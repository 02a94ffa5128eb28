"""URL pieces, normalisers and relevance as Column expressions.

Four normalisers exist and differ on purpose: repository (keeps sorted query,
drops www and tracking), quality (drops the query), crawl (keeps the query as
it is) and listing (host of a portal, path only).
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .text import c, clean_text, ends_with_any, filled, has_any, let, strip_tags, substring_hits

_PIECES = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _piece(url: Column | str, n: int) -> Column:
    return F.regexp_extract(filled(url), "(?s)" + _PIECES, n)


def scheme(url: Column | str) -> Column:
    return F.lower(_piece(url, 1))


def netloc(url: Column | str) -> Column:
    """Host with user and port, as written."""
    return _piece(url, 2)


def path(url: Column | str) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(_piece(url, 3), r";[^/]*$", "")


def query(url: Column | str) -> Column:
    return _piece(url, 4)


def is_http(url: Column | str) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def domain(host: Column | str, cut_dot: bool = True) -> Column:
    """Lower-case host without port, trailing dots and www."""
    out = F.element_at(F.split(F.lower(clean_text(host)), ":"), 1)
    out = F.regexp_replace(out, r"\.+$", "") if cut_dot else out
    return F.regexp_replace(out, r"^www\.", "")


def plain_domain(url: Column | str) -> Column:
    """Lower-case netloc without www."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def crawl_domain(host_or_url: Column | str) -> Column:
    x = F.lower(clean_text(host_or_url))
    host = F.element_at(F.split(F.when(F.contains(x, F.lit("://")), netloc(x)).otherwise(x), ":"), 1)
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.+$", "")


def _sorted_query(texts: pd.Series) -> pd.Series:
    drop = set(v.TRACKING_PARAMETERS)

    def one(q: str) -> str:
        if not q:
            return ""
        return urlencode(sorted((k, x) for k, x in parse_qsl(q, keep_blank_values=True) if k.lower() not in drop))

    return texts.map(one)


def repository_url(url: Column | str) -> Column:
    """Scheme (https if none), host without www, path without end slash, sorted query without tracking.

    The query is decoded and encoded again exactly, in an Arrow batch; the rest
    stays in the JVM.
    """
    u = F.trim(filled(url))
    sch = F.coalesce(F.nullif(scheme(u), F.lit("")), F.lit("https"))
    p = path(u)
    p = F.when((p == "") | (p == "/"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))
    host = plain_domain(u)
    q = F.pandas_udf(_sorted_query, "string")(query(u))
    rooted = F.when((p == "") | F.startswith(p, F.lit("/")) | (host == ""), p).otherwise(F.concat(F.lit("/"), p))
    base = F.concat(sch, F.when(host != "", F.concat(F.lit("://"), host)).otherwise(F.lit(":")), rooted)
    return F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def quality_url(url: Column | str) -> Column:
    """http(s) only: lower-case host, path without end slash, nothing after it; else ''."""
    u = strip_tags(url)
    ok = (F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))) & (netloc(u) != "")
    return F.when(ok, F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), F.regexp_replace(path(u), "/+$", ""))).otherwise(F.lit(""))


def crawl_url(url: Column | str) -> Column:
    """https if no scheme; lower-case host, path without end slash or '/', query kept; else ''."""
    def whole(u: Column) -> Column:
        u = F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)
        return F.when((u == "") | F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")), u).otherwise(F.concat(F.lit("https://"), u))

    def parts(u: Column) -> Column:
        p, q = F.regexp_replace(path(u), "/+$", ""), query(u)
        out = F.concat(
            scheme(u), F.lit("://"), F.lower(netloc(u)), F.when(p == "", F.lit("/")).otherwise(p),
            F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
        )
        return F.when((u != "") & (netloc(u) != ""), out).otherwise(F.lit(""))

    return let(let(clean_text(url), whole), parts)


def base_url(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def join_url(base: Column | str, href: Column | str) -> Column:
    """RFC 3986 resolution; ``..`` and the like make this an Arrow batch function."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(x or "", y or "")
            except ValueError:
                return ""

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, "string")(filled(base), filled(href))


def listing_url(portal: str, href: Column | str) -> Column:
    """A portal's listing: its address and the path only; '' without a path."""
    p = F.regexp_replace(path(join_url(F.lit(portal), href)), "/+$", "")
    return F.when(p == "", F.lit("")).otherwise(F.concat(F.lit(portal), p))


def is_listing(portal: str, href: Column | str) -> Column:
    """Does a link lead to one of the portal's listings?"""
    full = join_url(F.lit(portal), href)
    p = F.regexp_replace(path(full), "/+$", "")
    host = re.sub(r"^www\.", "", re.sub(r"^https?://", "", portal.lower()))
    return (
        (filled(href) != "")
        & (plain_domain(full) == host)
        & p.rlike(r"(?i)^/job/[a-z0-9][a-z0-9\-_/]*$")
        & ~F.lower(p).isin(*v.EXCLUDED_LISTING_PATHS)
    )


def page_url(section: Column | str, page: Column | str) -> Column:
    """The section itself, then ``page=n``."""
    sep = F.when(F.contains(c(section), F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(c(page) == 0, c(section)).otherwise(F.concat(c(section), sep, F.lit("page="), c(page).cast("string")))


def is_document(url: Column | str, extensions=v.CRAWL_DOCUMENT_EXTENSIONS) -> Column:
    return ends_with_any(F.lower(path(url)), extensions)


def is_ignored(url: Column | str) -> Column:
    """Search engines, social networks (exact hosts) and media files."""
    return plain_domain(url).isin(*v.IGNORED_DOMAINS) | ends_with_any(F.lower(path(url)), v.IGNORED_EXTENSIONS)


def is_blocked(host: Column | str, blocked=v.BLOCKED_DOMAINS) -> Column:
    """The host or a domain above it is blocked."""
    return F.exists(F.array(*map(F.lit, blocked)), lambda b: (c(host) == b) | F.endswith(c(host), F.concat(F.lit("."), b)))


def same_domain(a: Column | str, b: Column | str) -> Column:
    """Equal, or one below the other; empty hosts never."""
    below = lambda p, q: F.endswith(p, F.concat(F.lit("."), q))
    same = lambda s: (s["x"] != "") & (s["y"] != "") & ((s["x"] == s["y"]) | below(s["x"], s["y"]) | below(s["y"], s["x"]))
    return let(F.struct(crawl_domain(a).alias("x"), crawl_domain(b).alias("y")), same)


def monitor_url(url: Column | str) -> Column:
    """The page itself if its address looks relevant, else the site."""
    keep = has_any(F.lower(c(url)), v.HIGH_VALUE_PATHS)
    return F.regexp_replace(F.when(keep, c(url)).otherwise(base_url(url)), "/+$", "")


def url_relevance(url: Column | str) -> Column:
    """15 a path term, 20 for a telling end, 5 for any path; at most 100."""
    low = F.lower(c(url))
    score = (
        substring_hits(low, v.HIGH_VALUE_PATHS) * 15
        + F.when(ends_with_any(low, v.RELEVANT_URL_ENDINGS), 20).otherwise(0)
        + F.when(F.regexp_replace(path(url), "^/+|/+$", "") != "", 5).otherwise(0)
    )
    return F.least(score, F.lit(100)).cast("double")


def link_relevance(info: Column | str) -> Column:
    """1 a link term and 3 more a strong one, in lower-case link text and address."""
    return substring_hits(info, v.PAGE_LINK_TERMS) + substring_hits(info, v.STRONG_LINK_TERMS) * 3


def is_excluded_link(info: Column | str) -> Column:
    return has_any(info, v.EXCLUDED_LINKS)
