"""JSON-LD and search answers as VARIANT: parsed once in the JVM, taken apart in rounds until nothing nests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import clean_text, let

_LAST = 2**31 - 1
_LIST = "array<variant>"
#: Result -> the keys that may hold it, best first.
_KEYS = {
    "title": ("title", "headline", "name"), "description": ("description",), "deadline": ("validThrough", "expires", "dateModified"),
    "organisation_name": ("hiringOrganization", "publisher", "author"),
}
#: Lists in lists that a name is looked for in.
_NAME_DEPTH = 6


def _get(x: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, f'$["{key}"]', kind)


def _kind(x: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(x), r"^([A-Z]+)", 1)


def parsed(text: Column) -> Column:
    """A JSON text as a VARIANT, null if it is none; of a repeated key the last counts where the session allows them.

    The parser stops at a value's end and does not mind what follows.  In brackets and in braces at once
    nothing can follow: what closes the one early is an error in the other.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", _LIST)
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(held.isNotNull() & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def _string(x: Column) -> Column:
    """Text of a value: strings as they are, anything else as its JSON."""
    return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))


def _filled(x: Column) -> Column:
    """The value unless it is null, false, zero, or an empty text, list or object."""
    return F.when(x.isNotNull() & ~F.to_json(x).isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"), x)


def _name(x: Column) -> Column:
    """A name: of an object, the first found in a list, or a string itself; else empty."""
    some = F.array(x)
    for _ in range(_NAME_DEPTH):
        some = F.flatten(F.transform(some, lambda e: F.coalesce(F.try_variant_get(e, "$", _LIST), F.array(e))))

    def one(e: Column) -> Column:
        k = _kind(e)
        return F.when(k == "OBJECT", clean_text(_string(_get(e, "name")))).when(k == "STRING", clean_text(_string(e))).otherwise(F.lit(""))

    return F.coalesce(F.get(F.filter(F.transform(some, lambda e: F.coalesce(one(e), F.lit(""))), lambda t: t != ""), F.lit(0)), F.lit(""))


def objects(scripts: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """All objects of JSON texts (id, ordinal, json): id, place, item; members of lists and @graph before their parent.

    Each round opens what the one before has found, so there are as many rounds as the deepest
    text nests; ``keep`` holds a round's rows (persist, or write and read back).  Texts that are no JSON have no objects.
    """
    now = scripts.select("id", F.array(F.col("ordinal").cast("int")).alias("place"), parsed(F.col("json")).alias("item")).where("item is not null")
    out = None
    while True:
        members = F.coalesce(F.try_variant_get("item", "$", _LIST), _get(F.col("item"), "@graph", _LIST))
        now = keep(now.withColumn("kind", _kind(F.col("item"))).withColumn("members", members).where("kind in ('OBJECT', 'ARRAY')"))
        found = now.where("kind = 'OBJECT'").select("id", F.concat("place", F.array(F.lit(_LAST))).alias("place"), "item")
        out = found if out is None else out.unionByName(found)
        now = now.where("size(members) > 0").select("id", "place", F.posexplode("members").alias("i", "m"))
        now = now.select("id", F.concat("place", F.array("i")).alias("place"), F.col("m").alias("item"))
        if now.isEmpty():
            return out


def structured(scripts: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(id, title, description, deadline, organisation_name) of JSON-LD texts (id, ordinal, json): the first filled one of each field.

    Only objects of the supported types count; ids without one have no row.  A value that
    is no string counts as its JSON.
    """
    o = objects(scripts, keep)
    kind = _get(F.col("item"), "@type")
    kinds = F.transform(F.coalesce(F.try_variant_get(kind, "$", _LIST), F.array(kind)), lambda k: F.lower(_string(k)))
    o = o.where(F.arrays_overlap(F.coalesce(kinds, F.array()), F.array(*map(F.lit, v.SUPPORTED_JSON_TYPES))))
    values = {}
    for field, names in _KEYS.items():
        value = F.coalesce(*[_filled(_get(F.col("item"), n)) for n in names])
        # A name that stands in many places is worked out in each of them.
        values[field] = let(value, _name if field == "organisation_name" else lambda x: clean_text(_string(x)))
    rows = o.select("id", "place", *[x.alias(f) for f, x in values.items()])
    first = lambda f: F.coalesce(F.min_by(F.col(f), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("place"))), F.lit("")).alias(f)
    return rows.groupBy("id").agg(*[first(f) for f in _KEYS])


#: How many results a search may ask for.
MOST_RESULTS = 20


def asked_count(n: Column) -> Column:
    """A number of results within 1 and MOST_RESULTS."""
    return F.greatest(F.lit(1), F.least(n, F.lit(MOST_RESULTS)))


def search_answers(answers: DataFrame) -> DataFrame:
    """Rows of search answers (query, http_status, payload): query, problem, ordinal, title, url, description.

    An answer that failed has one row, its problem: unauthorised, forbidden, rate limited,
    timeout (no status), the status, or invalid JSON.  One without results has no row.  Items that are no objects, lack a
    title or URL, or whose URL is not http are left out.
    """
    from ..functions.urls import is_http

    status = F.col("http_status")
    known = answers.withColumn("body", parsed(F.col("payload")))
    problem = (
        F.when(status.isNull(), "timeout").when(status == 401, "unauthorised").when(status == 403, "forbidden").when(status == 429, "rate limited")
        .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.col("body").isNull(), "invalid JSON")
    )
    known = known.withColumn("problem", problem)
    none = [F.lit(None).cast(k).alias(n) for n, k in (("ordinal", "int"), ("title", "string"), ("url", "string"), ("description", "string"))]
    failed = known.where("problem is not null").select("query", "problem", *none)
    results = F.try_variant_get("body", "$.web.results", _LIST)
    rows = known.where("problem is null").select("query", "problem", F.posexplode(results).alias("ordinal", "r")).where(_kind(F.col("r")) == "OBJECT")
    field = lambda n: F.coalesce(_string(_filled(_get(F.col("r"), n))), F.lit(""))
    rows = rows.select("query", "problem", "ordinal", clean_text(field("title")).alias("title"), F.trim(field("url")).alias("url"), clean_text(field("description")).alias("description"))
    return failed.unionByName(rows.where((F.col("title") != "") & is_http("url")))
