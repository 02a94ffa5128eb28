"""Keyed upserts: fold the batch to one row a key, then one outer join.

A batch's rows are folded with aggregates that combine on the map side; only
the fold and the join shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.dates import is_expired
from ..functions.text import organisation_name
from . import lifecycle


def fold_last(batch: DataFrame, key: str, filled_only: tuple[str, ...], ordinal: str = "ordinal") -> DataFrame:
    """One row per key: the last by ordinal; ``filled_only`` columns keep their last non-empty value."""
    rest = [c for c in batch.columns if c not in (key, ordinal)]
    aggs = []
    for c in rest:
        if c in filled_only:
            x = F.col(c)
            has = x.isNotNull() if dict(batch.dtypes)[c] != "string" else F.nullif(x, F.lit("")).isNotNull()
            aggs.append(F.max(F.when(has, F.struct(F.col(ordinal).alias("o"), x.alias("x"))))["x"].alias(c))
        else:
            aggs.append(F.max(F.struct(F.col(ordinal).alias("o"), F.col(c).alias("x")))["x"].alias(c))
    return batch.groupBy(key).agg(*aggs)


def fold_expiry(batch: DataFrame, key: str, as_of: Column, ordinal: str = "ordinal") -> DataFrame:
    """What a key's rows, one after the other, do to its expiry state: (key, _past, _undated).

    The machine's steps compose: a passed deadline takes an active status to Expired, one to come
    takes Expired to New, and a row without a deadline repeats the step before.  So a sequence
    comes down to its last step and to whether any step was a passed one: ``_past`` among the dated rows,
    and by the stored deadline if the sequence begins undated.  Aggregates that combine on the map
    side, whatever the length of a key's history.
    """
    return batch.groupBy(key).agg(
        F.coalesce(F.max(F.col("deadline") < as_of), F.lit(False)).alias("_past"), F.min(F.struct(ordinal, F.col("deadline").isNull().alias("u")))["u"].alias("_undated"),
    )


def upsert_opportunities(existing: DataFrame, batch: DataFrame, now: Column, as_of: Column, row_by_row: bool = False) -> DataFrame:
    """Opportunities after a scan, with ``action`` insert, update or keep and ``changed``.

    ``batch``: classified listings with ordinal.  Empty text and a null deadline
    leave the stored value; source_name, category, reason and score are
    replaced.  New rows are New or Expired by deadline.  A key's rows are folded to
    the last before the expiry rule; ``row_by_row`` applies the rule after each of them, as if they came one at a time.
    """
    clean = batch.withColumn("organisation_name", organisation_name("organisation_name"))
    new = fold_last(clean, "source_url", ("organisation_name", "title", "description", "deadline"))
    soft, hard = ("organisation_name", "title", "description", "deadline"), ("source_name", "category", "match_reason", "match_score")
    if row_by_row:
        new = new.join(fold_expiry(clean, "source_url", as_of), "source_url")
    steps = ("_past", "_undated") if row_by_row else ()
    n = new.select(F.col("source_url").alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*soft, *hard)], *steps)
    rows = existing.withColumn("_old", F.lit(True)).join(n, existing.source_url == F.col("_k"), "full_outer")
    old, met = F.col("_old").isNotNull(), F.col("_k").isNotNull()
    both, fresh = old & met, ~old
    value = {c: F.when(met, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")) if c != "deadline" else F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in soft}
    value |= {c: F.when(met, F.col(f"_{c}")).otherwise(F.col(c)) for c in hard}
    rows = rows.withColumns({f"v_{c}": x for c, x in value.items()})
    before = F.col("status")
    if row_by_row:
        passed = F.col("_past") | (F.col("_undated") & is_expired("deadline", as_of))
        before = F.when(passed & before.isin(*v.ACTIVE_STATUSES), "Expired").otherwise(before)
    gone, status = lifecycle.expiry_columns(as_of, F.col("v_deadline"), before)
    rows = rows.withColumns({
        "v_is_expired": F.when(fresh, is_expired("v_deadline", as_of)).when(both, gone).otherwise(F.col("is_expired")),
        "v_status": F.when(fresh, F.when(is_expired("v_deadline", as_of), "Expired").otherwise("New")).when(both, status).otherwise(F.col("status")),
    })
    moved = F.lit(False)
    for c in (*soft, *hard, "is_expired", "status"):
        moved = moved | ~F.col(f"v_{c}").eqNullSafe(F.col(c))
    stamp = {"first_discovered_at": fresh, "last_seen_at": met, "updated_at": met, "created_at": fresh}
    out = []
    for c in existing.columns:
        if f"v_{c}" in rows.columns:
            x = F.col(f"v_{c}")
        elif c == "source_url":
            x = F.coalesce(F.col(c), F.col("_k"))
        elif c in stamp:
            x = F.when(stamp[c], now).otherwise(F.col(c))
        elif c == "is_lead":
            x = F.coalesce(F.col(c), F.lit(False))
        else:
            x = F.col(c)
        out.append(x.alias(c))
    action = F.when(fresh, "insert").when(both, "update").otherwise("keep")
    return rows.select(*out, action.alias("action"), (fresh | (both & moved)).alias("changed"))


def upsert_sources_by_url(existing: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Repository upsert on monitor_url: best confidence, missing name and unknown type are filled; new rows await approval.

    ``batch``: monitor_url, base_url, domain, organisation_name, source_type,
    discovered_from, discovery_query, confidence_score, ordinal.
    """
    b = batch.withColumn("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit("Unknown")))
    head = F.struct("ordinal", "base_url", "domain", "discovered_from", "discovery_query")
    named = lambda c, ok: F.min(F.when(ok, F.struct("ordinal", F.col(c).alias("x"))))["x"]
    new = b.groupBy("monitor_url").agg(
        F.min(head).alias("_h"), F.max("confidence_score").alias("_c"),
        named("source_type", F.col("source_type") != "Unknown").alias("_t"),
        named("organisation_name", F.nullif("organisation_name", F.lit("")).isNotNull()).alias("_o"),
    ).withColumnRenamed("monitor_url", "_k")
    rows = existing.withColumn("_old", F.lit(True)).join(new, existing.monitor_url == F.col("_k"), "full_outer")
    fresh = F.col("_old").isNull()
    return _project_sources(rows, existing.columns, {
        "monitor_url": F.coalesce("monitor_url", "_k"),
        "base_url": F.coalesce("base_url", "_h.base_url"), "domain": F.coalesce("domain", "_h.domain"),
        "discovered_from": F.when(fresh, F.col("_h.discovered_from")).otherwise(F.col("discovered_from")),
        "discovery_query": F.when(fresh, F.col("_h.discovery_query")).otherwise(F.col("discovery_query")),
        "confidence_score": F.greatest("confidence_score", "_c"),
        "source_type": F.when(fresh | (F.col("source_type") == "Unknown"), F.coalesce("_t", F.lit("Unknown"))).otherwise(F.col("source_type")),
        "organisation_name": F.coalesce(F.nullif("organisation_name", F.lit("")), "_o", "organisation_name"),
        "is_approved": F.coalesce("is_approved", F.lit(False)), "first_discovered_at": F.when(fresh, now).otherwise(F.col("first_discovered_at")),
    }, fresh)


#: What a new source has where the batch says nothing.
SOURCE_DEFAULTS = {
    "is_active": True, "is_approved": True, "consecutive_failures": 0, "total_opportunities_found": 0, "scan_interval_hours": 12,
    "priority_score": 50.0, "url_relevance_score": 0.0, "is_auto_disabled": False, "source_type": "Unknown", "confidence_score": 0.0,
}


def _project_sources(rows: DataFrame, columns: list[str], values: dict[str, Column], fresh: Column) -> DataFrame:
    out = []
    for c in columns:
        x = values.get(c, F.col(c))
        if c in SOURCE_DEFAULTS:
            x = F.when(fresh, F.coalesce(x, F.lit(SOURCE_DEFAULTS[c]))).otherwise(x)
        out.append(x.alias(c))
    return rows.select(*out, F.when(fresh, "insert").when(F.col("_k").isNotNull(), "update").otherwise("keep").alias("action"))


def match_sources(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(ordinal, id): the source a candidate matches by monitor_url or else by domain, lowest id first.

    Two equi-joins and a pick, never a join on an OR.
    """
    by_url = batch.select("ordinal", "monitor_url").join(existing.select("id", "monitor_url"), "monitor_url").select("ordinal", "id", F.lit(0).alias("way"))
    least = existing.groupBy("domain").agg(F.min("id").alias("id"))
    by_domain = batch.select("ordinal", "domain").join(least, "domain").select("ordinal", "id", F.lit(1).alias("way"))
    both = by_url.unionByName(by_domain)
    return both.groupBy("ordinal").agg(F.min(F.struct("way", "id"))["id"].alias("id"))


def upsert_candidates(existing: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Discovery upsert on monitor_url or domain.

    Candidates that match a stored source improve it; the others are grouped
    by domain, the first inserts and the rest improve it.
    """
    found = match_sources(batch, existing)
    tied = batch.join(found, "ordinal", "left")
    best = lambda key, *cols: F.max(F.struct(F.col(key), (-F.col("ordinal")).alias("o"), *[F.col(c).alias(f"b_{c}") for c in cols]))
    head = F.min(F.struct("ordinal", "organisation_name", "base_url", "monitor_url", "domain", "source_type")).alias("h")
    known_type = F.min(F.when(~F.col("source_type").isin("Unknown", "Organisation"), F.struct("ordinal", "source_type")))["source_type"].alias("t")
    aggs = [
        head, known_type, best("confidence_score", "discovery_query", "discovered_from").alias("c"), best("url_relevance_score", "monitor_url").alias("u"),
        F.max("priority_score").alias("p"),
        F.min(F.when(F.nullif("organisation_name", F.lit("")).isNotNull(), F.struct("ordinal", "organisation_name")))["organisation_name"].alias("n"),
    ]
    fold = tied.groupBy("id", F.when(F.col("id").isNull(), F.col("domain")).alias("dom")).agg(*aggs)
    new = fold.select(F.col("id").alias("_id"), F.coalesce(F.col("id").cast("string"), F.col("dom")).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("h", "t", "c", "u", "p", "n")])
    rows = existing.withColumn("_old", F.lit(True)).join(new, existing.id == F.col("_id"), "full_outer")
    fresh = F.col("_old").isNull()
    met = F.col("_k").isNotNull()
    better_c = met & (F.col("_c.confidence_score") > F.coalesce("confidence_score", F.lit(0.0)))
    better_u = met & (F.col("_u.url_relevance_score") > F.coalesce("url_relevance_score", F.lit(0.0)))
    pick = lambda when, x, old: F.when(when, x).otherwise(F.col(old))
    vague = F.col("source_type").isNull() | F.col("source_type").isin("", "Unknown", "Organisation")
    return _project_sources(rows, existing.columns, {
        "organisation_name": pick(met, F.coalesce(F.nullif("organisation_name", F.lit("")), "_n", "organisation_name"), "organisation_name"),
        "base_url": F.coalesce("base_url", "_h.base_url"), "domain": F.coalesce("domain", "_h.domain"),
        "monitor_url": F.when(fresh, F.when(F.col("_u.url_relevance_score") > 0, F.col("_u.b_monitor_url")).otherwise(F.col("_h.monitor_url"))).otherwise(pick(better_u, F.col("_u.b_monitor_url"), "monitor_url")),
        "url_relevance_score": pick(better_u, F.col("_u.url_relevance_score"), "url_relevance_score"),
        "confidence_score": pick(better_c, F.col("_c.confidence_score"), "confidence_score"),
        "discovery_query": pick(better_c | fresh, F.col("_c.b_discovery_query"), "discovery_query"),
        "discovered_from": pick(better_c | fresh, F.col("_c.b_discovered_from"), "discovered_from"),
        "priority_score": F.when(fresh, F.col("_p")).otherwise(pick(met, F.greatest(F.coalesce("priority_score", F.lit(0.0)), "_p"), "priority_score")),
        "source_type": pick(met & (fresh | vague), F.coalesce("_t", "_h.source_type"), "source_type"),
        "is_approved": pick(met, F.lit(True), "is_approved"), "is_active": pick(met, F.lit(True), "is_active"),
        "is_auto_disabled": pick(met, F.lit(False), "is_auto_disabled"), "disabled_reason": pick(met, F.lit(None), "disabled_reason"),
        "last_discovered_at": pick(met, now, "last_discovered_at"), "first_discovered_at": pick(fresh, now, "first_discovered_at"),
    }, fresh)


def seed_sources(existing: DataFrame, seeds: DataFrame, now: Column) -> DataFrame:
    """Seeds (organisation_name, base_url, monitor_url, source_type): stored ones are re-activated, new ones trusted fully."""
    from ..functions.urls import plain_domain

    s = seeds.dropDuplicates(["monitor_url"]).select(*[F.col(c).alias(f"_{c}") for c in ("organisation_name", "base_url", "source_type")], F.col("monitor_url").alias("_k"))
    rows = existing.withColumn("_old", F.lit(True)).join(s, existing.monitor_url == F.col("_k"), "full_outer")
    fresh, met = F.col("_old").isNull(), F.col("_k").isNotNull()
    new = lambda c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c))
    return _project_sources(rows, existing.columns, {
        "organisation_name": new("organisation_name"), "base_url": new("base_url"), "source_type": new("source_type"),
        "monitor_url": F.coalesce("monitor_url", "_k"), "domain": F.when(fresh, plain_domain("_k")).otherwise(F.col("domain")),
        "confidence_score": F.when(fresh, F.lit(100.0)).otherwise(F.col("confidence_score")),
        "is_active": F.when(met, True).otherwise(F.col("is_active")), "is_approved": F.when(met, True).otherwise(F.col("is_approved")),
        "first_discovered_at": F.when(fresh, now).otherwise(F.col("first_discovered_at")),
    }, fresh)


def keyed_overwrite(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: batch rows win, keys must be unique in each."""
    kept = existing.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def approve_sources(sources: DataFrame) -> DataFrame:
    """Active sources are approved and their nulls filled; ``newly_approved`` tells which."""
    active = F.coalesce(F.col("is_active"), F.lit(False))
    fill = {"scan_interval_hours": 12, "priority_score": 50.0, "url_relevance_score": 0.0, "total_opportunities_found": 0, "is_auto_disabled": False}
    out = sources.withColumn("newly_approved", active & ~F.coalesce(F.col("is_approved"), F.lit(False)))
    out = out.withColumn("is_approved", F.when(active, True).otherwise(F.col("is_approved")))
    return out.withColumns({c: F.when(active, F.coalesce(F.col(c), F.lit(x))).otherwise(F.col(c)) for c, x in fill.items()})


def repair_for_scan(sources: DataFrame) -> DataFrame:
    """Before a crawl: approval, an interval of at least an hour, a priority."""
    from .quality import health_priority

    p = health_priority(F.col("confidence_score"), F.col("url_relevance_score"), F.col("total_opportunities_found"), F.col("consecutive_failures"),
                        F.col("last_successful_scan_at").isNotNull(), F.coalesce("is_auto_disabled", F.lit(False)))
    hours = F.when(F.coalesce("scan_interval_hours", F.lit(0)) < 1, 24).otherwise(F.col("scan_interval_hours"))
    return sources.withColumns({"is_approved": F.lit(True), "scan_interval_hours": hours, "priority_score": F.coalesce("priority_score", p)})


def backfill(opportunities: DataFrame, now: Column) -> DataFrame:
    """Missing timestamps from created_at or now, missing status New, missing flag false."""
    stamps = {c: F.coalesce(c, "created_at", now) for c in ("first_discovered_at", "last_seen_at", "updated_at")}
    blank = F.col("status").isNull() | (F.trim("status") == "")
    return opportunities.withColumns({**stamps, "status": F.when(blank, "New").otherwise(F.col("status")), "is_expired": F.coalesce("is_expired", F.lit(False))})


def dedupe_last(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key, at the position of its first."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    g = rows.groupBy(key).agg(F.max(F.struct(ordinal, *rest)).alias("r"), F.min(ordinal).alias("first"))
    return g.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], F.col("first").alias(ordinal))


def dedupe_richest(previews: DataFrame) -> DataFrame:
    """Per listing_url the preview with the most text; the first of equals."""
    size = F.length("title") + F.length("card_text") + F.length("organisation_name")
    rest = [c for c in previews.columns if c not in ("listing_url", "ordinal")]
    g = previews.groupBy("listing_url").agg(F.max(F.struct(size.alias("n"), (-F.col("ordinal")).alias("o"), *rest)).alias("r"))
    return g.select("listing_url", (-F.col("r.o")).alias("ordinal"), *[F.col(f"r.{c}").alias(c) for c in rest])


def best_links(links: DataFrame) -> DataFrame:
    """Per page and url the best score, ordered by it; the first of equals."""
    g = links.groupBy("page_url", "url").agg(F.max("score").alias("score"), F.min("ordinal").alias("ordinal"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("page_url").orderBy(F.col("score").desc(), "ordinal", "url")))
