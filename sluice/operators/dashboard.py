"""Dashboard, pipeline and queue queries over the snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.dates import long_date, scan_due, short_date


def matches(q: str | None) -> Column | None:
    """Keyword filter over title, organisation, description and category; % and _ stay wildcards."""
    if not q:
        return None
    pattern = "%" + q.strip().replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in ("title", "organisation_name", "description", "category"):
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def deadline_filter(name: str | None, as_of: Column) -> Column | None:
    """Predicate of a named deadline filter; unknown names filter nothing."""
    d = F.col("deadline")
    return {
        "open": (d >= as_of) | d.isNull(),
        "expired": F.col("is_expired"),
        "no_deadline": d.isNull(),
        "due_7_days": d.between(as_of, F.date_add(as_of, 7)),
        "due_30_days": d.between(as_of, F.date_add(as_of, 30)),
    }.get(name or "")


def select(opps: DataFrame, as_of: Column, q: str | None = None, category: str | None = None, status: str | None = None, deadline: str | None = None) -> DataFrame:
    """Rows that pass every filter given; empty parameters filter nothing."""
    for p in (matches(q), (F.col("category") == category) if category else None, (F.col("status") == status) if status else None, deadline_filter(deadline, as_of)):
        if p is not None:
            opps = opps.where(p)
    return opps


def dashboard_order() -> list[Column]:
    return [F.col("is_expired").asc(), F.col("deadline").isNull().asc(), F.col("deadline").asc_nulls_last(), F.col("first_discovered_at").desc(), F.col("source_url").asc()]


def pipeline_order() -> list[Column]:
    return dashboard_order()[1:]


def _or(c: str, text: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text))


def cards(opps: DataFrame) -> DataFrame:
    """What a dashboard card shows."""
    return opps.select(
        "id", "title", _or("category", "Uncategorised").alias("category"), _or("organisation_name", "Organisation not specified").alias("organisation"),
        F.coalesce(long_date("deadline"), F.lit("Not identified")).alias("deadline_label"), _or("source_name", "Not specified").alias("source"),
        F.coalesce(F.col("match_score").cast("string"), F.lit("Not scored")).alias("score_label"),
        F.coalesce(short_date("first_discovered_at"), F.lit("Not recorded")).alias("first_seen_label"),
        F.lower("status").alias("status_class"), "status", "is_expired", "is_lead", "source_url",
    )


def dashboard(opps: DataFrame, as_of: Column, **filters: str | None) -> DataFrame:
    return cards(select(opps, as_of, **filters).orderBy(*dashboard_order()))


def places(opps: DataFrame) -> DataFrame:
    """(place, id): where each opportunity stands in the dashboard's order, without one task that sorts all.

    Rows are numbered within their deadline and day of discovery; the counts of those groups, few
    beside the rows, give the rest.
    """
    rows = opps.select("id", "is_expired", "deadline", "first_discovered_at", "source_url", F.to_date("first_discovered_at").alias("_day"))
    group = ["is_expired", "deadline", "_day"]
    inside = Window.partitionBy(*group).orderBy(*dashboard_order())
    across = Window.orderBy("is_expired_", F.col("deadline_").asc_nulls_last(), F.col("_day_").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*[F.col(c).alias(f"{c}_") for c in group]).agg(F.count("*").alias("_n"))
    before = before.select("*", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group]
    numbered = rows.withColumn("_nth", F.row_number().over(inside))
    return numbered.join(before, same).select((F.col("_before") + F.col("_nth")).alias("place"), "id")


def detail(opps: DataFrame, id_: int) -> DataFrame:
    """One opportunity's detail page, by key."""
    return opps.where(F.col("id") == id_).select(
        "id", "title", "category", "source_name", _or("organisation_name", "Organisation not specified").alias("organisation"),
        F.coalesce(long_date("deadline"), F.lit("Not identified")).alias("deadline_label"),
        F.coalesce(long_date("first_discovered_at"), F.lit("Not recorded")).alias("first_seen_label"),
        F.coalesce(F.date_format("last_seen_at", "dd MMMM yyyy 'at' HH:mm"), F.lit("Not recorded")).alias("last_seen_label"),
        _or("description", "No description was extracted.").alias("description"),
        _or("match_reason", "No classification explanation was recorded.").alias("match_reason"),
        "match_score", "status", "is_expired", "user_notes", "source_url",
    )


def details(opps: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids with ``found`` and the opportunity's title, status and URL; an unknown id has found = false."""
    rows = opps.select(F.col("id").alias("_id"), "title", "status", "source_url")
    out = ids.select("id").join(rows, F.col("id") == F.col("_id"), "left")
    return out.select("id", F.col("_id").isNotNull().alias("found"), "title", "status", "source_url")


def due_label(as_of: Column) -> Column:
    d = F.col("next_action_due")
    return F.when(d.isNull(), "Not scheduled").when(d < as_of, "Overdue").when(d == as_of, "Due Today").otherwise(long_date(d))


def pipeline(opps: DataFrame, as_of: Column) -> DataFrame:
    """Leads with what the pipeline table shows, in its order."""
    return opps.where("is_lead").orderBy(*pipeline_order()).select(
        "id", "title", _or("organisation_name", "Not specified").alias("organisation"), _or("lead_priority", "Medium").alias("priority"),
        _or("lead_status", "Under Review").alias("lead_status"), _or("assigned_to", "Unassigned").alias("assignee"),
        due_label(as_of).alias("due_label"), "deadline", "source_url",
    )


def status_counts(opps: DataFrame) -> DataFrame:
    """Rows per status: every known one, with 0 where none; unknown ones too, empty ones not."""
    spark = opps.sparkSession
    known = spark.createDataFrame([(s, i) for i, s in enumerate(v.OPPORTUNITY_STATUSES)], "status string, place int")
    n = opps.where("status is not null and status <> ''").groupBy("status").agg(F.count("*").alias("n"))
    out = known.join(n, "status", "full_outer")
    return out.select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(v.OPPORTUNITY_STATUSES))).alias("place")).orderBy("place", "status")


def categories(opps: DataFrame) -> DataFrame:
    return opps.select("category").where("category is not null and category <> ''").distinct().orderBy("category")


def kpis(opps: DataFrame, as_of: Column) -> DataFrame:
    """All dashboard figures in one pass."""
    lead, due = F.coalesce("is_lead", F.lit(False)), F.col("next_action_due")
    return opps.agg(
        F.count("*").alias("total"), F.count_if(lead).alias("pipeline_count"),
        F.count_if(lead & F.col("lead_priority").isin("High", "Urgent")).alias("high_priority_count"),
        F.count_if(lead & (due == as_of)).alias("follow_up_today"), F.count_if(lead & (due < as_of)).alias("overdue_followups"),
        F.count_if(F.col("deadline").between(as_of, F.date_add(as_of, 7))).alias("closing_this_week"),
    )


def scan_queue(sources: DataFrame, now: Column, most: int = 500) -> DataFrame:
    """Sources to scan now: active, due, best first."""
    live = sources.where(F.col("is_active") & ~F.coalesce("is_auto_disabled", F.lit(False)) & scan_due("last_scanned_at", "scan_interval_hours", now))
    return live.orderBy(F.col("priority_score").desc(), F.col("confidence_score").desc(), F.col("organisation_name").asc_nulls_first(), F.col("id").asc()).limit(most)


def with_lead_and_proposal(opps: DataFrame, leads: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each opportunity with its one lead and one proposal, as structs."""
    pack = lambda df, name: df.select(F.col("opportunity_id").alias("id"), F.struct(*df.columns).alias(name))
    return opps.join(pack(leads, "lead"), "id", "left").join(pack(proposals, "proposal"), "id", "left")
