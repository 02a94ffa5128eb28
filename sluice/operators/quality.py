"""Source assessment, classification and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import computed_once, filled, first_rule, has_any, organisation_from_domain, organisation_from_site, strip_tags, substring_hits
from ..functions.urls import domain, is_blocked, is_ignored, monitor_url, netloc, quality_url, scheme, url_relevance

APPROVAL_SCORE, DISCOVERY_SCORE = 60.0, 40.0


def money(x: Column) -> Column:
    """Scores are worked out in decimals, so that rounding is the same everywhere."""
    return x.cast("decimal(18,6)")


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(x, 2))).cast("double")


def source_priority(confidence: Column, relevance: Column, source_type: Column, aggregator: Column) -> Column:
    score = money(confidence) * F.lit("0.65").cast("decimal(4,2)") + money(relevance) * F.lit("0.25").cast("decimal(4,2)")
    return bounded(score + F.when(source_type.isin(*v.PREFERRED_TYPES), 10).otherwise(0) - F.when(aggregator, 10).otherwise(0))


def health_priority(confidence: Column, relevance: Column, found: Column, failures: Column, ever_ok: Column, disabled: Column) -> Column:
    none = lambda x: F.coalesce(x, F.lit(0))
    score = (
        money(none(confidence)) * F.lit("0.55").cast("decimal(4,2)") + money(none(relevance)) * F.lit("0.20").cast("decimal(4,2)")
        + F.least(none(found) * 2, F.lit(20)) - F.least(none(failures) * 5, F.lit(35)) + F.when(ever_ok, 5).otherwise(0)
    )
    return F.when(disabled, F.lit(0.0)).otherwise(bounded(score))


def assess(results: DataFrame) -> DataFrame:
    """Search results (title, description, url, query) with the assessment columns.

    Rejections are tried in order; a rejected row has score 0 and type Rejected.
    """
    rows = results.withColumn("_url", quality_url("url"))
    rows = rows.withColumn("_domain", domain(netloc("_url")))
    text = F.lower(strip_tags(F.concat_ws(" ", filled("title"), filled("description"), "_url", filled("query"))))
    rows = computed_once(rows, {"_text": text, "_relevance": url_relevance("_url")})
    rows = rows.withColumn("_aggregator", has_any("_text", v.AGGREGATORS))
    ends = lambda x: F.endswith(F.col("_domain"), F.lit(x))
    says = lambda x: F.contains(F.col("_text"), F.lit(x))
    raw = (
        F.when(ends(".gov.rw"), 45).when(ends(".ac.rw"), 40).when(ends(".rw"), 30).otherwise(0)
        + F.when(says("rwanda"), 15).otherwise(0) + F.when(says("kigali"), 5).otherwise(0)
        + F.least(substring_hits("_text", v.SOURCE_OPPORTUNITY) * 5, F.lit(25))
        + F.least(substring_hits("_text", v.TRUSTED_ORGANISATIONS) * 4, F.lit(20))
        + F.least(money(F.col("_relevance")) * F.lit("0.25").cast("decimal(4,2)"), F.lit(15))
        - F.when(F.col("_aggregator"), 10).otherwise(0)
    )
    rows = computed_once(rows, {"_score": bounded(raw), "_type": first_rule("_text", v.SOURCE_TYPE_RULES, "Organisation")})
    early = (
        F.when(F.col("_url") == "", "Invalid or unsupported URL.")
        .when(F.col("_domain") == "", "The website domain could not be determined.")
        .when(is_blocked("_domain"), F.concat(F.lit("Blocked or irrelevant domain: "), "_domain"))
        .when(has_any("_domain", v.LOW_VALUE_DOMAINS), "The domain appears to be a directory, blog or generic information site.")
        .when(has_any("_text", v.LOW_VALUE_TEXTS), "The result appears informational rather than an opportunity source.")
    )
    rows = rows.withColumn("_early", early)
    fine = F.col("_early").isNull()
    pick = lambda x, other: F.when(fine, x).otherwise(F.lit(other))
    accepted = fine & (F.col("_score") >= APPROVAL_SCORE)
    return rows.select(
        *results.columns,
        accepted.alias("accepted"),
        pick(F.col("_score"), 0.0).alias("confidence_score"),
        pick(source_priority(F.col("_score"), F.col("_relevance"), F.col("_type"), F.col("_aggregator")), 0.0).alias("priority_score"),
        pick(F.col("_relevance"), 0.0).alias("url_relevance_score"),
        pick(F.col("_type"), "Rejected").alias("source_type"),
        pick(organisation_from_site("title", "_domain"), "").alias("organisation_name"),
        pick(F.concat(scheme("_url"), F.lit("://"), netloc("_url")), "").alias("base_url"),
        pick(monitor_url("_url"), "").alias("monitor_url"),
        F.coalesce("_early", F.when(~accepted, "Confidence score is below the automatic approval threshold.")).alias("rejection_reason"),
    )


def candidates(assessed: DataFrame, now: Column) -> DataFrame:
    """Source rows of the accepted results."""
    return assessed.where("accepted").select(
        "organisation_name", "base_url", "monitor_url", domain(netloc("base_url")).alias("domain"), "source_type",
        F.col("url").alias("discovered_from"), F.col("query").alias("discovery_query"), "confidence_score", "priority_score",
        "url_relevance_score", F.lit(True).alias("is_active"), F.lit(True).alias("is_approved"), F.lit(False).alias("is_auto_disabled"),
        now.alias("last_discovered_at"), *(["ordinal"] if "ordinal" in assessed.columns else []),
    )


def weighted_signals(results: DataFrame, signals: dict[str, float] = v.SOURCE_SIGNALS) -> DataFrame:
    """Second classifier: summed signal points, with source_type, confidence_score and sorted reasons."""
    rows = results.withColumn("_text", F.lower(F.concat_ws(" ", filled("title"), filled("description"), filled("url"))))
    table = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(float(p)).alias("p")) for k, p in signals.items()])
    rows = rows.withColumn("_hits", F.filter(table, lambda h: F.contains(F.col("_text"), h["s"])))
    local = F.contains(F.lower(filled("url")), F.lit(".rw"))
    score = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["p"]) + F.when(local, 10.0).otherwise(0.0)
    names = F.concat(F.transform("_hits", lambda h: h["s"]), F.when(local, F.array(F.lit("Rwanda domain"))).otherwise(F.expr("cast(array() as array<string>)")))
    return rows.select(
        *results.columns,
        first_rule("_text", v.DISCOVERY_TYPE_RULES, "Unknown").alias("source_type"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("confidence_score"),
        F.array_sort(F.array_distinct(names)).alias("reasons"),
    )


def outcomes(results: DataFrame, known: DataFrame, threshold: float = DISCOVERY_SCORE) -> DataFrame:
    """Label each result ignored, rejected, saved or duplicate.

    ``known`` holds monitor_url; ``results`` has ordinal.  Of results that
    normalise alike the first by ordinal is saved, the rest are duplicates.
    """
    from pyspark.sql import Window

    from ..functions.urls import repository_url

    rows = weighted_signals(results).withColumns({"monitor_url": repository_url("url"), "organisation_name": organisation_from_domain("title", "url")})
    stage = F.when(is_ignored("url"), "ignored").when(F.col("confidence_score") < threshold, "rejected").otherwise("pass")
    rows = rows.withColumn("_stage", stage)
    nth = F.row_number().over(Window.partitionBy("monitor_url", "_stage").orderBy("ordinal"))
    seen = known.select("monitor_url").distinct().withColumn("_known", F.lit(True))
    rows = rows.withColumn("_nth", nth).join(seen, "monitor_url", "left")
    invalid = netloc("monitor_url") == ""
    outcome = F.when(F.col("_stage") != "pass", F.col("_stage")).when(F.col("_known").isNotNull() | (F.col("_nth") > 1) | invalid, "duplicate").otherwise("saved")
    return rows.withColumns({"outcome": outcome, "confidence_score": F.when(F.col("_stage") == "ignored", 0.0).otherwise(F.col("confidence_score"))}).drop("_stage", "_nth", "_known")


def outcome_counts(labelled: DataFrame) -> DataFrame:
    """One row of counters; ignored counts as rejected too."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return labelled.agg(
        F.count("*").alias("results"), n("saved").alias("saved"), n("duplicate").alias("duplicates"), n("rejected", "ignored").alias("rejected"), n("ignored").alias("ignored")
    )
