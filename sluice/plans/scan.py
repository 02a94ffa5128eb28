"""The scan: scanners, classification, upsert, counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import classify, crawl, lifecycle, quality, upsert
from ..sources.snapshots import KeyedTable

#: name -> function that returns raw listings.
SCANNERS: dict[str, Callable[..., DataFrame]] = {}


def scanner(name: str):
    """Register a scanner under a name."""

    def add(f):
        SCANNERS[name] = f
        return f

    return add


def scanner_names() -> list[str]:
    """Registered scanners in the order in which they run."""
    return list(SCANNERS)


@scanner("portal")
def scan_portal(cards: DataFrame, details: DataFrame, portal_name: str, site_suffixes=()) -> DataFrame:
    """A portal's previews with their detail pages."""
    return crawl.portal_listings(cards, details, portal_name, site_suffixes)


@scanner("websites")
def scan_websites(sources: DataFrame, pages: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Opportunity pages and documents that a crawl of the sources' captured pages meets."""
    found = crawl.crawl(sources, crawl.link_edges(pages), pages) if blocked is None else crawl.crawl(sources, crawl.link_edges(pages), pages, blocked)
    return crawl.page_listings(found, pages, sources)


def run_scanners(inputs: dict[str, dict]) -> tuple[DataFrame, DataFrame | None]:
    """(failures, listings): every named scanner on its inputs; one that cannot be planned is a failure, and the others go on.

    failures: scanner, problem.
    """
    found, problems, spark = {}, [], None
    for name in (n for n in SCANNERS if n in inputs):
        spark = spark or next(x for x in inputs[name].values() if isinstance(x, DataFrame)).sparkSession
        try:
            found[name] = SCANNERS[name](**inputs[name])
        except Exception as e:
            problems.append((name, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(problems, "scanner string, problem string"), gather(found) if found else None


#: A scanner's outcome; counts are null where its run did not get so far.
OUTCOME = "scanner string, found long, relevant long, saved long, updated long, classification_failures long, save_failures long, problem string"


def scan_into(table: KeyedTable, inputs: dict[str, dict], now: Column, as_of: Column, root: str, rules: classify.Rules = classify.Rules(), scanners: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Run every named scanner into ``table`` (opportunities by source_url), each by itself; a row of OUTCOME a scanner.

    A scanner that fails, when planned or while it runs, is counted with its problem, and
    the others' rows are saved.  Counts are observed on the writes, so nothing is read twice for
    them.  ``root``: a shared folder for what the scanners found; ``scanners``: others than the registered ones.
    """
    spark, outcomes, run = table.spark, [], uuid.uuid4().hex
    known = SCANNERS if scanners is None else scanners
    for name in (n for n in known if n in inputs):
        counts: dict[str, int] = {}
        problem = None
        try:
            raw = _written(known[name](**inputs[name]).withColumn("scanner", F.lit(name)), f"{root}/{run}/{name}/raw", counts, {
                "found": F.count(F.lit(1)), "classification_failures": F.count_if(_blank("title")), "save_failures": F.count_if(~_blank("title") & _blank("source_url"))})
            cols = ["organisation_name", "title", "description", "deadline", "source_name", "source_url", "category", "match_score", "match_reason", "ordinal"]
            accepted = classify.classify(raw.where(~_blank("title") & ~_blank("source_url")), rules).select(*cols)
            accepted = _written(accepted, f"{root}/{run}/{name}/accepted", counts, {"relevant": F.count(F.lit(1))})
            seen: list[Observation] = []

            def update(stored: DataFrame, batch: DataFrame) -> DataFrame:
                seen.append(Observation())
                out = upsert.upsert_opportunities(stored, batch, now, as_of, row_by_row=True)
                out = out.observe(seen[-1], F.count_if(F.col("action") == "insert").alias("saved"), F.count_if(F.col("action") == "update").alias("updated"))
                return out.drop("action", "changed")

            table.merge(accepted, update)
            counts |= seen[-1].get
        except Exception as e:
            problem = f"{type(e).__name__}: {_cause(e)}"[:500]
        outcomes.append((name, *(counts.get(c) for c in ("found", "relevant", "saved", "updated", "classification_failures", "save_failures")), problem))
    return spark.createDataFrame(outcomes, OUTCOME)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _cause(e: BaseException) -> str:
    """The last line of an error that is not blank: what Python code on an executor raised comes last."""
    lines = [line.strip() for line in str(e).split("JVM stacktrace")[0].splitlines() if line.strip()]
    raised = [line for line in lines if line.split(":")[0].endswith(("Error", "Exception"))]
    return (raised or lines or [""])[-1]


def _written(df: DataFrame, path: str, counts: dict, metrics: dict[str, Column]) -> DataFrame:
    """Write ``df``, observe ``metrics`` on the way into ``counts``, and read it back."""
    seen = Observation()
    df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.parquet(path)
    counts |= seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path)


def totals(outcomes: DataFrame) -> DataFrame:
    """One row of a run's outcomes: sums, and how many scanners failed."""
    names = ("found", "relevant", "saved", "updated", "classification_failures", "save_failures")
    return outcomes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.count("problem").alias("scan_failures"))


def gather(found: dict[str, DataFrame]) -> DataFrame:
    """All scanners' listings with the scanner's name; ordinals order them across scanners."""
    parts = [
        df.withColumns({"scanner": F.lit(name), "ordinal": F.col("ordinal") + F.lit(i << 48)}) for i, (name, df) in enumerate(found.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def run_scan(opportunities: DataFrame, listings: DataFrame, now: Column, as_of: Column, rules: classify.Rules = classify.Rules(), accepted: DataFrame | None = None) -> DataFrame:
    """Opportunities after maintenance, classification and upsert, with action and changed.

    ``accepted``: what ``classify`` has made of the listings, if that is at hand.
    """
    kept = lifecycle.apply_expiry(opportunities, as_of, only_dated=True).drop("changed")
    accepted = classify.classify(listings, rules) if accepted is None else accepted
    cols = ["organisation_name", "title", "description", "deadline", "source_name", "source_url", "category", "match_score", "match_reason", "ordinal"]
    return upsert.upsert_opportunities(kept, accepted.select(*cols), now, as_of)


def counters(listings: DataFrame, accepted: DataFrame, result: DataFrame) -> DataFrame:
    """Per scanner: found, relevant, saved and updated."""
    found = listings.groupBy("scanner").agg(F.count("*").alias("found"))
    relevant = accepted.groupBy("scanner").agg(F.count("*").alias("relevant"))
    owner = accepted.groupBy("source_url").agg(F.min_by("scanner", "ordinal").alias("scanner"))
    done = result.where("action <> 'keep'").select("source_url", "action").join(owner, "source_url").groupBy("scanner").agg(
        F.count_if(F.col("action") == "insert").alias("saved"), F.count_if(F.col("action") == "update").alias("updated")
    )
    out = found.join(relevant, "scanner", "left").join(done, "scanner", "left")
    return out.na.fill(0, ["relevant", "saved", "updated"])


def run_totals(per_scanner: DataFrame, scan_failures: DataFrame, unclassified: DataFrame, unsaved: DataFrame) -> DataFrame:
    """One row: the run's totals with the three kinds of failure.

    ``scan_failures``: a row a scanner that failed.  ``unclassified`` and
    ``unsaved``: listings that could not be classified (no usable title or URL) or saved.
    """
    sums = per_scanner.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "relevant", "saved", "updated")])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = sums.crossJoin(count(scan_failures, "scan_failures")).crossJoin(count(unclassified, "classification_failures"))
    return rows.crossJoin(count(unsaved, "save_failures"))


def broken(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unclassified, unsaved): listings without a title, and those with one but without the URL that is their key."""
    no_title = F.coalesce(F.trim("title"), F.lit("")) == ""
    no_key = F.coalesce(F.trim("source_url"), F.lit("")) == ""
    return listings.where(no_title), listings.where(~no_title & no_key)


def run_discovery(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Sources after assessing search results (title, description, url, query, ordinal)."""
    return upsert.upsert_candidates(sources, quality.candidates(quality.assess(results), now), now)
