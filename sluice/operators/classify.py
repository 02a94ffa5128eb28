"""Opportunity classification: gates, category scores and reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import TermIndex, computed_once, ends_with_any, filled, find_terms, normalise_term, tokens_of, txt
from ..functions.urls import path


@dataclass(frozen=True)
class Rules:
    """Dictionaries of the classifier; the defaults are the production ones."""

    categories: tuple = tuple(v.CATEGORY_RULES)
    strong: tuple[str, ...] = v.STRONG_PROCUREMENT
    abbreviations: tuple[str, ...] = v.ABBREVIATIONS
    submission: tuple[str, ...] = v.SUBMISSION
    metadata: tuple[str, ...] = v.METADATA
    firm: tuple[str, ...] = v.FIRM
    employment: tuple[str, ...] = v.EMPLOYMENT
    generic: tuple[str, ...] = v.GENERIC_PAGE
    titles: tuple[str, ...] = v.GENERIC_TITLES
    extensions: tuple[str, ...] = v.DOCUMENT_EXTENSIONS
    hints: tuple[str, ...] = v.DOCUMENT_HINTS
    threshold: int = 55


EVIDENCE = ("strong", "abbreviations", "submission", "metadata", "firm", "employment", "generic")


def searchable(df: DataFrame) -> Column:
    """The text that is searched: all text fields of a listing, normalised."""
    cols = ("title", "description", "organisation_name", "source_name", "source_url")
    return txt(F.concat_ws(" ", *[filled(c) if c in df.columns else F.lit("") for c in cols]))


def evidence(listings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``listings`` with one array of found terms per dictionary.

    Texts and found terms are computed once a row, however many dictionaries,
    gates and scores look at them.
    """
    doc_text = tokens_of(txt(F.concat(filled("title"), F.lit(" "), F.lower(path("source_url")))))
    texts = computed_once(listings, {"_text": searchable(listings), "_title": txt("title"), "_doc": doc_text})
    index = TermIndex(*(getattr(rules, k) for k in EVIDENCE), *(terms for _, *both in rules.categories for terms in both))
    padded = computed_once(texts, {"_terms": index.found(tokens_of("_text"))})
    is_document = ends_with_any(F.lower(path("source_url")), rules.extensions) & (F.size(find_terms("_doc", rules.hints)) > 0)
    found = {f"_{k}": TermIndex.among("_terms", getattr(rules, k)) for k in EVIDENCE}
    return computed_once(padded, {**found, "_document": is_document, "_dated": F.col("deadline").isNotNull()})


def admitted(rules: Rules = Rules()) -> Column:
    """The gates before scoring, over the columns of ``evidence``."""
    n = {k: F.size(f"_{k}") for k in EVIDENCE}
    some = {k: n[k] > 0 for k in EVIDENCE}
    doc, dated = F.col("_document"), F.col("_dated")
    procurement = (
        some["strong"] | doc | some["submission"] | (dated & (some["metadata"] | some["firm"] | some["abbreviations"])) | (some["metadata"] & some["firm"])
    )
    only_jobs = some["employment"] & ~(some["strong"] | some["submission"] | doc | some["firm"])
    generic = F.col("_title").isin([normalise_term(t) for t in rules.titles]) & ~(
        some["strong"] & (dated | some["metadata"] | some["submission"])
    )
    return (F.col("_text") != "") & (F.col("_title") != "") & procurement & ~only_jobs & ~generic


def scored(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Best category of each admitted row: score, then rule order."""
    at_most = lambda cap, weight, k: F.least(F.lit(cap), F.size(k) * weight)
    shared = (
        at_most(30, 15, "_strong") + at_most(10, 5, "_submission") + at_most(10, 3, "_metadata") + at_most(5, 2, "_firm")
        + F.when(F.col("_dated"), 10).otherwise(0) + F.when(F.col("_document"), 15).otherwise(0)
        + at_most(5, 2, "_abbreviations") - at_most(30, 10, "_generic") - at_most(25, 10, "_employment")
    )
    hits = F.array(*[
        F.struct(F.lit(-i).alias("o"), F.lit(name).alias("category"), TermIndex.among("_terms", strong).alias("s"), TermIndex.among("_terms", broad).alias("b"))
        for i, (name, strong, broad) in enumerate(rules.categories)
    ])
    rows = computed_once(found, {"_shared": shared, "_hits": hits})
    score = lambda h: F.greatest(F.lit(0), F.least(F.lit(100), F.least(F.lit(35), F.size(h["s"]) * 20) + F.least(F.lit(15), F.size(h["b"]) * 5) + F.col("_shared")))
    live = F.filter("_hits", lambda h: (F.size(h["s"]) > 0) | (F.size(h["b"]) > 0))
    ranked = F.transform(live, lambda h: F.struct(score(h).alias("score"), h["o"].alias("o"), h["category"].alias("category"), h["s"].alias("s"), h["b"].alias("b")))
    return computed_once(rows, {"_best": F.array_max(ranked)})


def reasons(best: str = "_best") -> Column:
    none = F.expr("cast(array() as array<string>)")
    parts = F.concat(
        F.col(f"{best}.s"), F.col(f"{best}.b"), F.col("_strong"), F.col("_submission"), F.col("_metadata"), F.col("_firm"),
        F.when(F.col("_dated"), F.array(F.lit("deadline detected"))).otherwise(none),
        F.when(F.col("_document"), F.array(F.lit("procurement document"))).otherwise(none),
    )
    return F.array_join(F.array_sort(F.array_distinct(parts)), ", ")


def classify(listings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Accepted listings with category, match_score and match_reason."""
    kept = scored(evidence(listings, rules).where(admitted(rules)), rules).where(F.col("_best.score") >= rules.threshold)
    return kept.select(
        *listings.columns, F.col("_best.category").alias("category"), F.col("_best.score").cast("int").alias("match_score"), reasons().alias("match_reason")
    )
