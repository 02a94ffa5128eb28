"""Text normalisation and dictionary matching as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str methods see it, in Java's syntax.
WS = r"(?U)[\s\x1c-\x1f]+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    return F.coalesce(c(x), F.lit(""))


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once a row.

    A plain projection would be inlined into every later filter and expression
    that names the columns; nothing is moved through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in cols.items()]))))


def let(x: Column | str, f) -> Column:
    """f(x) with x worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c(x)), f), F.lit(0))


def txt(x: Column | str) -> Column:
    """Lower-case words of a-z, 0-9 and dots, one space apart; null gives ''."""
    plain = F.replace(F.lower(filled(x)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9.]+", " "))


def normalise_term(term: str) -> str:
    return re.sub(r"[^a-z0-9.]+", " ", term.lower().replace("&", " and ")).strip()


def tokens_of(text: Column | str) -> Column:
    """Normalised text, padded, with dots as words of their own: phrases match as substrings."""
    return F.concat(F.lit(" "), F.replace(c(text), F.lit("."), F.lit(" . ")), F.lit(" "))


def _trie_pattern(terms: list[str]) -> str:
    """A pattern that matches the longest of the terms; common beginnings are read once."""
    ends, kids = "" in terms, {}
    for t in terms:
        if t:
            kids.setdefault(t[0], []).append(t[1:])
    if not kids:
        return ""
    ways = [re.escape(k) + _trie_pattern(rest) for k, rest in sorted(kids.items())]
    one = ways[0] if len(ways) == 1 and not ends else "(?:" + "|".join(ways) + ")"
    return one + "?" if ends else one


class TermIndex:
    """Many terms looked up in one pass over a text: cost follows the text, not the dictionaries.

    At every word the longest term that begins there is read off a trie; the terms that
    are its own beginnings occur with it.
    """

    def __init__(self, *dictionaries):
        self.words = {t: n for d in dictionaries for t in d if (n := normalise_term(t))}

    def found(self, padded: Column | str) -> Column:
        """All terms that occur as whole words, in any order, some perhaps twice; ``padded`` comes from tokens_of."""
        if not self.words:
            return F.expr("cast(array() as array<string>)")
        by_text: dict[str, list[str]] = {}
        for t, n in self.words.items():
            by_text.setdefault(n, []).append(t)
        begins = {n: [t for m, ts in sorted(by_text.items()) if n == m or n.startswith(m + " ") for t in ts] for n in by_text}
        longest = F.regexp_extract_all(c(padded), F.lit(f"(?<= )(?=({_trie_pattern(sorted(by_text))}) )"), F.lit(1))
        # Most terms stand for themselves alone; only the others are looked up.
        more = {n: ts for n, ts in begins.items() if ts != [n]}
        if not more:
            return longest
        implied = F.create_map(*[x for n, ts in sorted(more.items()) for x in (F.lit(n), F.array(*map(F.lit, ts)))])
        return F.flatten(F.transform(longest, lambda n: F.when(n.isin(*more), implied[n]).otherwise(F.array(n))))

    @staticmethod
    def among(found: Column | str, terms) -> Column:
        """Sorted distinct terms of one dictionary among those found."""
        usable = sorted({t for t in terms if normalise_term(t)})
        if not usable:
            return F.expr("cast(array() as array<string>)")
        return F.array_sort(F.array_distinct(F.filter(c(found), lambda t: t.isin(*usable))))


def find_terms(padded: Column | str, terms) -> Column:
    """Sorted distinct terms that occur as whole words; ``padded`` comes from tokens_of."""
    return TermIndex.among(TermIndex(terms).found(padded), terms)


def contains_term(text: Column | str, term: str) -> Column:
    """Whole-word phrase match in a normalised text."""
    n = normalise_term(term)
    return F.contains(tokens_of(text), F.lit(f" {n} ")) if n else F.lit(False)


def substring_hits(text: Column | str, terms) -> Column:
    """How many of the terms occur as substrings."""
    return let(text, lambda x: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))))


def has_any(text: Column | str, terms) -> Column:
    return let(text, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)))


def ends_with_any(text: Column | str, endings) -> Column:
    return let(text, lambda x: F.exists(F.array(*map(F.lit, endings)), lambda t: F.endswith(x, t)))


def clean_text(x: Column | str) -> Column:
    """One-line text: any white space to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(filled(x), WS, " "))


def strip_tags(x: Column | str) -> Column:
    """clean_text after tags have given way to spaces."""
    return clean_text(F.regexp_replace(filled(x), r"<[^>]+>", " "))


def or_null(x: Column | str) -> Column:
    """Trimmed, with empty as null."""
    return F.nullif(clean_edges(x), F.lit(""))


def clean_edges(x: Column | str) -> Column:
    return F.regexp_replace(filled(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def organisation_name(x: Column | str) -> Column:
    """Trimmed, without trailing dashes, colons, bars and spaces; empty as null."""
    return F.nullif(clean_edges(F.regexp_replace(clean_edges(x), r"[-–—:;| ]+$", "")), F.lit(""))


def remove_labels(x: Column | str, labels) -> Column:
    """Without leading field labels, tried one after the other."""
    out = clean_text(x)
    for label in labels:
        out = F.regexp_replace(out, rf"(?i)^{re.escape(label)}\s*:?\s*", "")
    return F.trim(out)


def remove_site_names(x: Column | str, suffixes: tuple[tuple[str, str], ...]) -> Column:
    """Without `` | Name`` and `` - Name`` endings: (separator, name) pairs in order."""
    out = clean_text(x)
    for sep, name in suffixes:
        out = F.regexp_replace(out, rf"(?i)\s*{re.escape(sep)}\s*{re.escape(name)}\s*$", "")
    return F.trim(out)


def first_text(*xs: Column | str) -> Column:
    """The first that is not empty once cleaned, else ''."""
    return F.coalesce(*[F.nullif(clean_text(x), F.lit("")) for x in xs], F.lit(""))


def title_case(x: Column | str) -> Column:
    """Upper case after anything but a letter, lower case after a letter."""
    parts = F.regexp_extract_all(filled(x), F.lit(r"(?U)([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def truncated(x: Column | str, n: int) -> Column:
    return F.substring(c(x), 1, n)


def valid_organisation(name: Column | str, title: Column | str | None = None) -> Column:
    """Could this be an organisation's name?"""
    from . import vocabulary as v

    n = clean_text(name)
    low = F.lower(n)
    ok = (
        (F.length(n) >= 2)
        & (F.length(n) <= 180)
        & ~low.isin(*v.UNSET_ORGANISATIONS)
        & ~has_any(low, v.INVALID_ORGANISATION_PHRASES)
        & (F.size(F.split(n, " ")) <= 20)
        & ~has_any(low, v.SENTENCE_SIGNALS)
    )
    if title is not None:
        ok = ok & ((clean_text(title) == "") | (low != F.lower(clean_text(title))))
    return ok


def organisation_from_title(title: Column | str) -> Column:
    """The name after ``for`` or ``to`` where a title ends in one, else ''."""
    t = clean_text(title)
    name = r"([A-Z][A-Za-z0-9&'().,\-\s]{2,100}?)"
    found = [
        F.regexp_extract(t, rf"\bfor\s+{name}(?:\s+group consolidated accounts|\s+in rwanda|$)", 1),
        F.regexp_extract(t, rf"\bto\s+{name}(?:\s+in rwanda|$)", 1),
    ]
    cut = [F.trim(F.regexp_replace(clean_text(x), r"(?i)\b(the|a|an)$", "")) for x in found]
    return F.coalesce(*[F.when(valid_organisation(x, title), x) for x in cut], F.lit(""))


def choose_organisation(title: Column | str, *candidates: Column | str) -> Column:
    """First valid candidate, else the one the title names, else 'Not specified'."""
    picks = [F.when(valid_organisation(x, title), clean_text(x)) for x in candidates]
    return F.coalesce(*picks, F.nullif(organisation_from_title(title), F.lit("")), F.lit("Not specified"))


def slug_title(url: Column | str, extensions: tuple[str, ...] = ()) -> Column:
    """Title-cased last path segment of a URL, without a document extension."""
    from .urls import path

    slug = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    for ext in [extensions] if extensions else []:
        slug = F.regexp_replace(slug, "(?i)(" + "|".join(re.escape(e) for e in ext) + ")$", "")
    return title_case(F.trim(F.regexp_replace(slug, r"[_\-\s]+", " ")))


def organisation_from_site(title: Column | str, domain: Column | str) -> Column:
    """The last fitting part of a split title, else the domain's first label."""
    from . import vocabulary as v

    t = strip_tags(title)
    parts = F.array(t)
    for sep in reversed(v.TITLE_SEPARATORS):
        split = F.filter(F.transform(F.split(t, re.escape(sep)), lambda p: F.trim(p)), lambda p: p != "")
        parts = F.when(F.contains(t, F.lit(sep)), split).otherwise(parts)
    fit = F.filter(parts, lambda p: (F.length(p) >= 3) & (F.length(p) <= 255) & ~F.lower(p).isin(*v.GENERIC_ORGANISATIONS))
    label = title_case(F.regexp_replace(F.element_at(F.split(filled(domain), r"\."), 1), r"[-_]+", " "))
    return F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(label)


def organisation_from_domain(title: Column | str, url: Column | str) -> Column:
    """The title-cased first label of the host; generic hosts and none give null."""
    from . import vocabulary as v
    from .urls import netloc

    host = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    label = F.element_at(F.split(host, r"\."), 1)
    name = title_case(F.trim(F.translate(label, "-_", "  ")))
    return (
        F.when(host == "", F.lit(None).cast("string"))
        .when(label.isin(*v.GENERIC_SITE_LABELS), F.lit(None).cast("string"))
        .when(name != "", name)
        .otherwise(F.nullif(truncated(filled(title), 255), F.lit("")))
    )


def first_rule(text: Column | str, rules, default: str) -> Column:
    """Name of the first rule one of whose terms is in the text."""
    out = F.lit(default)
    for name, terms in reversed(rules):
        out = F.when(has_any(text, terms), F.lit(name)).otherwise(out)
    return out
