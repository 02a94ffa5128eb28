"""SQL text of the scalar functions, for the oracle side."""

from __future__ import annotations

from .functions import vocabulary as v
from .functions.text import normalise_term


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def txt(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9.]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"' ' || replace({x}, '.', ' . ') || ' '"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def found(padded: str, terms) -> str:
    """Sorted list of terms that occur as whole words."""
    usable = sorted({t for t in terms if normalise_term(t)})
    pairs = "[" + ", ".join(f"{{'t': {q(t)}, 'n': {q(f' {normalise_term(t)} ')}}}" for t in usable) + "]"
    return f"list_transform(list_filter({pairs}, lambda e_: contains({padded}, e_.n)), lambda e_: e_.t)"


def hits(text: str, terms) -> str:
    return f"len(list_filter({arr(terms)}, lambda e_: contains({text}, e_)))"


def has_any(text: str, terms) -> str:
    return f"({hits(text, terms)} > 0)"


def ends_any(text: str, ends) -> str:
    return f"(len(list_filter({arr(ends)}, lambda e_: ends_with({text}, e_))) > 0)"


_PIECES = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def piece(u: str, n: int) -> str:
    return f"regexp_extract(coalesce({u}, ''), {q(_PIECES)}, {n})"


def host(u: str) -> str:
    return piece(u, 2)


def path(u: str) -> str:
    return f"regexp_replace({piece(u, 3)}, ';[^/]*$', '')"


def no_end_slash(p: str) -> str:
    return f"regexp_replace({p}, '/+$', '')"


def quality_url(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^https?://[^/?#]') THEN lower({piece(u, 1)}) || '://' || lower({host(u)}) || {no_end_slash(path(u))} ELSE '' END"


def domain(h: str) -> str:
    return rf"regexp_replace(regexp_replace(split_part(lower({h}), ':', 1), '\.+$', ''), '^www\.', '')"


def first_rule(text: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(text, terms)} THEN {q(name)}" for name, terms in rules) + f" ELSE {q(default)} END"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18, 6))"


def bounded(x: str) -> str:
    return f"CAST(greatest(0, least(100, round({x}, 2))) AS DOUBLE)"


def relevance(u: str) -> str:
    return (
        f"CAST(least(100, {hits(f'lower({u})', v.HIGH_VALUE_PATHS)} * 15 + CASE WHEN {ends_any(f'lower({u})', v.RELEVANT_URL_ENDINGS)} THEN 20 ELSE 0 END"
        f" + CASE WHEN trim({path(u)}, '/') <> '' THEN 5 ELSE 0 END) AS DOUBLE)"
    )


def health(conf: str, rel: str, n: str, fails: str, ok: str, off: str) -> str:
    return (
        f"CASE WHEN {off} THEN 0.0::DOUBLE ELSE " + bounded(
            f"{dec(conf)} * CAST(0.55 AS DECIMAL(4,2)) + {dec(rel)} * CAST(0.20 AS DECIMAL(4,2)) + least({n} * 2, 20) - least({fails} * 5, 35)"
            f" + CASE WHEN {ok} THEN 5 ELSE 0 END"
        ) + " END"
    )


def markup_text(html: str) -> str:
    """The text of markup as the benchmark's pages have it: no scripts, styles or comments, few entities."""
    bare = f"regexp_replace({html}, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gs')"
    for entity, sign in (("quot", '"'), ("copy", "\u00a9"), ("middot", "\u00b7"), ("amp", "&")):
        bare = f"replace({bare}, '&{entity};', '{sign}')"
    return clean(bare)


def element(html: str, tag: str) -> str:
    """What the first ``tag`` element of a page holds."""
    return f"regexp_extract({html}, '<{tag}>(.*?)</{tag}>', 1, 's')"
