"""Delta-maintained Lloyd's result in SQL: each round works out whole sums."""

from __future__ import annotations

from .quantise import ENTRIES, PARTS, ROUNDS, SCALE


def _round(r: int) -> str:
    return f"""
        near{r} AS (
            SELECT rn, p, e, d, x FROM (
                SELECT v.rn, v.p, b.e, v.x, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
                FROM parts v JOIN book{r} b ON v.p = b.p
            ) QUALIFY row_number() OVER (PARTITION BY rn, p ORDER BY d, e) = 1
        ),"""


def _update(r: int) -> str:
    return f"""
        mean{r} AS (
            SELECT p, e, list(m ORDER BY j) AS c FROM (
                SELECT p, e, j, CAST(floor(CAST(sum(x[j]) AS DECIMAL(38, 0)) / count(*)) AS BIGINT) AS m FROM near{r}, (SELECT unnest(range(1, 4096)) AS j) WHERE j <= len(x) GROUP BY p, e, j
            ) GROUP BY p, e
        ),
        book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e)),"""


def codes_sql() -> str:
    steps = "".join(_round(r) + _update(r) for r in range(ROUNDS)) + _round(ROUNDS)
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), numbered AS (
            SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rn FROM kept
        ), parts AS (
            SELECT rn, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM numbered, range({PARTS}) AS g(p)
        ), book0 AS (
            SELECT p, rn AS e, x AS c FROM parts WHERE rn < {ENTRIES}
        ),{steps}
        row_codes AS (
            SELECT rn, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY rn
        ), whole AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM numbered JOIN row_codes USING (rn), whole
    """
