"""The thin queries over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, langid, merkle, mixing, neardup, packing, quantise, simhash, suffixes, tokencount, topk, toxicity, urlfilter
from .common import materialise
from .manifest_sql import manifest_sql
from .quantise_sql import codes_sql

#: (host, path, verdict): the rules of the production URL policy.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Sites that block where no rule fits, under each of the suffixes.
LISTED_SITES = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]
LISTED_SUFFIXES = ["example.com", "example.org", "example.net"]
#: Made-up entries beside them (hosts, and paths of a host), so that the filter has a list's real size.
LISTED_MORE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_list(spark: SparkSession, more: int = LISTED_MORE) -> DataFrame:
    """Rules and listed URLs: host, path, verdict, is_rule."""
    rows = [(h, p, v, True) for h, p, v in URL_RULES] + [(f"{s}.{d}", "", "block", False) for s in LISTED_SITES for d in LISTED_SUFFIXES]
    named = spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")
    i = F.col("id")
    made = spark.range(more).select(
        F.concat(F.lit("listed-"), (i % (more // 2)).cast("string"), F.lit(".example")).alias("host"),
        F.when(i < more // 2, F.lit("")).otherwise(F.concat(F.lit("/p/"), i.cast("string"))).alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"),
    )
    return named.unionByName(made)


def op1_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", htmltext.extract_text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("_ints", topk.integer_vectors(F.col("embedding")))
    return topk.top_k(rows, "vec_id", "_ints", F.col("vec_id") % 20 == 0, 20)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(rows, model).drop("text", "lang_set").select(
        "doc_id", "held_out", "lang_pred", "score", F.size("lang_share").alias("n_langs")
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: for documents whose id is divisible by 20, how many other documents' fingerprints
    the block tables find within 3 bits; else null."""
    made = materialise(simhash.fingerprint_edits(table(spark, sf_dir, "documents")), "edits")
    seen = made.groupBy("doc_id").agg(F.min_by("fp", "text_md5").alias("next_fp")).withColumnRenamed("doc_id", "nid")
    asking = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    pairs = simhash.near_fingerprints(made.select("fp").distinct(), made.where(asking).select("fp").distinct(), 3)
    # A fingerprint stands for all documents that have it.
    shared = made.groupBy("fp").agg(F.count("*").alias("n"))
    within = pairs.join(shared, "fp").groupBy("query_fp").agg((F.sum("n") - 1).alias("n"))
    rows = made.join(seen, made.next_id == seen.nid, "left").join(within, made.fp == within.query_fp, "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hex16(made.fp).alias("fingerprint"),
        simhash.hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(made.fp, F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(made.fp, F.col("next_fp")).alias("near_next"),
        F.when(asking, F.col("n")).alias("n_within"),
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after two edits: a sixteenth from the
    middle gives way to the text's first thirty-second, then a sixty-fourth from
    the first quarter's end goes."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    part = lambda k: F.floor(n / k).cast("int")
    change = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), new.alias("new"))
    edits = F.array(
        change(part(2), part(2) + part(16), F.substring("text", F.lit(1), part(32))),
        change(part(4), part(4) + part(64), F.lit("")),
    )
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return docs.select("doc_id", tokencount.count_tokens(F.col("text"), edits, path, pattern).alias("_c")).select("doc_id", "_c.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.shares(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, url_list(spark)).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.predict(docs, model).withColumnRenamed("toxicity", "score")
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_readings")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantise.compress(table(spark, sf_dir, "embeddings"))
    rows = quantise.with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_maintext, op2_topk, op3_langid, op4_fingerprint, op5_tokens, op6_neardup, op7_mix, op8_urlfilter, op9_packing, op10_repeats, op11_toxicity, op12_manifest, op13_codes)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in URL_RULES)
_LISTED_SQL = ", ".join(f"('{s}.{d}', '', 'block', false)" for s in LISTED_SITES for d in LISTED_SUFFIXES)

ORACLE_SQL = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.n AS n, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_mix": f"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
                   3 * source_size AS most FROM s
        ), l AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE)
                      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
            FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), a AS (
            SELECT *, max(CASE WHEN level * weight <= most THEN level END) OVER () AS water FROM l
        ), t AS (
            SELECT source, source_size,
                   least(CAST(most AS DOUBLE), coalesce(water * weight, CAST(most AS DOUBLE))) AS target FROM a
        ), x AS (
            SELECT d.*, t.source_size, t.target, bin(d.size) AS b, substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, {mixing.SALTS_HEX}) AS salt,
                   CAST(CASE WHEN d.size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS DECIMAL(20, 15)) AS x
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), e AS (
            SELECT *, CAST(sum(x) OVER (PARTITION BY source ORDER BY length(b), substr(b, 1, 4), salt, size, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38, 15)) AS e FROM x
        ), o AS (
            SELECT source, i AS draw, CAST(CAST('0x' || substr(md5('7/' || i || '/' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS DECIMAL(20, 15)) AS u
            FROM s, range({mixing.DRAWS}) AS r(i)
        ), p AS (
            SELECT o.source, draw, u, abs(sum((floor(e.e + u) - floor(e.e - e.x + u)) * size) - any_value(target)) AS off
            FROM e JOIN o ON e.source IS NOT DISTINCT FROM o.source GROUP BY o.source, draw, u
        ), c AS (
            SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, draw) = 1
        )
        SELECT doc_id, size, source_size, target, CAST((floor(e.e + u) - floor(e.e - e.x + u)) * size AS BIGINT) AS taken
        FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source
    """,
    "op8_urlfilter": f"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), named(h, q, v, is_rule) AS (VALUES {_RULES_SQL}, {_LISTED_SQL}), made AS (
            SELECT 'listed-' || (i % {LISTED_MORE // 2}) || '.example' AS h, CASE WHEN i < {LISTED_MORE // 2} THEN '' ELSE '/p/' || i END AS q,
                   'block' AS v, false AS is_rule
            FROM range({LISTED_MORE}) AS r(i)
        ), l AS (
            SELECT * FROM named UNION ALL SELECT * FROM made
        ), ends AS (
            -- Every end of a host that begins at a label, so that the list is met by equality.
            SELECT DISTINCT host, array_to_string(string_split(host, '.')[k:], '.') AS h
            FROM (SELECT DISTINCT host FROM p), range(1, 1000) AS r(k) WHERE k <= len(string_split(host, '.'))
        ), f AS (
            SELECT p.page_id, l.*, row_number() OVER (PARTITION BY p.page_id ORDER BY is_rule DESC, length(l.h) + length(q) DESC, length(l.h) DESC) AS n
            FROM p JOIN ends ON p.host = ends.host JOIN l ON ends.h = l.h AND starts_with(p.path, l.q)
        )
        SELECT p.page_id, p.host, p.path, CASE WHEN f.is_rule THEN f.h || f.q END AS rule, coalesce(f.v, 'allow') AS verdict
        FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.n = 1
    """,
    "op12_manifest": manifest_sql(),
    "op13_codes": codes_sql(),
}
