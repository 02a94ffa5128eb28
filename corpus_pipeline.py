"""Corpus preparation: documents in, packed training sequences out.

Every stage works on all that its predecessor kept.  Between stages the rows
are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import langid, mixing, neardup, packing, suffixes
from sluice.llm.common import discard, materialise, scratch
from sluice.llm.queries import tokenizer_file


#: Least share that a document's first language must have of it.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one main language go on, and ``lang`` says which.

    Null, empty and letterless texts go, and so do mixtures in which no language
    has LEAST_SHARE.  The model learns from the stage's own rows with a known language.
    """
    model = langid.train(docs.where(~langid.held_out()))
    told = docs.withColumn("_guess", langid.guess(model, F.col("text")))
    told = told.where((F.col("_guess.lang_pred") != langid.UNDETERMINED) & (F.get("_guess.lang_share", F.lit(0)) >= LEAST_SHARE))
    return told.withColumn("lang", F.col("_guess.lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.one_per_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere go; texts left empty go.

    Characters that a cut runs through go with it.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    made = suffixes.remove_repeats(docs, carry=rest, as_text=True).withColumnRenamed("kept", "text").where(F.col("text") != "")
    made = made.withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Texts without words are never taken; a null source is a source of its own, last in order;
    texts may be of any length, rows may repeat, and an empty table stays empty.
    """
    mixed = mixing.mix(docs)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.where("copies > 0").select(*docs.columns, copies.alias("_copy")).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row per piece of a document.

    A null text is an empty document, of one token; texts may be of any length, rows may
    repeat, and an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's tables go once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            made = keep(materialise(stage(spark, docs, sf_dir), f"stage{i + 1}"))
        if i:
            discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
