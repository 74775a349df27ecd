"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes all documents that the stage before kept and returns the columns
of ``documents``; the last returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.llm import decontaminate, language_id, near_dedup, packing, pii
from tickstate.llm.common import staged
from tickstate.llm.queries import lengths, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or unlike every learned language; name missing languages."""
    docs = docs.select(*COLUMNS)
    judged = language_id.identify(docs, language_id.train(docs.select("text", "lang")), keep=COLUMNS)
    return judged.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group, and one of rows that repeat it.

    Documents without doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    kept = found.where("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    named = (
        docs.where("doc_id is not null")
        .groupBy("doc_id", near_dedup.text_hash().alias("text_hash"))
        .agg(F.min(F.struct(*COLUMNS)).alias("row"))
        .join(kept, ["doc_id", "text_hash"], "left_semi")
        .select("row.*")
    )
    return named.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text, a null text stays null."""
    docs = docs.select(*COLUMNS).withColumn("_empty", F.col("text").isNull())
    found = pii.find_spans(docs, keep=("doc_id", "lang", "source", "n_chars", "_empty"))
    text = F.when(~F.col("_empty"), pii.masked(found))
    length = F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", length).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in bins of the permitted lengths."""
    return packing.pack(lengths(docs))


STAGES = [
    ("language_id", keep_identified),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # language models and packing are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
