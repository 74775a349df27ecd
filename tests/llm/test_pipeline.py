"""The pipeline on documents with planted cases."""

import corpus_pipeline as pipeline
import pytest
from kit import CLASHING
from pyspark.sql import functions as F

from tickstate.llm import queries


@pytest.fixture(scope="module")
def folder(spark):
    """Documents of sf0.001 with planted copies, a leak, personal data and junk."""
    from tickstate.llm.common import work_path

    path = work_path(spark, "tables")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) > 400").limit(60)
    item = spark.read.parquet(f"{source}/benchmark.parquet").orderBy("item_id").first().text
    first = docs.orderBy("doc_id").first()
    planted = [
        (10_000, first.text, "en", "copy"),
        (10_001, first.text + " tail", "en", "near"),
        (10_002, first.text[:200][::-1] + " " + item + " " + first.text[200:400][::-1], "en", "leak"),
        (10_003, first.text[::-1] + " write to jo@example.com or +49 30 1234567", "en", "pii"),
        (10_004, None, None, "null"), (10_005, "123 456 !!", "en", "no letters"),
        (10_006, first.text[100:][::-1], None, "unlabelled"), (None, first.text[50:300][::-1], "en", "no id"),
    ]
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string")
    more = more.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(more).unionByName(more.where("source = 'pii'"))
    docs.select("*", *[F.lit(1).alias(c) for c in CLASHING]).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path, first


def test_stages(spark, folder):
    path, first = folder
    docs = queries.table(spark, path, "documents")
    kept, before = {}, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, path)
        assert after.columns == list(pipeline.COLUMNS), name
        kept[name] = before = pipeline.staged(after, "stage")
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["language_id"] >= {10_000, 10_001, 10_002, 10_003, 10_006, None, first.doc_id}
    assert not ids["language_id"] & {10_004, 10_005}
    assert kept["language_id"].where("doc_id = 10006").first().lang is not None
    deduped = ids["minhash_near_dedup"]
    assert first.doc_id in deduped and not deduped & {10_000, 10_001} and None in deduped
    assert kept["minhash_near_dedup"].where("doc_id = 10003").count() == 1
    assert 10_002 not in ids["benchmark_decontamination"] and 10_003 in ids["benchmark_decontamination"]
    masked = kept["pii"].where("doc_id = 10003").first()
    assert masked.text.endswith("write to <EMAIL> or <PHONE>") and masked.n_chars == len(masked.text)
    packed = pipeline.STAGES[-1][1](spark, kept["pii"], path)
    assert {r.doc_id for r in packed.collect()} == ids["pii"]
    assert len(pipeline.run(spark, path).collect()) == packed.count()


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
