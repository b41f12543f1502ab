"""The pipeline's stages, each on what the one before kept, against plain versions."""

import re

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER).cache()
    assert clean.columns == columns and 0.7 * docs.count() < clean.count() <= docs.count()
    single = corpus_pipeline.drop_copies(spark, clean, FOLDER).cache()
    least = {}
    for r in clean.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(least.values())
    apart = corpus_pipeline.drop_near_copies(spark, single, FOLDER)
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} <= set(least.values())
    mixed = corpus_pipeline.mix_sources(spark, apart, FOLDER)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert mixed.columns == columns and words(mixed.collect()) == pytest.approx(1.5 * words(apart.collect()), rel=0.1)
    assert corpus_pipeline.pack_sequences(spark, mixed, FOLDER).selectExpr("sum(length)").first()[0] > 0
