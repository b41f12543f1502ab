"""The training-data pipeline: each stage reads what the one before it wrote.

Stages take (spark, docs, sf_dir), all but the last return the columns of ``documents``:
toxicity drops texts that the network rejects, exact dedup keeps one row of each text, the n-gram join one
document of each group of near duplicates, the mix gives rows as often as their source's weight asks, and
packing cuts them into sequences. No stage can be said in SQL as a whole (a trained network, signatures,
tokenizers), so ``ORACLE_SQL`` is None and the tests hold run() against stage-by-stage plain versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from schemaloom.session import shared_folder

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold; labels of held-out documents are not learned from."""
    labels, out = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), toxicity.held_out()
    return toxicity.clean_rows(docs, toxicity.learn(docs.where(~out), labels.where(~out)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources),
          ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
