"""The corpus pipeline: documents through quality rules, language ID, near-duplicates and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import darts, language, packing, quality
from keelson.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the model trained on the labelled rows among docs."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or for which no language has half of the probability.

    Without any row that has a lang there is nothing to learn from, and all documents stay.
    """
    model = language.fit(docs)
    return language.keep_known(docs, model, least=0.5) if model.languages else docs


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near-duplicates."""
    return darts.keep_one(docs, size=5, least=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left; a row for each piece."""
    return packing.piece_crc32(packing.pack(docs))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", keep_one_of_each), ("packing", pack_sequences)]

#: Trained models, tokenisation and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
