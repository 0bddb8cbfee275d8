"""The corpus pipeline: drop toxic and poor documents, near copies and benchmark leaks, then pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage as Parquet in the
shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlens.llm import decontam, packing, quality, simhash, toxicity
from feedlens.llm.catalog import vocabulary_path
from feedlens.llm.common import id_fold, staged, table


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects (score below 0.7) go."""
    model, prior = quality.fit_quality(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", 4) != 2)
    return quality.keep_good(docs, model, prior)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 4096 tokens, one row per piece."""
    return packing.pack_documents(docs, vocabulary_path(), end_id=2)


STAGES = [
    ("toxicity", clean_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Models and tokenizers can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
