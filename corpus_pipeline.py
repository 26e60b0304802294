"""A corpus in four stages: quality rules, toxicity, near duplicates, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ngram_join, packing, quality_rules, toxicity
from marlstone.llm.common import spare_name, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the score is learned from the stage's own input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learn_rows())
    score, found = spare_name(docs, "toxicity_score"), spare_name(docs, "toxicity_passages")
    return toxicity.with_scores(docs, model, "text", score, found).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("ngram_join", distinct), ("packing", packed)]
#: No stage but the first's counts is a matter of SQL (learned thresholds and scores, exact binomial tests, tokenizers):
#: tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder as Parquet and read again; the tables go when the
    driver ends."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = staged(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
