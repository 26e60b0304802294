"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import embedding_dedup, language_id, ngram_join, packing, quality_classifier, quality_rules, schema_rewrite, sentencepiece_lattice, source_mixing, spelling_variants, suffix_tree, toxicity, warc_fixity
from marlstone.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learn_rows())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a fixity drill: pages against a replica with known damage."""
    pages = table(spark, sf_dir, "pages")
    return warc_fixity.audit(pages, warc_fixity.damaged(pages))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"), language_id.learn_rows())


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.digest_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"), suffix_tree.learn_rows())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_classifier.learn_rows())


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_report(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op13_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite of a drill: clients as files whose schemas have drifted, in a new folder that stays."""
    return schema_rewrite.drill(table(spark, sf_dir, "clients"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_warc_fixity, op4_embedding_dedup, op5_quality_rules, op6_language_id, op7_sentencepiece_lattice, op8_packing, op9_suffix_tree, op10_quality_classifier, op11_source_mixing, op12_spelling_variants, op13_schema_rewrite)
}
#: DuckDB SQL for those that SQL can express; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op3_warc_fixity": warc_fixity.DRILL_SQL, "op11_source_mixing": source_mixing.MIX_SQL}
