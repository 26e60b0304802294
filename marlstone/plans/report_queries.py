"""Queries of text validation, regression reports and load scenarios, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import quality as Q
from marlstone.operators import evaluate as E

DELTAS = [("pass_rate", -0.03), ("toxic_rate", 0.02), ("missing_metric", -0.05)]


def ocr_garbage(spark, d):
    text = F.col("text")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", Q.meaningful_length(text).cast("long").alias("meaningful"), Q.ocr_garbage(text).alias("garbage"))


def regression_deltas(spark, d):
    """Labels of even ids as the baseline, those of odd ids as the candidate."""
    labels = spark.read.parquet(f"{d}/labels.parquet")

    def metrics(rest: int):
        means = labels.where(F.col("doc_id") % 2 == rest).agg(F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))
        return means.unpivot([], ["pass_rate", "toxic_rate"], "name", "value")

    return E.regression_deltas(metrics(0), metrics(1), spark.createDataFrame(DELTAS, "name string, bound double"))


def scenario_stats(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    hit = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3 == 1)
    return E.scenario_stats(events, "event_type", "ts", F.col("value") >= 10, hit, F.col("event_id") % 10 == 0)


_LETTERS = "coalesce(length(regexp_replace(text, '[^0-9A-Za-zÀ-ɏ]', '', 'g')), 0)"
_MEANS = "SELECT 'pass_rate' AS name, round(avg(quality), 6) AS value FROM labels WHERE doc_id % 2 = {0} UNION ALL SELECT 'toxic_rate', round(avg(toxic), 6) FROM labels WHERE doc_id % 2 = {0}"
_VALUES = ", ".join(f"({n!r}, {b}::DOUBLE)" for n, b in DELTAS)

QUERIES = {f.__name__: f for f in (ocr_garbage, regression_deltas, scenario_stats)}
ORACLE_SQL = {
    "ocr_garbage": f"SELECT doc_id, {_LETTERS}::BIGINT AS meaningful, CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0::DOUBLE ELSE ((20000 * (length(text) - {_LETTERS}) + length(text)) // (2 * length(text)))::DOUBLE / 10000 END AS garbage FROM documents",
    "regression_deltas": f"WITH t(name, bound) AS (VALUES {_VALUES}), b AS ({_MEANS.format(0)}), c AS ({_MEANS.format(1)}), j AS (SELECT t.name, b.value AS baseline, c.value AS candidate, round(c.value - b.value, 4) AS delta, bound FROM t LEFT JOIN b USING (name) LEFT JOIN c USING (name)) SELECT *, coalesce(CASE WHEN bound < 0 THEN delta < bound ELSE delta > bound END, false) AS failed FROM j",
    "scenario_stats": "SELECT event_type, count(*) AS requests, CASE WHEN max(ts) > min(ts) THEN round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) END AS rps, round(round(avg((NOT coalesce(value >= 10, false))::INT), 6) * 100, 4) AS error_rate, round(avg(CASE WHEN user_id % 3 > 0 THEN (user_id % 3 = 1)::INT END), 6) AS hit_ratio, round(avg((event_id % 10 = 0)::INT), 6) AS recovery_frequency FROM events GROUP BY 1",
}
