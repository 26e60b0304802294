"""Duplicates, differences and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order. dropDuplicates keeps any row; this one is the same in every run.

    Aggregates before the shuffle: of each key one struct (order, then all columns) travels per task.
    """
    k = F.col(key) if isinstance(key, str) else key
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*o))
    return df.groupBy(k.alias("_k")).agg(best.alias("_b")).select("_b.*")


def duplicate_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(key, n, first_id, extra) of each key with more than one row."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1").withColumn("extra", F.col("n") - 1)


def incremental(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with their keys: an idempotent keyed overwrite."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
