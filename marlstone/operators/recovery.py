"""What follows when governance leaves too little: a restricted second pool, merged behind the first; and saved sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def restrict_pool(pool: DataFrame, known: DataFrame, query: str = "query", family: str = "family") -> DataFrame:
    """Of each query current rows of pool, if any, else all; of those the ones of known families, if any, else all.

    pool has query, family and current (boolean); known has query and family. A query without known families keeps its
    whole pool.
    """
    k = known.where(F.coalesce(F.col(family), F.lit("")) != "").select(query, family).distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy(query)
    p = pool.join(k, [query, family], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    p = p.withColumn("_any", F.max("current").over(w)).where("current or not _any")
    return p.withColumn("_any", F.max("_known").over(w)).where("_known or not _any").drop("_any", "_known")


def merge_recovery(first: DataFrame, second: DataFrame, most: int = 2, query: str = "query", key: str = "key") -> DataFrame:
    """first, then up to `most` rows a query of second whose keys first lacks, ranked behind it; column recovery marks them.

    Both have query, key and rank. A key twice in second counts once, at its best rank.
    """
    s = second.groupBy(query, key).agg(F.min("rank").alias("rank")).join(first.select(query, key).distinct(), [query, key], "left_anti")
    w = Window.partitionBy(query).orderBy("rank", key)
    s = s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    last = first.groupBy(query).agg(F.max("rank").alias("_last"))
    s = s.join(last, query, "left").select(query, key, (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int").alias("rank"), F.lit(True).alias("recovery"))
    return first.select(query, key, F.col("rank").cast("int").alias("rank"), F.lit(False).alias("recovery")).unionByName(s)


def saved_versions(saves: DataFrame, session: str = "session_id", at: str = "at", expected: str = "expected", tie: str = "save_id", ttl: float = 3600.0) -> DataFrame:
    """saves with accepted (boolean) and version (long) of the stored session after each save.

    A save without an expected version always writes; one with it writes only if it equals the stored version (or the
    session does not exist). A session unwritten for longer than ttl (seconds) does not exist any more: its next save
    is version 1. The fold needs each session's saves in order: they are dealt by session and sorted, and a task
    streams through them with one version as its state, however many saves a session has.
    """
    from pyspark.sql import types as T

    d = saves.repartition(session).sortWithinPartitions(session, at, tie)
    s_at, t_at, e_at = (d.columns.index(c) for c in (session, at, expected))
    schema = T.StructType([*d.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("version", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, version, written = object(), 0, None
        for b in batches:
            ok, vs = [], []
            for s, t, e in zip(b.column(s_at).to_pylist(), b.column(t_at).to_pylist(), b.column(e_at).to_pylist(), strict=True):
                if s != now:
                    now, version, written = s, 0, None
                if written is not None and t - written > ttl:
                    version, written = 0, None
                yes = e is None or written is None or e == version
                if yes:
                    version, written = version + 1, t
                ok.append(yes)
                vs.append(version)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(vs, pa.int64())], names=[*b.schema.names, "accepted", "version"])

    return d.mapInArrow(run, schema)
