"""What the operators of this subpackage share: reading, hold-outs, staged tables and columns that do not clash."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.streaming.folders import CLEANUP, shuffles_dropped  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids fall in no bucket (-1)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(m), F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the driver
    is the only machine (tests). A cluster without the setting is an error: its executors share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        where = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")
        shared_dir.own = where
    return where.rstrip("/")


_STAGED: dict[str, SparkSession] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(path: str) -> None:
    spark = _STAGED.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    for path in list(_STAGED):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, S112  the session may be gone; the folder is the cluster's to clean
            continue


atexit.register(_drop_staged)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder as Parquet, in directories of the column `by` if given, and reads it again.

    This cuts the lineage: a lost executor costs no more than its own tasks, and what was computed in Python is
    computed once however often it is read. The tables go when the driver process ends, or with `unstaged` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Deletes tables as `staged` gave them, once all that reads them is staged itself."""
    for t in tables:
        _delete(_PATHS.pop(t))


def numbered(df: DataFrame, order: list[Column], to: str, name: str) -> DataFrame:
    """df with `to`, each row's number from 0 in the given order, staged.

    A range partitioning by the order takes the place of a window over all rows: each partition counts its own rows in
    order, and the partitions' counts (as many as spark.sql.shuffle.partitions) are added up. Give an order that tells
    the rows apart, or at least spreads a hot key: rows that are equal in it go to one partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1
    at = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(to, F.monotonically_increasing_id()), name)
    counts = at.groupBy(F.shiftright(to, 33).alias("p")).count().orderBy("p").collect()
    starts, n = [], 0
    for r in counts:
        starts.append((r["p"], n))
        n += r["count"]
    first = spark.createDataFrame(starts, "_part long, _first long")
    return at.join(F.broadcast(first), F.shiftright(to, 33) == F.col("_part")).select(*df.columns, (F.col("_first") + F.col(to).bitwiseAND(low)).alias(to))


def spare_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until df has no such column in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most per_class documents of each class 0 and 1 of `label`, chosen by a hash of the id.

    learn is a predicate on the id column of labels. An id with several labels counts by the largest. The ids are at
    most 2 * per_class rows, so the join to the documents broadcasts them: one scan of the texts, nothing is shuffled.
    """
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = lab.where("y = 0").orderBy(*order).limit(per_class).unionByName(lab.where("y = 1").orderBy(*order).limit(per_class))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(ids), "_id").select("_id", "text", "y")
