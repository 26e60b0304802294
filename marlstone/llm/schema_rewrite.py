"""Rewriting the drifted files of a table to one evolved schema, matching columns by their Parquet field ids.

The table is a folder of Parquet files, one in each directory `<key>=<value>`. Their footers are scanned in tasks; files
with the same columns (id, name, type, order) have the same fingerprint. For each distinct fingerprint there is one
native projection to the evolved schema: a column of the same id is cast, whatever its name and place; one that is
missing gets its default; nulls that were stored stay null. The projections are united, shuffled by file, sorted by row
index within it and written over the drifted files' own directories (dynamic partition overwrite: Spark writes beside
them and swaps the directories when the whole job has committed). Files of the evolved schema are never opened for
writing. A file is written by one task, streaming. The driver holds the distinct schemas, and the files' paths, as
Spark's own file index does.

Footers are read with Arrow's file systems, so the folder has to be one that they and Spark both reach (file, hdfs, s3).

Defined results: a table without rows has no file and gives no row; ids, names and values can be null, `?` in a digest;
a null client_id sorts as an empty text, before the others of that hash; rows with the same client_id are ordered by
a hash of their other columns, so that a hot one is spread, and copies of a row can stand in any order; extra columns of
the table aren't carried into the files; two files in one directory are an error, as is a column whose type can't be cast.
A NaN or infinite balance is written into the digest by its name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import numbered, shared_dir, staged

FIELD_ID = "parquet.field.id"
#: The columns of clients in order; their field ids are 1 to 10.
COLUMNS = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")
DEFAULTS = {"nation_id": -1, "source": "none"}
#: Files at most (about), and the drift of a file: its version is a crc32 modulo MODULUS, those above TOP are 0.
FILES, MODULUS, TOP = 500, 24, 15
SWAP, REVERSE, MISSING, NARROW = 1, 2, 4, 8


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def footers(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, path, columns, fingerprint) of every Parquet file below folder; columns is JSON of [id, name, type]."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(_uri(path))
                fields = pq.read_schema(name, filesystem=store)
                columns = json.dumps([[int((f.metadata or {}).get(b"PARQUET:field_id", -1)), f.name, str(f.type)] for f in fields])
                out.append((_uri(path), columns, hashlib.sha256(columns.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)] if out else [pa.array([], pa.string())] * 3, names=["path", "columns", "fingerprint"])

    found = files.repartition(parts, "path").mapInArrow(run, "path string, columns string, fingerprint string")
    return found.select(F.regexp_extract("path", f"/{key}=(-?[0-9]+)/", 1).cast("long").alias(key), "*")


def evolved_field(f: T.StructField, field_id: int) -> T.StructField:
    return T.StructField(f.name, f.dataType, True, {FIELD_ID: field_id})


def _project(df: DataFrame, ids: dict[int, str], evolved: T.StructType, defaults: dict, row: Column) -> list[Column]:
    """evolved's columns from those of df with the same field ids."""
    out = []
    for f in evolved:
        have = ids.get(f.metadata[FIELD_ID])
        # a default stands under a condition that always holds, so that its column stays nullable
        out.append((F.col(f"`{have}`") if have else F.when(row >= 0, F.lit(defaults.get(f.name)))).cast(f.dataType).alias(f.name))
    return out


def rewrite(spark: SparkSession, folder: str, key: str, evolved: T.StructType, defaults: dict) -> DataFrame:
    """Rewrites the drifted files below folder in place; (key, path, columns, fingerprint, rewritten) as they were.

    evolved: fields with FIELD_ID in their metadata.
    """
    files = staged(footers(spark, folder, key), "rewrite-footers")
    if twice := files.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key}={twice[0][0]} has {twice[0][1]} files; a directory has to hold one")
    kinds = files.groupBy("fingerprint").agg(F.first("columns").alias("columns"), F.min("path").alias("path")).orderBy("fingerprint").collect()
    wanted = [(f.metadata[FIELD_ID], f.name, f.dataType) for f in evolved]
    same, plans = [], []
    row, at = F.col("_metadata.row_index"), "_row"
    while at in evolved.names or at == key:
        at = "_" + at
    for kind in kinds:
        physical = spark.read.parquet(kind["path"]).schema
        have = [(x[0], f.name, f.dataType) for x, f in zip(json.loads(kind["columns"]), physical, strict=True)]
        if have == wanted:
            same.append(kind["fingerprint"])
            continue
        paths = [r[0] for r in files.where(F.col("fingerprint") == kind["fingerprint"]).select("path").collect()]
        df = spark.read.option("basePath", folder).schema(physical).parquet(*paths)
        plans.append(df.select(F.col(key).cast("long").alias(key), row.alias(at), *_project(df, {i: n for i, n, _ in have}, evolved, defaults, row)))
    if plans:
        rows = plans[0]
        for p in plans[1:]:
            rows = rows.unionByName(p)
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, at)
        rows = rows.select(key, *(F.col(f.name).alias(f.name, metadata=f.metadata) for f in evolved))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    return files.withColumn("rewritten", ~F.col("fingerprint").isin(same))


def crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def version(file_no: Column) -> Column:
    v = crc(F.concat(F.lit("42:"), file_no.cast("string"))) % MODULUS
    return F.when(v > TOP, 0).otherwise(v)


def dealt(clients: DataFrame) -> DataFrame:
    """clients' columns and each row's number r, file_no and version."""
    c = clients.select(*COLUMNS, crc(F.coalesce(F.col("client_id").cast("string"), F.lit(""))).alias("_crc"), F.xxhash64(*COLUMNS[1:]).alias("_rest"), F.monotonically_increasing_id().alias("_copy"))
    n = numbered(c, [F.col(x) for x in ("_crc", "client_id", "_rest", "_copy")], "r", "rewrite-rows")
    rows = n.count()
    return n.select(*COLUMNS, "r", F.expr(f"r div {1 + rows // FILES}").alias("file_no")).withColumn("version", version(F.col("file_no")))


def drift(evolved: T.StructType, v: int) -> list[Column]:
    """The columns of a file of version v, from those of the evolved schema."""
    name = dict(zip(("name", "email"), ("email", "name"))) if v & SWAP else {}
    kind = {"balance": "float", "nation_id": "int"} if v & NARROW else {}
    out = [F.col(f.name).cast(kind.get(f.name, f.dataType)).alias(name.get(f.name, f.name), metadata=f.metadata) for f in evolved if not (v & MISSING and f.name in DEFAULTS)]
    return [out[0], *reversed(out[1:])] if v & REVERSE else out


def write_drifted(clients: DataFrame, folder: str) -> T.StructType:
    """Writes clients as drifted files below folder, one in each file_no=..., and returns the evolved schema."""
    spark = clients.sparkSession
    kinds = {f.name: f for f in clients.schema} | {"nation_id": T.StructField("nation_id", T.LongType())}
    evolved = T.StructType([evolved_field(kinds[c], i + 1) for i, c in enumerate(COLUMNS)])
    rows = staged(dealt(clients), "rewrite-dealt", "version")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for v in range(TOP + 1):
        d = rows.where(F.col("version") == v).repartition(parts, "file_no").sortWithinPartitions("file_no", "r")
        d.select("file_no", *drift(evolved, v)).write.mode("append").partitionBy("file_no").parquet(folder)
    return evolved


def digests(files: DataFrame, parts: int) -> DataFrame:
    """(file_no, n_rows, n_nulls, ids_sha256, rows_sha256): files' rows in order, one task a file, streaming."""
    text = [F.unix_micros(F.col(c).cast("timestamp")) if c == "updated_at" else F.col(c) for c in COLUMNS[:-1]]
    head = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("?")) for c in text))
    nulls = sum((F.col(c).isNull().cast("long") for c in COLUMNS), F.lit(0))
    d = files.select(F.col("file_no").cast("long").alias("file_no"), F.col("_metadata.row_index").alias("_row"), nulls.alias("_nulls"), F.coalesce(F.col("client_id").cast("string"), F.lit("?")).alias("_id"), head.alias("_head"), F.col("balance"))

    def run(batches: Iterator) -> Iterator:
        import math

        import pyarrow as pa

        def ended():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([nulls]), pa.array([ids.hexdigest()]), pa.array([rows.hexdigest()])], names=["file_no", "n_rows", "n_nulls", "ids_sha256", "rows_sha256"])

        at = None
        for b in batches:
            for file_no, _, null, key, head, balance in zip(*(c.to_pylist() for c in b.columns)):
                if file_no != at:
                    if at is not None:
                        yield ended()
                    at, n, nulls, ids, rows = file_no, 0, 0, hashlib.sha256(), hashlib.sha256()
                last = "?" if balance is None else str(math.floor(1048576 * balance)) if math.isfinite(1048576 * balance) else str(balance)
                ids.update(("," * (n > 0) + key).encode())
                rows.update(("\n" * (n > 0) + head + "|" + last).encode())
                n, nulls = n + 1, nulls + null
        if at is not None:
            yield ended()

    ordered = d.repartition(parts, "file_no").sortWithinPartitions("file_no", "_row")
    return ordered.mapInArrow(run, "file_no long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def drill(clients: DataFrame) -> DataFrame:
    """Writes clients as drifted files in a new folder, rewrites them there and reports every final file."""
    spark = clients.sparkSession
    folder = f"{shared_dir(spark)}/marlstone-rewritten-{uuid.uuid4().hex}"
    evolved = write_drifted(clients, folder)
    began = rewrite(spark, folder, "file_no", evolved, DEFAULTS)
    names = F.array_join(F.transform(F.from_json("columns", "array<array<string>>"), lambda x: x[1]), ",")
    start = began.select("file_no", names.alias("start_columns"), "rewritten")
    final = footers(spark, folder, "file_no").select("file_no", names.alias("columns"), "path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = digests(spark.read.schema(evolved).parquet(folder), parts) if start.limit(1).collect() else spark.createDataFrame([], "file_no long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")
    out = start.join(final, "file_no").join(found, "file_no")
    return out.select("file_no", version(F.col("file_no")).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
