"""Ingest of document files in batches, each chunk once, however often the run is stopped and started again.

A file stream brings a bounded number of files at a time. Each batch is split, cut to the embedding limits and merged by key
into the store: chunks that an earlier batch has stored are left out, and of equal chunks in a batch the first by order
stays. A batch writes its own directory of the store and overwrites it, so a batch that ended between its write and
Spark's commit, and comes again with the same files, leaves nothing twice. How many chunks it had, stored and had seen is
written beside it. The store's ids are the running set of what was seen: only that column is read, from the directories of
earlier batches, and the anti-join is shuffled by id; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from marlstone.functions import text as T
from marlstone.operators import split
from marlstone.operators.dedup import first_of
from marlstone.streaming.folders import exists, new_folder

SIZE, OVERLAP, KIND = 1100, 150, "section_text"
DOCUMENTS = "doc_id long, text string, source string"


def document_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, source_url, page, chunk_type, section_title, chunk_index, content, chunk_id) of (doc_id, text, source)."""
    d = docs.select("doc_id", F.col("source").alias("source_url"), T.clean(F.col("text")).alias("content"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(b, found: list[tuple]):
            row = pa.array([x[0] for x in found], pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string())], names=["doc_id", "source_url", "chunk_index", "content"])

        for b in batches:
            found, n = [], 0
            for i, text in enumerate(b.column(2)):
                for k, p in enumerate(split.text_pieces(text.as_py() or "", size, overlap)):
                    found.append((i, k, p))
                    n += len(p)
                if n >= split.HELD:
                    yield made(b, found)
                    found, n = [], 0
            if found:
                yield made(b, found)

    schema = P.StructType([d.schema["doc_id"], d.schema["source_url"], P.StructField("chunk_index", P.IntegerType()), P.StructField("content", P.StringType())])
    c = d.mapInArrow(run, schema).withColumns({"page": F.lit(None).cast("int"), "chunk_type": F.lit(KIND), "section_title": F.lit("")})
    return c.withColumn("chunk_id", split.chunk_id(F.coalesce("source_url", F.lit("")), F.col("page"), F.col("chunk_type"), F.col("section_title"), F.col("chunk_index"), F.col("content")))


def merge(chunks: DataFrame, batch: int, folder: str, order: list[str]) -> None:
    """Stores the chunks of a batch that no earlier batch has; the same batch again replaces what it stored."""
    spark, store = chunks.sparkSession, f"{folder}/chunks"
    first = split.embed_limits(first_of(chunks, "chunk_id", *order))
    if exists(spark, store):
        seen = spark.read.option("basePath", store).schema("chunk_id string, batch long").parquet(store).where(F.col("batch") < batch).select("chunk_id")
        first = first.join(seen, "chunk_id", "left_anti")
    first.write.mode("overwrite").parquet(f"{store}/batch={batch}")
    stored = spark.read.parquet(f"{store}/batch={batch}").count()
    spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(stored).alias("stored")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={batch}")


def ingest_files(spark: SparkSession, path: str, files: int = 4, folder: str | None = None) -> str:
    """Streams the document files of path into a store until they are used up, and returns its folder. Called again with
    that folder it goes on after the last batch that was committed."""
    folder = folder or new_folder(spark, "ingest")
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files).parquet(path)

    def batch(df: DataFrame, n: int) -> None:
        merge(document_chunks(df), n, folder, ["doc_id", "chunk_index"])

    docs.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return folder


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The store: chunks and the batch that each came with."""
    return spark.read.parquet(f"{folder}/chunks")
