"""Splitting texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed_windows(x: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of `size` characters every size - overlap; the last may be shorter."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(x) - overlap) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(x, i * step + 1, F.lit(size)))


def recursive_split(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that occurs and packed greedily.

    A piece starts with the last parts of the one before, up to overlap characters. Parts that are too long are split at
    the next separator, in the end between characters.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s == "" or s in text)
    parts = list(text) if sep == "" else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out, held, n = [], [], 0
    for p in parts:
        if len(p) > size:
            if held:
                out.append("".join(held))
            held, n = [], 0
            out += recursive_split(p, size, overlap, separators[separators.index(sep) + 1 :])
            continue
        if n + len(p) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


def table_split(markdown: str, size: int = 4000) -> list[str]:
    """Rows of a markdown table packed greedily under a repeated header; an over-long row is cut."""
    lines = [x for x in markdown.split("\n") if x.strip()]
    head, rows = lines[:2], lines[2:]
    room = max(1, size - sum(len(h) + 1 for h in head))
    out, held = [], []
    for r in (r[i : i + room] for r in rows for i in range(0, max(len(r), 1), room)):
        if held and sum(len(h) + 1 for h in held) + len(r) > room:
            out.append("\n".join([*head, *held]))
            held = []
        held.append(r)
    return [*out, "\n".join([*head, *held])] if held else out


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, chunk_id, chunk): Arrow batches in and out, no shuffle."""
    d = docs.select(id_col, text_col)
    kind = d.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(k, i, c) for k, t in enumerate(b.column(1).to_pylist()) for i, c in enumerate(recursive_split(t or "", size, overlap))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "chunk_index", "chunk"])

    out = d.mapInArrow(run, f"{id_col} {kind}, chunk_index int, chunk string")
    return out.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), F.substring(F.sha2("chunk", 256), 1, 16)), 256), 1, 16))


def batches_by_budget(sizes: Column, most: int, count: int) -> Column:
    """Batch numbers of an array of sizes: a new batch where the count or the budget is reached."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        fresh = ((acc["n"] + x > most) | (acc["k"] >= count)) & (acc["k"] > 0)
        b = F.when(fresh, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(F.concat(acc["out"], F.array(b)).alias("out"), b.alias("b"), F.when(fresh, x).otherwise(acc["n"] + x).cast("long").alias("n"), F.when(fresh, 1).otherwise(acc["k"] + 1).alias("k"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
