"""Mixing sources to target weights.

Sizes are words. A source's target is its weight's part of SHARE of all words, but at most CAP times its own words; what
is over goes to the others by weight, again and again until none is above. Its rate is target / words. Every document is
taken floor(rate) times, and once more if its hash lies under the source's cut: a hash-seeded Bernoulli copy whose
probability is the rate's fraction. The cut isn't put at the fraction of the hash's range but at the fraction of the
source's words (those of all documents whose hashes lie below), because a few long documents would else carry a source
far from its target; over many documents the two are the same. A source misses its target by half a document at most.

How: the texts are read once, for their sizes. Sums by source and by the leading bits of the hash are combined before
they are shuffled; the cut is narrowed in three steps (LEVELS), each reading only the hashes that share the bits found so
far, so no step holds the documents of a source together. Sources are numbered by a range partitioning. The reshare
brings two sums to the driver a round.

Defined results: a null text has size 0; a null source is a source, the last; a source without words has target 0; rows
with the same id share their hash, and so do all null ids, so that they are taken together; size-0 documents are taken 0
words; an empty table gives no row; very long texts are counted in windows; extra columns change nothing, and the
documents emitted keep them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import numbered, spare_name, staged

#: Weights of the sources in code-point order, repeating; the words to take as a share of all; most words of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
SEED = "mix"
#: Bits of a hash, and how many of them are open after each step.
BITS, LEVELS = 60, (48, 36, 0)


def word_counts(column) -> list[int]:
    """Words of an Arrow string column by row, in windows of bytes."""
    import numpy as np

    from marlstone.llm import vectext as V

    data, off = V.buffers(column)
    out = np.zeros(len(off) - 1, np.int64)
    for a in range(int(off[0]), int(off[-1]), V.WINDOW):
        b = min(a + V.WINDOW, int(off[-1]))
        solid = ~V.SPACE[data[a:b]]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        if a > int(off[0]):
            first[0] &= V.SPACE[data[a - 1]]
        i, j = np.searchsorted(off, a, "left"), np.searchsorted(off, b, "left")
        first[off[i:j] - a] |= solid[off[i:j] - a]
        lo, hi = max(int(np.searchsorted(off, a, "right")) - 1, 0), min(int(np.searchsorted(off, b, "left")), len(out))
        total = np.concatenate([[0], np.cumsum(first)])
        out[lo:hi] += np.diff(total[np.clip(off[lo : hi + 1] - a, 0, b - a)])
    return out


def draw(doc_id: Column) -> Column:
    """BITS bits of a hash of the id."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, draw, size) of every document."""
    from pyspark.sql import types as T

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), draw(F.col(id_col)).alias("draw"), F.col(text_col).alias("text"))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("size", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(word_counts(b.column(3)), pa.int64())], names=schema.names)

    return d.mapInArrow(run, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of every source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = numbered(sums, [F.asc_nulls_last("source")], "no", "mix-sources")
    s = s.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).alias("weight"))
    most = cap * F.col("source_size")
    level, capped = 0.0, -1
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        over = most < level * F.col("weight")
        x = s.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, most)), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w")).first()
        if x.n <= capped or not x.w:
            break
        level, capped = (share * total - x.held) / x.w, x.n
    return s.select("source", "source_size", F.when(over, most.cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def rates(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with each source's whole copies (times) and the largest hash that gets one more (cut)."""
    goal = goals.withColumn("times", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long"))
    at = goal.select(F.col("source").alias("_s"), (F.col("target") - F.col("times") * F.col("source_size")).alias("want"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bits"))
    same, opened = F.col("source").eqNullSafe(F.col("_s")), BITS
    for shift in LEVELS:
        by = F.shiftright("draw", shift).alias("_b")
        if opened == BITS:  # summed before the join: every document is in
            part = sizes.groupBy("source", by).agg(F.sum("size").alias("part")).join(at, same)
        else:
            part = sizes.join(at, same & (F.shiftright("draw", opened) == F.col("bits"))).groupBy("source", by).agg(F.sum("size").alias("part"), F.first("want").alias("want"), F.first("before").alias("before"))
        w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("below", F.col("before") + F.coalesce(F.sum("part").over(w), F.lit(0)))
        if shift:
            inside = (F.col("below") <= F.col("want")) & (F.col("want") < F.col("below") + F.col("part"))
            at = part.where(inside).select(F.col("source").alias("_s"), "want", F.col("below").alias("before"), F.col("_b").alias("bits"))
            opened = shift
            first = at.select(F.col("_s"), F.shiftleft("bits", opened).alias("_first"))
    hit = part.where(F.col("below") + F.col("part") / 2 <= F.col("want")).groupBy(F.col("source").alias("_t")).agg(F.max("_b").alias("_hit"))
    cut = first.join(hit, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", F.coalesce(F.col("_hit"), F.col("_first") - 1).alias("cut"))
    return goal.join(cut, same, "left").select(*goal.columns, F.coalesce("cut", F.lit(-1)).alias("cut"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The sizes of the documents and the rates of the sources."""
    sizes = staged(sized(docs, id_col, text_col, source_col), "mix-sizes")
    return sizes, staged(rates(sizes, targets(sizes, weights, share, cap)), "mix-rates")


def _copies(docs: DataFrame, rate: DataFrame, drawn: Column, source: Column) -> DataFrame:
    """docs with the rate's columns (each after an underscore) and _copies."""
    r = rate.select(*(F.col(c).alias(f"_rate_{c}") for c in rate.columns))
    return docs.join(r, source.eqNullSafe(F.col("_rate_source"))).withColumn("_copies", F.col("_rate_times") + F.when(drawn <= F.col("_rate_cut"), 1).otherwise(0))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sizes, rate = plan(docs, id_col, text_col, source_col)
    d = _copies(sizes, rate, F.col("draw"), F.col("source"))
    return d.select("doc_id", "size", F.col("_rate_source_size").alias("source_size"), F.col("_rate_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: docs, each as often as it is taken, with copy_no from 1. The texts aren't shuffled unless the
    sources are too many to broadcast."""
    _, rate = plan(docs, id_col, text_col, source_col, weights, share, cap)
    no = spare_name(docs, "copy_no")
    d = _copies(docs, rate, draw(F.col(id_col)), F.col(source_col)).where("_copies > 0")
    return d.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias(no))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open, sum(source_size) OVER () AS total
  FROM src WINDOW w AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_max((CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(open AS DOUBLE), open) AS level FROM fill
  WHERE (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(open AS DOUBLE) * weight <= 2 * source_size),
goal AS (
  SELECT source, source_size, CASE WHEN 2 * source_size < level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM src, level),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM goal),
words AS (SELECT source, draw, CAST(sum(size) AS BIGINT) AS part FROM sized GROUP BY source, draw),
summed AS (SELECT *, CAST(coalesce(sum(part) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM words)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (r.times + CASE WHEN s.below + s.part / CAST(2 AS DOUBLE) <= r.target - r.times * r.source_size THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source
JOIN summed s ON d.source IS NOT DISTINCT FROM s.source AND d.draw = s.draw
"""
