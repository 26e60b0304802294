"""Quality by hashed word n-grams and logistic regression.

Features: words are runs of letters, of digits or of one kind of other characters. Hashed into SIZE places: single words
and pairs of neighbours; the same over the words' shapes (kind, capitals, length), which stand for the words that no
training text holds; and whether a word repeats the one before. A feature's value is its share of the family's
occurrences times SCALE, so a score is a sparse dot product: the sum over families of the mean weight. Weights are
trained by follow-the-regularised-leader on at most PER_CLASS labelled documents of each class, in the order of a
hash; the bias is moved to the classes' shares among all learnable labels.

Defined results: null and empty texts get the score of the bias alone; several labels of an id count by the largest; a
null id is scored and never learned from; equal texts have equal scores; repeated rows are scored each; very long texts
are read whole, in windows; without labels of both classes every score is the share of good labels (0.5 without labels);
an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import vectext as V
from marlstone.llm.common import id_bucket, labelled_sample
from marlstone.llm.ftrl import train

PER_CLASS, SIZE, SCALE, EPOCHS = 2000, 1 << 18, 30.0, 6
THRESHOLD = 0.3
_KINDS = np.full(256, 3, np.uint8)
_KINDS[V.SPACE] = 0
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2
for _i, _b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KINDS[_b] = 4 + _i


def hashed(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each family of features: the places in SIZE, and each row's first entry."""
    shapes: list[np.ndarray] = []
    h, first = V.word_hashes(data, off, kinds=_KINDS, shapes=shapes)
    sh = np.concatenate(shapes) if shapes else np.zeros(0, np.int64)
    fams, firsts = [], []
    mask = np.uint64(SIZE - 1)
    with np.errstate(over="ignore"):
        sh = V.mix(sh.astype(np.uint64) + np.uint64(77))
        for base in (h, sh):
            fams.append((base & mask).astype(np.int64))
            firsts.append(first)
            two, at = V.windows(base, first, 2)
            fams.append((V.mix(two + np.uint64(3)) & mask).astype(np.int64))
            firsts.append(np.searchsorted(at, first, "left"))
        same, at = (h[1:] == h[:-1]), np.arange(len(h) - 1)
        inner = np.ones(max(len(h) - 1, 0), bool)
        cut = first[1:-1] - 1
        inner[cut[(cut >= 0) & (cut < len(inner))]] = False
        fams.append(np.where(same[inner], 5, 6).astype(np.int64))
        firsts.append(np.searchsorted(at[inner], first, "left"))
    return fams, firsts


def _examples(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        ys, idx, val = b.column(1).to_pylist(), [], []
        data, off = V.buffers(b.column(0))
        for r in range(len(ys)):
            fams, _ = hashed(data, off[r : r + 2])
            parts = [(u, SCALE * c / len(f)) for f in fams if len(f) for u, c in [np.unique(f, return_counts=True)]]
            i = np.concatenate([u for u, _ in parts]) if parts else np.zeros(0, np.int64)
            x = np.concatenate([c for _, c in parts]) if parts else np.zeros(0)
            u, inv = np.unique(i, return_inverse=True)
            idx.append(u.astype(np.int32))
            val.append(np.bincount(inv, x, len(u)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), b.column(2)], names=["y", "idx", "val", "h"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights (SIZE + 1) as float32, the bias last. At most 2 * per_class sparse examples come to the driver."""
    by = {r["y"]: r["n"] for r in labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("quality").alias("y")).groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (by.get(1, 0) + 0.5) / (sum(by.values()) + 1)
    got = labelled_sample(docs, labels, "quality", learn, per_class).select("text", "y", F.xxhash64("_id", "text").alias("h")).mapInArrow(_examples, "y int, idx array<int>, val array<float>, h long").toArrow()
    y = got["y"].to_pylist()
    if len(set(y)) < 2:
        w = np.zeros(SIZE + 1, np.float32)
        w[-1] = math.log(share / (1 - share))
        return w
    rows = sorted(zip(got["h"].to_pylist(), y, got["idx"], got["val"], strict=True), key=lambda e: e[:2])  # rows with equal keys are equal
    ex = [(np.asarray(i.values, np.int64), np.asarray(v.values, float), t) for _, t, i, v in rows]
    w = train(ex, SIZE, epochs=EPOCHS)[:, 0]
    ones = sum(y)
    w[-1] += math.log(share / (1 - share)) - math.log(ones / (len(y) - ones))
    return w.astype(np.float32)


def scores(column, w: np.ndarray) -> np.ndarray:
    data, off = V.buffers(column)
    out = np.full(len(off) - 1, float(w[-1]))
    for i, j in V.slices(off):
        for f, first in zip(*hashed(data, off[i : j + 1]), strict=True):
            total = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
            n = np.diff(first)
            out[i:j] += SCALE * np.diff(total[first]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def with_scores(docs: DataFrame, w: np.ndarray, text_col: str, score_col: str) -> DataFrame:
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column(b.schema.get_field_index(text_col)), shared.value))], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    w = fit(docs, labels, learn, per_class)
    return with_scores(docs.select("doc_id", "text"), w, "text", "score").select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn_rows() -> Column:
    return id_bucket("doc_id", 5) != 0
