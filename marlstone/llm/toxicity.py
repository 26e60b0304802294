"""Toxic passages by maximum-scoring segments.

Learning: in how many labelled toxic and clean documents each token occurs (a bounded sample, PER_CLASS of each, equal
texts once); tokens are words and word beginnings of PREFIXES letters, so that inflected forms add up. A token's score is
its log-odds between the classes with an informative Dirichlet prior (pseudo-counts in proportion to the pooled
frequencies, PRIOR_MASS in all), above zero or below, if it lies over Z_LEAST standard errors from zero; all other tokens
cost GAP, so that the expected score is negative. The model has at most MAX_TOKENS scores, those furthest from zero in
standard errors. A word scores the best of itself and its beginnings if one is above zero, else the worst. Scan: one
linear pass (Ruzzo and Tompa) finds all maximal scoring segments. Extreme values: on the clean documents of the sample's
other half the segments over a high quantile give the decay lambda and the constant K of E = K n exp(-lambda S); a
document's evidence is the sum of -log E over its significant segments. A logistic curve on that evidence, fitted on the
same half, gives a score from 0 to 1.

Defined results: null, empty and wordless texts have no segment and get the score of no evidence; equal texts with
different labels count by the largest; a null id is scored and never learned from; repeated rows are scored each; very
long texts are scanned whole; without labels of both classes every score is 0; an empty table gives no row; tokens with
equal standing are taken in the order of their letters; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import id_bucket, labelled_sample, staged

#: Bounds and constants of the model.
PER_CLASS, MAX_TOKENS = 3000, 50_000
PRIOR_MASS, Z_LEAST, GAP, E_MOST = 10_000.0, 3.0, 0.25, 0.5
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7

_PLAIN = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 or b == 39 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, with inner apostrophes."""
    if not text:
        return []
    if text.isascii():
        out = text.encode().translate(_PLAIN).decode().split()
        return [x.strip("'") for x in out] if "'" in text else out
    return _WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its proper beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Scores(dict):
    """token -> score, with the first letters of all tokens."""

    def __init__(self, *a):
        super().__init__(*a)
        self.heads = {k.rstrip("*")[:3] for k in self}


def word_scores(toks: list[str], scores: Scores) -> list[tuple[int, float]]:
    """Places with a score of their own, in order."""
    heads = scores.heads
    best: dict[str, float] = {}
    hits = []
    for i, w in enumerate(toks):
        if w[:3] in heads:
            s = best.get(w)
            if s is None:
                own = [scores[f] for f in forms(w) if f in scores]
                top = max(own, default=0.0)
                s = best[w] = top if top >= 0 else min(own)
            if s:
                hits.append((i, s))
    return hits


def segments(hits: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first place, last place, score), in linear time.

    hits: places in order with their scores; every place between two hits costs gap.
    """
    kept: list[list[float]] = []  # first, last, cumulative score before, cumulative score after
    links: list[int] = []
    total, last = 0.0, -1
    for at, s in hits:
        total -= gap * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        seg = [at, at, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j = links[j]
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                links.append(j)
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:], links[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in kept]


def passages(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    toks = tokens(text)
    return len(toks), segments(word_scores(toks, scores))


def evidence(n: int, segs: list[tuple[int, int, float]], lam: float, k: float) -> tuple[float, int]:
    """Sum of -log E over the significant segments, and their number."""
    base = math.log(max(k * max(n, 1), 1e-300))
    each = [lam * s - base for _, _, s in segs]
    good = [x for x in each if x >= -math.log(E_MOST)]
    return sum(good), len(good)


def _counts(batches: Iterator) -> Iterator:
    from collections import Counter

    import pyarrow as pa

    by = (Counter(), Counter())
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by[y].update({f for w in set(tokens(text)) for f in forms(w)})
        if sum(map(len, by)) > 200_000:
            yield from _sent(by, pa)
    yield from _sent(by, pa)


def _sent(by, pa) -> Iterator:
    toks = list(by[0].keys() | by[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(toks, pa.string()), pa.array([by[0][t] for t in toks], pa.int64()), pa.array([by[1][t] for t in toks], pa.int64())], names=["token", "n0", "n1"])
    by[0].clear(), by[1].clear()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> dict:
    """The model: {"scores": token -> score, "lam", "k", "bias", "slope"}; {} without both classes."""
    sample = staged(labelled_sample(docs, labels, "toxic", learn, per_class).groupBy("text").agg(F.max("y").alias("y")), "toxic-sample")
    half = F.xxhash64(F.col("text"), F.lit(7)) % 2 == 0
    counts = staged(sample.where(half).select("text", "y").mapInArrow(_counts, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-counts")
    m = counts.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).first()
    if not m["a"] or not m["b"]:
        return {}
    share = (F.col("n0") + F.col("n1")) / F.lit(float(m["a"] + m["b"]))
    prior = F.lit(PRIOR_MASS) * share
    p0, p1 = F.col("n0") + prior, F.col("n1") + prior
    odds = F.log(p1 / (m["b"] + PRIOR_MASS - p1)) - F.log(p0 / (m["a"] + PRIOR_MASS - p0))
    err = F.sqrt(1 / p0 + 1 / p1)
    top = counts.select("token", odds.alias("s"), (odds / err).alias("z")).where(F.abs("z") > Z_LEAST).orderBy(F.abs("z").desc(), "token").limit(MAX_TOKENS).collect()
    scores = {r["token"]: r["s"] for r in top}
    other = sample.where(~half).select("text", "y").mapInArrow(_scan(scores), "y int, n long, s array<double>").collect()
    clean = [(r["n"], r["s"]) for r in other if r["y"] == 0]
    lam, k = tail([s for _, x in clean for s in x], sum(n for n, _ in clean))
    rows = [(math.log1p(evidence(r["n"], [(0, 0, s) for s in r["s"]], lam, k)[0]), r["y"]) for r in other]
    bias, slope = logistic(rows)
    return {"scores": scores, "lam": lam, "k": k, "bias": bias, "slope": slope}


def _scan(found: dict[str, float]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = Scores(found)
        for b in batches:
            got = [passages(t, scores) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in x] for _, x in got], pa.list_(pa.float64()))], names=["y", "n", "s"])

    return run


def tail(seg: list[float], n: int) -> tuple[float, float]:
    """lambda and K from the segments of clean documents with n tokens: the exponential tail over their 0.75 quantile.

    With fewer than 20 segments there is no tail to fit: lambda 1 and the K that expects as many segments as were seen.
    """
    seg = sorted(seg)
    if len(seg) < 20:
        return 1.0, (len(seg) + 1.0) / max(n, 1)
    over = seg[3 * len(seg) // 4 :]
    lam = 1.0 / max(sum(over) / len(over) - over[0], 0.5)
    return lam, len(over) * math.exp(lam * over[0]) / max(n, 1)


def logistic(rows: list[tuple[float, int]], ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope (not negative) by Newton's method."""
    import numpy as np

    if len({y for _, y in rows}) < 2:
        return -math.log(2.0 + len(rows)), 1.0
    x = np.array([[1.0, a] for a, _ in rows])
    y = np.array([b for _, b in rows], float)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), max(float(w[1]), 0.0)


def score_of(model: dict, n: int, segs: list[tuple[int, int, float]]) -> float:
    if not model:
        return 0.0
    e, _ = evidence(n, segs, model["lam"], model["k"])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model["bias"] + model["slope"] * math.log1p(e)))))


def with_scores(docs: DataFrame, model: dict, text_col: str, score_col: str, passages_col: str) -> DataFrame:
    """docs with a score and the number of significant passages. The model is at most MAX_TOKENS entries."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(passages_col, T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        scores = Scores(m.get("scores", {}))
        for b in batches:
            got = [passages(t, scores) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score_of(m, *x) for x in got], pa.float64()), pa.array([evidence(*x, m["lam"], m["k"])[1] if m else 0 for x in got], pa.int64())], names=[*b.schema.names, score_col, passages_col])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages for every document."""
    model = fit(docs, labels, learn, per_class)
    scored = with_scores(docs.select("doc_id", "text"), model, "text", "score", "n_passages")
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def learn_rows() -> Column:
    return id_bucket("doc_id", 3) != 1
