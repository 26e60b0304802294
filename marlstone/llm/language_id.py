"""Language by sparse multinomial logistic regression on character n-grams.

A text is lower-cased, runs of other characters than letters become one space, and its 1- to 3-grams are hashed into
SIZE places. Values are TF-IDF: an n-gram's share of the text's n-grams of its length, times its inverse document
frequency among all learnable documents, times SCALE. Weights come from follow-the-regularised-leader with elastic-net
penalties on a sample of about PER_LANG documents of each language, by a hash of the id; with many languages fewer of
each, so that about MAX_SAMPLE in all come to the driver. A temperature, chosen by likelihood on a fifth of the sample
kept out of training, calibrates the probabilities. Learned are the MAX_LANGS languages with the most documents (equal
numbers in the order of their names).

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if nothing can be
learned; with one language every text with a letter has it; ties go to the first language in order; null ids are never
learned from; repeated rows are judged each; very long texts are read whole, in windows; an empty table gives no row;
only id, text and lang are read, and lang only of learnable rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import id_bucket
from marlstone.llm.ftrl import train

PER_LANG, MAX_SAMPLE, MAX_LANGS, SIZE, SCALE, EPOCHS, WINDOW = 600, 20_000, 500, 1 << 16, 20.0, 4, 1 << 16
NONE = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Places of the n-grams, for each length in turn and each window of the text; none without a letter.

    A window is WINDOW characters, with two more so that none is lost between windows; the text is taken whole.
    """
    low = (text or "").lower()
    last = np.zeros(0, np.uint32)  # the end of the window before
    for a in range(0, len(low), WINDOW):
        c = np.frombuffer(low[a : a + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(32))
        if not a:
            c = np.concatenate([[np.uint32(32)], c])
        if a + WINDOW >= len(low):
            c = np.concatenate([c, [np.uint32(32)]])
        c = np.concatenate([last, c])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        keep[: len(last)] = True
        c = c[keep]
        k = len(last)
        with np.errstate(over="ignore"):
            h = c.astype(np.uint32)
            for n in (1, 2, 3):
                if n > 1:
                    h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
                fresh = h[max(0, k - n + 1) :]
                x = (fresh ^ (fresh >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                yield n, ((x ^ (x >> np.uint32(13))) >> np.uint32(2)).astype(np.int64) & (SIZE - 1), c
        last = c[-2:]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the shares of the text's n-grams (each length sums to 1); empty without a letter."""
    total, of, letter = np.zeros(SIZE), [0, 0, 0], False
    per = [np.zeros(SIZE) for _ in of]
    for n, places, c in ngrams(text):
        per[n - 1] += np.bincount(places, minlength=SIZE)
        of[n - 1] += len(places)
        letter = letter or bool((c != 32).any())
    if not letter:
        return np.zeros(0, np.int64), np.zeros(0)
    for p, n in zip(per, of, strict=True):
        total += p / max(n, 1)
    at = np.flatnonzero(total)
    return at, total[at]


def _examples(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        got = [counts(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], names=["lang", "h", "idx", "val"])


def _present(batches: Iterator) -> Iterator:
    """(place, n): in how many texts each place occurs; place -1 counts the texts with a letter."""
    import pyarrow as pa

    n, texts, mark = np.zeros(SIZE, np.int64), 0, np.zeros(SIZE, bool)
    for b in batches:
        for t in b.column(0):
            letter = False
            for _, places, c in ngrams(t.as_py()):
                mark[places] = True
                letter = letter or bool((c != 32).any())
            at = np.flatnonzero(mark)
            mark[at] = False
            if letter:
                n[at] += 1
                texts += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], texts))], names=["place", "n"])


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The texts with a letter, and of each place those that hold it. At most SIZE + 1 rows come to the driver."""
    got = texts.mapInArrow(_present, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SIZE + 1)
    df[got["place"].to_numpy()] = got["n"].to_numpy()
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and weights (SIZE + 1, languages), with IDF and temperature folded in, the bias last."""
    d = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn)
    by = {r["lang"]: r["n"] for r in d.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not by:
        return [], np.zeros((SIZE + 1, 0), np.float32)
    # A row is taken if its hash lies under its language's share.
    each = min(per_lang, MAX_SAMPLE / len(by))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(by.items()) for x in (k, min(1.0, each / n)))), F.col("lang").cast("string"))
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    taken = d.where(F.pmod(h, F.lit(1 << 20)) < F.coalesce(share, F.lit(0.0)) * (1 << 20)).select("text", F.col("lang").cast("string").alias("lang"), h.alias("h"))
    got = taken.mapInArrow(_examples, "lang string, h long, idx array<int>, val array<float>").toArrow()
    rows = sorted(((h, g, np.asarray(i.values, np.int64), np.asarray(v.values, float)) for g, h, i, v in zip(got["lang"].to_pylist(), got["h"].to_pylist(), got["idx"], got["val"], strict=True) if len(i.values)), key=lambda r: (r[0], r[1], len(r[2])))
    langs = sorted({r[1] for r in rows})
    if not langs:
        return [], np.zeros((SIZE + 1, 0), np.float32)
    n, df = document_frequencies(d.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    ex = [(i, SCALE * v * idf[i], langs.index(g)) for _, g, i, v in rows]
    kept = [e for k, e in enumerate(ex) if k % 5 == 0]
    w = train([e for k, e in enumerate(ex) if k % 5] or ex, SIZE, len(langs), EPOCHS, alpha=0.3, l1=0.0005, l2=0.001) if len(langs) > 1 else np.zeros((SIZE + 1, 1))
    logits, y = np.array([v @ w[i] + w[-1] for i, v, _ in kept]), np.array([t for *_, t in kept])

    def loss(t: float) -> float:
        z = logits / t - (logits / t).max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    t = min(np.geomspace(0.2, 5, 49), key=loss)
    w = w / t
    w[:-1] *= SCALE * idf[:, None]
    return langs, w.astype(np.float32)


def predict(text: str | None, langs: list[str], w: np.ndarray) -> tuple[str, float]:
    sums, of, letter = [np.zeros(len(langs)) for _ in range(3)], [0, 0, 0], False
    for n, places, c in ngrams(text):
        sums[n - 1] += w[places].sum(0)
        of[n - 1] += len(places)
        letter = letter or bool((c != 32).any())
    if not letter or not langs:
        return NONE, 0.0
    z = w[-1] + sum(s / max(k, 1) for s, k in zip(sums, of, strict=True))
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p.argmax())
    return langs[k], float(p[k])


def identify_documents(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    langs, w = fit(docs, learn, per_lang)
    shared = docs.sparkSession.sparkContext.broadcast((langs, w))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, weights = shared.value
        for b in batches:
            got = [predict(t, known, weights) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", "text")
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def learn_rows() -> Column:
    return id_bucket("doc_id", 4) != 2
