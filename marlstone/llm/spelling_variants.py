"""Grouping spelling variants: words that differ by one inserted, deleted or replaced code point.

Words of the texts are counted in tasks, combined before they are shuffled. Every word gets a polynomial hash of itself and
one of each of its deletions; prefix and suffix sums make all of them vectorised NumPy integers (mod 2**64). These keys are
dealt by their leading bits (radix), sorted, and rows of one key meet in a streaming pass:

- deletions of equal-long words at the same place: the words differ there only (a replacement);
- a deletion of a word and a shorter word itself: an insertion or deletion.

The strings decide, so hash collisions cost time only. A key's rows are bounded by letters times places, and no pairs are
written: each word gets its number of near words at that key and the best of them, which sums and minima put together,
as no pair of words meets twice (a replacement at one place, an insertion at one string). Words over LONG code points
don't travel with each of their keys: their pairs go by a hash of the word, get the strings by a join and are then compared.

A word's form is its near word with the largest count (ties: the smallest), if that count is RATIO times the word's own; its
root is where the forms lead. Counts grow along them, so no cycle; the roots are found by pointer doubling in tables.

Defined results: null texts have no words; a null doc_id counts as an empty one; repeated rows count each; very long texts
are read in windows; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged

#: Code points of a word at least, its occurrences at least, and how much commoner a form is.
LEAST, TIMES, RATIO = 7, 2, 10
#: A run loses a code point where this divides its hash (the drill's misspellings).
DELETED = 31
LONG, WINDOW, FLUSH, SLICE, RADIX = 256, 1 << 20, 200_000, 1 << 22, 16
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters, by windows of the text that end at a run's end."""
    a = 0
    while a < len(text):
        b = a + WINDOW
        if b < len(text) and (m := RUN.match(text, b)):
            b = m.end()
        yield RUN.findall(text, a, b)
        a = b


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs(text.as_py() or ""):
                    for word, n in Counter(found).items():
                        if len(word) < least:
                            continue
                        word = word.translate(_LOWER)
                        h = zlib.crc32(word.encode(), begun)
                        if h % DELETED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                    if len(total) > FLUSH:
                        yield out()
                        total = Counter()
        if total:
            yield out()

    parts = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def deletion_keys(words: list[str]):
    """For equal-long words: int64 keys of each word's deletions by place, and of the word itself in the last column."""
    import numpy as np

    from marlstone.llm.vectext import mix

    size = len(words[0])
    with np.errstate(over="ignore"):
        v = mix(np.array(words, f"U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1))
        power = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        prefix = np.cumsum(v * power, axis=1, dtype=np.uint64)  # of the places up to and with each
        moved = v.copy()
        moved[:, 1:] *= power[:-1]
        moved[:, 0] = 0
        suffix = np.cumsum(moved, axis=1, dtype=np.uint64)
        suffix = suffix[:, -1:] - suffix  # of the places after each, one to the left
        out = np.empty((len(words), size + 1), np.uint64)
        out[:, 0] = suffix[:, 0]
        out[:, 1:size] = prefix[:, :-1] + suffix[:, 1:]
        out[:, size] = prefix[:, -1]
        return mix(out).view(np.int64)


def _key_batches(batches: Iterator) -> Iterator:
    """(key, at, id, word, n) of all deletions, at -1 of the word itself; long words stay behind."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        words, ids, ns = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
        size = np.array([len(w) for w in words], np.int64)
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            step = max(1, SLICE // int(min(length, LONG) * (length + 1)))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                some = [words[k] for k in r]
                keys = deletion_keys(some).ravel()
                place = np.tile(np.append(np.arange(length), -1), len(r)).astype(np.int32)
                which = np.repeat(np.arange(len(r)), length + 1)
                for j in range(0, len(keys), SLICE):
                    s = slice(j, j + SLICE)
                    text = pa.array(some).take(pa.array(which[s])) if length <= LONG else pa.nulls(len(keys[s]), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(place[s]), pa.array(ids[r][which[s]]), text, pa.array(ns[r][which[s]])], names=["key", "at", "id", "word", "n"])


class _Best:
    """Of some near words: how many, and the two best."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        self.n, self.two = len(rows), sorted((-n, w) for w, n in rows)[:2]

    def without(self, word: str) -> tuple[int, int, str]:
        n, w = self.two[0] if self.two[0][1] != word else self.two[1]
        return self.n - 1, -n, w


def _meet(rows: list[tuple], out: list[tuple]) -> None:
    """Rows (at, id, word, n) of one key: appends (word, near, best_n, best, id, other)."""
    if any(r[2] is None for r in rows):
        places: dict = {}
        for at, key, _, _ in rows:
            places.setdefault(at, set()).add(key)
        whole = places.pop(-1, set())
        for some in places.values():
            out += [(None, 0, None, None, a, o) for a in some for o in (some | whole) - {a}]
            out += [(None, 0, None, None, a, o) for a in whole for o in some - {a}]
        return
    strings: dict = {}
    for at, _, word, n in rows:
        strings.setdefault(word if at < 0 else word[:at] + word[at + 1 :], {}).setdefault(at, {})[word] = n
    for d, places in strings.items():
        whole = places.pop(-1, None)
        if whole and places:
            longer = {w: n for some in places.values() for w, n in some.items()}
            best = _Best(list(longer.items()))
            out.append((d, best.n, -best.two[0][0], best.two[0][1], None, None))
            out += [(w, 1, whole[d], d, None, None) for w in longer]
        for some in places.values():
            if len(some) > 1:
                best = _Best(list(some.items()))
                out += [(w, *best.without(w), None, None) for w in some]


def _match_batches(batches: Iterator) -> Iterator:
    """From rows in the order of their keys, what _meet has for each key with several words."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()), ("id", pa.int64()), ("other", pa.int64())])

    def meet(t: pa.Table) -> Iterator:
        if not t.num_rows:
            return
        key, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        end = np.append(start[1:], len(key))
        size = (end - start)[several]
        take = np.repeat(start[several] - np.cumsum(size) + size, size) + np.arange(size.sum())
        got = t.take(pa.array(take))
        rows = list(zip(*(got.column(c).to_pylist() for c in ("at", "id", "word", "n"))))
        out: list = []
        a = 0
        for n in size.tolist():
            _meet(rows[a : a + n], out)
            a += n
        for i in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out[i : i + (1 << 16)]), schema)], schema=schema)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = t.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        held = t.slice(last).combine_chunks()
        yield from meet(t.slice(0, last))
    if held is not None:
        yield from meet(held)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have a near word."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = words.select("word", F.xxhash64("word").alias("id"), "n")
    keys = w.mapInArrow(_key_batches, "key long, at int, id long, word string, n long")
    dealt = keys.repartition(parts, F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key")
    met = staged(dealt.mapInArrow(_match_batches, "word string, near long, best_n long, best string, id long, other long"), "spelling-met")
    one, two = (w.where(F.length("word") >= LONG).select(F.col("word").alias(a), F.col("id").alias(i), F.col("n").alias(n)) for a, i, n in (("word", "id", "own"), ("best", "other", "best_n")))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([near(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    pairs = met.where("other IS NOT NULL").select("id", "other").distinct().join(one, "id").join(two, "other").select("word", "best", "best_n").distinct()
    pairs = pairs.mapInArrow(lambda x: compare(x), "word string, best string, best_n long").select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")
    every = met.where("other IS NULL").select("word", "near", "best_n", "best").unionByName(pairs)
    got = every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    return got.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms lead in the end."""
    at = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        at = staged(at.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n)."""
    words = staged(words.select("word", "n"), "spelling-words")
    ok = F.col("best_n") >= ratio * F.col("n")
    t = words.join(near_words(words), "word", "left").select("word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n"))
    t = staged(t, "spelling-forms")
    r = roots(t.where("form IS NOT NULL"))
    return t.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of the words of docs."""
    return variants(count_words(docs, id_col, text_col))
