"""Jaccard self-join of texts on word shingles, with Bayesian pruning of candidates.

A text's shingles are its windows of N words (lower-cased A-Z; all its words as one shingle if there are fewer), as a
set. Texts with equal sets become one class with a count. Candidates share one of BANDS bands of ROWS MinHash values,
which finds a pair at Jaccard 0.8 but for 5 in 10^8. MinHash values are compared STEP at a time; after n of them with m
equal the posterior of the Jaccard is Beta(1 + m, 1 + n - m), and a pair is dropped once the probability of reaching the
threshold is below TOLERANCE.

This happens twice. First within bands, on one byte of each MinHash value (bytes agree at least as often as values, so no
pair is dropped that values would keep): a task gets many small bands, or two blocks of BLOCK classes of a large one, and
gives a spanning forest of the pairs that go on; classes that only share bands with unlike ones fall out here, without
their texts. Then within each tree of the joined forest, a part, in blocks of BLOCK classes: the full values, and for the
pairs that stay an exact verification on the shingle sets, a stripe of rows at a time. A block gives each class's link
count and a spanning forest of its links, not pairs.

Defined results: a null, empty or wordless text links with nothing and is its own class; a text with fewer than N words
links with its copies only, however long; repeated rows are copies; a null id takes part, and a class takes the smallest
id that isn't null; an empty table gives no row; ids may be of any type that has an order; extra columns are never read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import bloom
from marlstone.llm import vectext as V
from marlstone.llm.common import spare_name, staged, unstaged
from marlstone.llm.graph import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE, BLOCK = 32, 4, 16, 1e-9, 1024
STRIPE, COLUMNS, DENSE, HOT = 64, 1024, 512, 1e-4
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(5081)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(column) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; 64-bit hashes of words and windows stand for them."""
    data, off = V.buffers(column)
    for i, j in V.slices(off):
        h, first = V.word_hashes(data, off[i : j + 1], lower=True)
        s, at = V.windows(h, first, N)
        place = np.searchsorted(at, first, "left")
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= N:
                yield np.unique(s[place[r] : place[r + 1]])
            elif b > a:
                with np.errstate(over="ignore"):
                    x = np.full(1, b - a, np.uint64)
                    for k in range(a, b):
                        x = V.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits that stand for a set of shingles; nulls for the empty set."""
    if not len(s):
        return None, None
    with np.errstate(over="ignore"):
        a = V.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = np.bitwise_xor.reduce(V.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 256):
            x = s[a : a + 256, None] * _A + _B
            out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(0))
    return out


@functools.cache
def least_equal(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... the fewest equal values with which a pair goes on.

    P(J >= t) under Beta(1 + m, 1 + n - m) is the chance of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


class Forest:
    """Trees over places 0..n-1; a root is its tree's smallest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, r: np.ndarray, c: np.ndarray) -> None:
        p = self.parent
        while len(r):  # hook the larger root to the smaller, then shorten
            a, b = p[r], p[c]
            left = a != b
            if not left.any():
                break
            np.minimum.at(p, np.maximum(a, b)[left], np.minimum(a, b)[left])
            while (up := p[p] != p).any():
                p[up] = p[p[up]]
            r, c = r[left], c[left]

    def links(self, ids: np.ndarray) -> np.ndarray:
        """(node, its tree's first) of all nodes but the first, as rows."""
        at = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return np.stack([ids[at], ids[self.parent[at]]], 1)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the posterior keeps each pair of rows."""
    go = np.arange(len(a))
    m = np.zeros(len(a), np.int16)
    for step, need in enumerate(least_equal(threshold)):
        s = slice(step * STEP, (step + 1) * STEP)
        m[go] += (a[go, s] == b[go, s]).sum(1, dtype=np.int16)
        go = go[m[go] >= need]
    out = np.zeros(len(a), bool)
    out[go] = True
    return out


def band_forest(sig: np.ndarray, band: np.ndarray, side: np.ndarray | None, threshold: float) -> Forest:
    """A forest of the pairs within bands (sorted) that the posterior keeps; pairs of a tree aren't compared again.

    side: where given, there is one band, and only pairs of different sides count.
    """
    out, n = Forest(len(sig)), len(sig)
    cuts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), n] if n else [0]
    size = np.diff(cuts)
    small = np.repeat(size <= 32, size) if side is None else np.zeros(n, bool)
    for d in range(1, int(size[size <= 32].max(initial=1)) if side is None else 1):  # many small bands at once
        r = np.flatnonzero((band[d:] == band[: n - d]) & small[: n - d])
        r = r[out.parent[r] != out.parent[r + d]]
        for p in range(0, len(r), 1 << 15):
            q = r[p : p + (1 << 15)]
            ok = alike(sig[q], sig[q + d], threshold)
            out.link(q[ok], q[ok] + d)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a <= 32 and side is None:
            continue
        for i in range(a, b - 1):  # one row with all after it
            c = np.flatnonzero(out.parent[i + 1 : b] != out.parent[i]) + i + 1
            if side is not None:
                c = c[side[c] != side[i]]
            if not len(c):
                if (out.parent[a:b] == out.parent[a]).all():
                    break
                continue
            ok = alike(np.broadcast_to(sig[i], (len(c), sig.shape[1])), sig[c], threshold)
            out.link(np.full(int(ok.sum()), i), c[ok])
    return out


def survivors(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of signatures that the posterior doesn't drop, a stripe of rows at a time; of one block with
    itself, row < column."""
    need = least_equal(threshold)
    bt = np.ascontiguousarray(b.T)
    for i in range(0, len(a), STRIPE):
        x = a[i : i + STRIPE]
        equal = np.zeros((len(x), len(b)), np.uint8)
        for k in range(STEP):
            equal += x[:, k, None] == bt[k][None, :]
        r, c = np.nonzero(equal >= need[0])
        if same:
            keep = r + i < c
            r, c = r[keep], c[keep]
        m = equal[r, c].astype(np.int16)
        for step in range(1, len(need)):
            s = slice(step * STEP, (step + 1) * STEP)
            for p in range(0, len(r), 1 << 14):
                q = slice(p, p + (1 << 14))
                m[q] += (x[r[q], s] == b[c[q], s]).sum(1, dtype=np.int16)
            keep = m >= need[step]
            r, c, m = r[keep], c[keep], m[keep]
        yield r + i, c


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of shared shingles of each of left with each of right: products of 0/1 columns."""
    used = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[col] > 1
    owner, col = owner[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    tile = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(sets), np.int64)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        mine = np.unique(owner[lo:hi])
        place[mine] = np.arange(len(mine))
        x = np.zeros((len(mine), COLUMNS), np.float32)
        x[place[owner[lo:hi]], col[lo:hi] - a] = 1
        r, c = np.isin(left, mine), np.isin(right, mine)
        tile[np.ix_(r, c)] += x[place[left[r]]] @ x[place[right[c]]].T
    return tile


def verified(sets: list[np.ndarray], size: np.ndarray, r: np.ndarray, c: np.ndarray, common: np.ndarray | None, threshold: float) -> np.ndarray:
    """Whether each pair's exact Jaccard reaches the threshold."""
    if common is None:
        common = np.zeros(len(r), np.int64)
        for k, (i, j) in enumerate(zip(r, c, strict=True)):
            if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                s, b = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                at = np.searchsorted(b, s)
                at[at == len(b)] = 0
                common[k] = int((b[at] == s).sum())
    # common / (a + b - common) >= t, in whole numbers for t = p / 1000000
    p = round(threshold * 1_000_000)
    return common * 1_000_000 >= p * (size[r] + size[c] - common)


def compare(cid: np.ndarray, m: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """Link counts, rows (class, further links), and a spanning forest, rows (class, class).

    What is held at once: two blocks' sets, a stripe of pairs, and the tile of a dense block.
    """
    size = np.array([len(s) for s in sets], np.int64)
    add, out, tile = np.zeros(len(cid), np.int64), Forest(len(cid)), None
    for r, c in survivors(sig[left], sig[right], same, threshold):
        if not len(r):
            continue
        if tile is None and len(r) > DENSE:  # many pairs of few sets
            tile = common_shingles(sets, left, right)
        common = None if tile is None else tile[r, c].astype(np.int64)
        r, c = left[r], right[c]
        ok = verified(sets, size, r, c, common, threshold)
        r, c = r[ok], c[ok]
        np.add.at(add, r, m[c])
        np.add.at(add, c, m[r])
        out.link(r, c)
    at = np.flatnonzero(add)
    return np.stack([cid[at], add[at]], 1), out.links(cid)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the 128-bit key of the shingle set (nulls if empty), the signature."""
    d = docs.select("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys, sigs = [], []
            for s in shingles(b.column(1)):
                keys.append(set_key(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "k1", "k2", "sig"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, sig binary")


def _bands(batches: Iterator) -> Iterator:
    import pyarrow as pa

    number = np.arange(BANDS, dtype=np.uint64)[None, :]
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            s = b.slice(a, 1024)
            sig = np.frombuffer(b"".join(s.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = number + np.uint64(1)
                for k in range(ROWS):
                    key = V.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(s.column(0).to_numpy(), BANDS))], names=["band", "cid"])


def _bytes(batches: Iterator) -> Iterator:
    """Each signature's lowest byte of every value."""
    import pyarrow as pa

    for b in batches:
        low = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary())], names=["cid", "low"])


def _table(counts: list[np.ndarray], links: list[np.ndarray]):
    import pyarrow as pa

    none = np.zeros((0, 2), np.int64)
    x, y = np.concatenate([none, *counts]), np.concatenate([none, *links])
    v = pa.array(np.concatenate([np.zeros(len(x), np.int64), y[:, 1]]), mask=np.arange(len(x) + len(y)) < len(x))
    return pa.table({"u": pa.array(np.concatenate([x[:, 0], y[:, 0]])), "v": v, "n": pa.array(np.concatenate([x[:, 1], np.zeros(len(y), np.int64)]))})


def _blocks(rows: DataFrame, group: str, size: str, block: int, bins: int) -> DataFrame:
    """rows dealt to tasks (many, task, i, j) by `group`, which has `size` rows: a group of one block shares a task with
    other small groups; a larger one has a task for each pair of its blocks. mine is a row's block."""
    d = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    many = F.col("blocks") > 1
    p = F.when(many, pair).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    task = F.when(many, F.col(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(bins)))
    return d.withColumn("task", task).withColumn("many", many).withColumn("p", F.explode(p)).select("*", "p.i", "p.j").drop("p", "blocks")


def _parts(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, component): classes with another one in a band that the posterior keeps, by the trees of such pairs."""
    bands = classes.select("cid", "sig").mapInArrow(_bands, "band long, cid long")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(bands.join(shared, "band").join(classes.select("cid", "sig").mapInArrow(_bytes, "cid long, low binary"), "cid"), "ngram-bands")
    bins = max(1, members.count() // (8 * block))

    def run(t):
        import pyarrow as pa

        band = t["band"].to_numpy()
        order = np.lexsort((t["cid"].to_numpy(), band))
        cid, sig = t["cid"].to_numpy()[order], np.frombuffer(b"".join(t["low"].take(order).to_pylist()), np.uint8).reshape(-1, HASHES)
        across = t["i"][0].as_py() != t["j"][0].as_py()
        y = band_forest(sig, band[order], t["mine"].to_numpy()[order] if across else None, threshold).links(cid)
        return pa.table({"u": pa.array(y[:, 0]), "v": pa.array(y[:, 1])})

    dealt = _blocks(members, "band", "n", block, bins).select("many", "task", "i", "j", "mine", "band", "cid", "low")
    pairs = staged(dealt.groupBy("many", "task", "i", "j").applyInArrow(run, "u long, v long"), "ngram-alike")
    unstaged(members)
    part = components(pairs, "ngram-part")
    unstaged(pairs)
    return part


def join(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, known): rows are doc_id, k1 and k2 (a text's class, null without words) of every document; known has k1, k2, m (rows),
    component, class_id and n_links of every class with more than one document or with links."""
    signed = staged(keyed(docs), "ngram-rows")
    classes = signed.where("k1 is not null").groupBy("k1", "k2", "sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    # Numbers are unique, and stay as they are once written.
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    rows = staged(signed.select("doc_id", "k1", "k2"), "ngram-keys")
    unstaged(signed)  # signatures are most of these tables
    part = _parts(classes, threshold, block)
    active = staged(part.withColumnRenamed("node", "cid").join(classes.select("cid", "k1", "k2", "rep", "m", "sig"), "cid"), "ngram-active")
    slim = staged(classes.select("cid", "k1", "k2", "rep", "m"), "ngram-slim")
    unstaged(classes)
    links = staged(_compared(docs, active, threshold, block), "ngram-links")
    unstaged(active)
    comp = components(links.where("v is not null and u <> v"), "ngram")
    counts = links.where("n > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    some = slim.join(counts, "cid", "left").where("m > 1 or n is not null")
    known = some.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = staged(known.select("k1", "k2", "m", "component", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "ngram-known")
    unstaged(slim, links)
    least = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    final = staged(known.join(least, "component").select("k1", "k2", "m", "component", "class_id", "n_links"), "ngram-final")
    unstaged(known)
    return rows, final


def _compared(docs: DataFrame, active: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v, n): n further links of class u (v null), or a link of the forest (n 0)."""
    sizes = active.groupBy("component").agg(F.count("*").alias("size"))
    bins = max(1, active.count() // block)
    # A class's text is that of a row with its smallest id; if all its ids are null, of a row without id, found by its key.
    by_rep = active.where("rep is not null").select(F.xxhash64("rep").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast((bloom.build(by_rep, "h"), bloom.build(active.where("rep is null"), "k1")))
    d = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def possible(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            by_id, by_key = shared.value
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            hit = np.where(null, by_key.any(), bloom.maybe(by_id, b.column(2).to_numpy(zero_copy_only=False)))
            b, null = b.filter(pa.array(hit)), null[hit]
            got = list(shingles(b.column(1)))
            keys = [set_key(s) for s in got]
            k = np.flatnonzero(~null | bloom.maybe(by_key, np.array([k[0] or 0 for k in keys], np.int64)))
            again: set = set()  # copies without id in a batch stand for each other
            k = [i for i in k if not null[i] or (keys[i] not in again and not again.add(keys[i]))]
            b, got, keys = b.take(pa.array(k, pa.int64())), [got[i] for i in k], [keys[i] for i in k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["id", "k1", "k2", "shingles"])

    texts = d.mapInArrow(possible, f"id {kind}, k1 long, k2 long, shingles binary").where("k1 is not null")
    # Shingles are shuffled twice, by key and by task: a key is a class, and its part's size is joined to it beforehand.
    ready = texts.join(active.join(sizes, "component"), ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["k1", "k2"])
    dealt = _blocks(ready, "component", "size", block, bins).select("many", "task", "i", "j", "mine", "component", "cid", "m", "sig", "shingles")

    def run(t):
        order = np.lexsort((t["cid"].to_numpy(), t["component"].to_numpy()))
        cid, m, part, mine = (t[c].to_numpy()[order] for c in ("cid", "m", "component", "mine"))
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].take(order).to_pylist()]
        sig = np.frombuffer(b"".join(t["sig"].take(order).to_pylist()), np.uint32).reshape(-1, HASHES)
        i, j, counts, links = t["i"][0].as_py(), t["j"][0].as_py(), [], []
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            left = np.flatnonzero(mine[a:b] == i)
            right = left if i == j else np.flatnonzero(mine[a:b] == j)
            if len(left) and len(right) and not (i == j and len(left) < 2):
                x, y = compare(cid[a:b], m[a:b], sets[a:b], sig[a:b], left, right, i == j, threshold)
                counts.append(x)
                links.append(y)
        return _table(counts, links)

    return dealt.groupBy("many", "task", "i", "j").applyInArrow(run, "u long, v long, n long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_links (other documents with a Jaccard of at least threshold), class_id (the smallest id that links lead
    to, its own included) and kept (whether that is its own).

    Texts without words don't take part in the last join. Classes with a share of HOT of all rows are broadcast (1 / HOT
    of them at most), so that none of them is one task's.
    """
    rows, known = join(docs, threshold)
    cols = ["k1", "k2", "class_id", "n_links"]
    least = max(2, math.ceil(HOT * rows.count()))
    hot = F.broadcast(known.where(F.col("m") >= least).select(*cols, F.lit(True).alias("hot")))
    some = rows.where("k1 is not null").join(hot, ["k1", "k2"], "left")
    cold = some.where("hot is null").select("doc_id", "k1", "k2").join(known.where(F.col("m") < least).select(*cols), ["k1", "k2"], "left")
    out = cold.select("doc_id", "class_id", "n_links").unionByName(some.where("hot").select("doc_id", "class_id", "n_links"))
    none = rows.where("k1 is null").select("doc_id", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(none).select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id, and of several rows with that id the
    one with the smallest key; all rows that link with nothing stay.

    Only rows that may go are shuffled: the others pass a Bloom filter of the ids with links.
    """
    rows, known = join(docs, threshold)
    grouped = staged(known.select("k1", "k2", "component", "class_id").join(rows, ["k1", "k2"]), "ngram-grouped")
    best = grouped.groupBy("component").agg(F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(True)), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("b")).select(F.col("b.k1").alias("k1"), F.col("b.k2").alias("k2"), F.col("b.doc_id").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(grouped.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h")), "h"))
    own = [spare_name(docs, c) for c in ("ngram_maybe", "ngram_k1", "ngram_k2")]
    at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def flagged(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            hit = bloom.maybe(shared.value, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) | ~b.column(at).is_valid().to_numpy(zero_copy_only=False)
            k = np.flatnonzero(hit)
            keys: list = [(None, None)] * b.num_rows
            for p, s in zip(k, shingles(b.column(text_at).take(pa.array(k))), strict=True):
                keys[p] = set_key(s)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64())], names=[*b.schema.names[:-1], *own])

    hashed = docs.select("*", F.xxhash64(F.col(f"`{docs.columns[at]}`")).alias(own[0]))
    f = hashed.mapInArrow(flagged, T.StructType([*docs.schema.fields, T.StructField(own[0], T.BooleanType()), T.StructField(own[1], T.LongType()), T.StructField(own[2], T.LongType())]))
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    doubtful = f.where(F.col(own[0])).alias("d")
    on = lambda k, *more: (F.col(f"d.{own[1]}") == k["k1"]) & (F.col(f"d.{own[2]}") == k["k2"]) & (F.col(f"d.`{docs.columns[at]}`").eqNullSafe(k["doc_id"]))
    free = doubtful.join(grouped.select("doc_id", "k1", "k2").distinct(), on(grouped), "left_anti").select(*docs.columns)
    kept = doubtful.join(best, on(best)).select(*cols, F.col(f"d.{own[1]}").alias(own[1]), F.col(f"d.{own[2]}").alias(own[2])).dropDuplicates([docs.columns[at], own[1], own[2]]).drop(own[1], own[2])
    return f.where(~F.col(own[0])).select(*docs.columns).unionByName(free).unionByName(kept)
