"""Near-duplicate vectors: every pair with a cosine of at least `threshold`, by PCA-ordered tiles.

Vectors are normalised; equal ones become one class with a count. A rotation to principal axes (fitted on at most
SAMPLE vectors; it changes the cost only, never a result) puts the leading dimensions first. Unit vectors with
cosine >= t lie within sqrt(2 - 2t) of each other, so on a grid of that width over the first axes only the same and
adjoining cells can hold partners; a vector goes only to adjoining cells whose box is that near. Cells with many
vectors are split into blocks; every task compares two blocks. In a tile, products of the leading dimensions are summed
first; the product of the suffix norms bounds the rest, and a pair stops once sum + bound < t. Pairs that pass all
dimensions are decided by the cosine of the original vectors in double precision, and where rounding could turn that,
by exact arithmetic, so that none below the threshold links. A task returns each vector's link count and a spanning
forest of its links, not the pairs.

Defined results: a null, empty or zero vector, or one with a null or non-finite component, links with nothing, however
small or large its components else are; vectors of different lengths don't link; repeated rows are vectors of their own;
a null id is a vector, and components take the smallest id that isn't null; an empty table gives no row; ids may be of
any type that has an order; extra columns are never read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged
from marlstone.llm.graph import components

SAMPLE, BLOCK, STEPS, HOT = 4096, 2048, (8, 16, 32), 1e-4


def clean(batches: Iterator) -> Iterator:
    """vec_id and the vector's doubles as bytes (null if it can't link)."""
    import pyarrow as pa

    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = None
            if v and all(c is not None for c in v):
                a = np.asarray(v, np.float64) + 0.0  # no negative zero
                x = a.tobytes() if np.isfinite(a).all() and a.any() else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def unit(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so that no square over- or underflows."""
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def reaches(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    """Whether the cosine of two vectors is at least t (positive), without rounding."""
    x, y = ([Fraction(float(c)) for c in v] for v in (a, b))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    return dot > 0 and dot * dot >= t * t * sum(p * p for p in x) * sum(q * q for q in y)


def rotation(x: np.ndarray) -> np.ndarray:
    """Columns are the principal axes of unit vectors, the strongest first."""
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def near_cells(q: np.ndarray, width: float, known: dict[tuple, int]) -> list[tuple]:
    """Cells that hold vectors and whose box lies within width of the point."""
    home, out = np.floor(q / width).astype(int), []
    low, high = q - home * width, (home + 1) * width - q
    for step in itertools.product((-1, 0, 1), repeat=len(q)):
        gap = sum((low[i] if s < 0 else high[i]) ** 2 for i, s in enumerate(step) if s)
        if gap <= width * width * (1 + 1e-9):
            c = tuple(int(v) for v in home + np.array(step))
            if c in known:
                out.append(c)
    return out


def link_tile(raw_a: np.ndarray, raw_b: np.ndarray, axes: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each pair of vectors with cosine >= t; of one block with itself, row < column."""
    a, b = unit(raw_a), unit(raw_b)
    pa_, pb = a @ axes, b @ axes
    d, rows, cols = a.shape[1], [], []
    steps = [s for s in STEPS if s < d]
    suffix = lambda x, s: np.sqrt(np.maximum((x[:, s:] ** 2).sum(1), 0))
    for i in range(0, len(a), 256):
        x = pa_[i : i + 256]
        if steps:
            s = steps[0]
            part = x[:, :s] @ pb[:, :s].T
            r, c = np.nonzero(part + suffix(x, s)[:, None] * suffix(pb, s)[None, :] >= t - 1e-9)
        else:
            r, c = np.nonzero(np.ones((len(x), len(pb)), bool))
        if same:
            keep = r + i < c
            r, c = r[keep], c[keep]
        if len(r) > len(x) * len(pb) // 8:  # dense: the whole product is cheaper than pair by pair
            keep = (x @ pb.T)[r, c] >= t - 1e-9
            r, c = r[keep], c[keep]
        elif steps:
            sums = part[r, c]
            for s, e in itertools.pairwise([*steps, d]):
                sums = sums + np.einsum("ij,ij->i", x[r, s:e], pb[c, s:e])
                keep = sums + (suffix(x, e)[r] * suffix(pb, e)[c] if e < d else 0) >= t - 1e-9
                r, c, sums = r[keep], c[keep], sums[keep]
        exact = np.einsum("ij,ij->i", a[i + r], b[c])
        keep = exact >= t
        for k in np.flatnonzero(np.abs(exact - t) < 1e-12):
            keep[k] = reaches(raw_a[i + r[k]], raw_b[c[k]], Fraction(str(t)))
        rows.append(r[keep] + i)
        cols.append(c[keep])
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)


def spanning(ids: np.ndarray, r: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smallest node) with the same components as the pairs of places r and c."""
    parent = np.arange(len(ids))
    while len(r):  # hook the larger root to the smaller, then shorten
        a, b = parent[r], parent[c]
        low, high = np.minimum(a, b), np.maximum(a, b)
        left = low != high
        if not left.any():
            break
        np.minimum.at(parent, high[left], low[left])
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
        r, c = r[left], c[left]
    return [(int(ids[i]), int(ids[p])) for i, p in enumerate(parent) if p != i]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that can't link don't take part in the last join. Classes with a share of HOT of all rows are broadcast
    (1 / HOT of them at most), so that none of them is one task's.
    """
    kind = vectors.schema["vec_id"].dataType
    rows = vectors.select("vec_id", "embedding").mapInArrow(clean, f"vec_id {kind.simpleString()}, vec binary")
    # 128 bits stand for a vector. A class's number is unique, and stays as it is once written.
    rows = staged(rows.withColumn("key", F.md5("vec")), "vectors")
    classes = rows.where("vec is not null").groupBy("key", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = [staged(_links(classes.where(F.octet_length("vec") == 8 * d), d, n, threshold, block), "vector-links") for d, n in ((r["d"], r["n"]) for r in classes.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).collect())]
    empty = classes.sparkSession.createDataFrame([], "u long, v long, n long")
    links = found[0] if found else empty
    for x in found[1:]:
        links = links.unionByName(x)
    comp = components(links.where("v is not null and u <> v"), "vector")
    counts = links.where("n > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    known = classes.select("cid", "key", "rep", "m").join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = staged(known.select("key", "m", "component", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector-known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = staged(known.join(least, "component").select("key", "m", "n_links", "component_id"), "vector-final")
    some = rows.where("vec is not null").select("vec_id", "key")
    often = max(2, math.ceil(HOT * rows.count()))
    hot = some.join(F.broadcast(known.where(F.col("m") >= often)), "key", "left")
    cold = hot.where("m is null").select("vec_id", "key").join(known.where(F.col("m") < often), "key")
    cols = ["vec_id", "n_links", "component_id"]
    none = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = hot.where("m is not null").select(*cols).unionByName(cold.select(*cols)).unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, d: int, n: int, t: float, block: int) -> DataFrame:
    """(u, v, n): n further links of class u (v null), or a link of the forest (n 0)."""
    sample = unit(matrix([r["vec"] for r in classes.orderBy("key").limit(max(64, min(SAMPLE, (1 << 22) // d))).select("vec").collect()]))
    axes = rotation(sample)
    width = math.sqrt(max(2 - 2 * t, 1e-6))
    # More axes for more vectors; the grid has at most (2 / width + 2) ** axes cells, whatever their number.
    k = min(d, 2 if n < 50 * block else 3 if n < 5000 * block else 4)

    def cells(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            q = np.floor(unit(matrix(b.column(0).to_pylist())) @ axes[:, :k] / width).astype(np.int32) if b.num_rows else np.zeros((0, k), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(q), pa.list_(pa.int32()))], names=["cell"])

    sizes = {tuple(r["cell"]): r["n"] for r in classes.select("vec").mapInArrow(cells, "cell array<int>").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = {c: -(-s // block) for c, s in sizes.items()}
    number = {c: i for i, c in enumerate(sorted(sizes))}

    def dealt(batches: Iterator) -> Iterator:
        """A row for every pair of blocks that a vector takes part in."""
        import pyarrow as pa

        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            q = unit(matrix(b.column(2).to_pylist())) @ axes[:, :k] if b.num_rows else np.zeros((0, k))
            for i, (cid, p) in enumerate(zip(ids, q, strict=True)):
                home = tuple(int(v) for v in np.floor(p / width))
                mine = cid % blocks[home]
                for c in near_cells(p, width, number):
                    for other in range(blocks[c]):
                        x, y = sorted(((number[home], mine), (number[c], other)))
                        out.append((i, *x, *y, int((number[home], mine) != x)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            at = cols[0]
            for a in range(0, len(at), 4096):
                s = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays([*(c[s] for c in cols[1:]), *(b.column(j).take(at[s]) for j in range(3))], names=["a", "ai", "b", "bi", "side", "cid", "m", "vec"])

    def compare(t_):
        side = t_["side"].to_numpy()
        same = t_["a"][0] == t_["b"][0] and t_["ai"][0] == t_["bi"][0]
        order = np.argsort(t_["cid"].to_numpy(), kind="stable")
        cid, m = t_["cid"].to_numpy()[order], t_["m"].to_numpy()[order]
        x = matrix(t_["vec"].take(order).to_pylist())
        left = np.flatnonzero(side[order] == 0)
        right = left if same else np.flatnonzero(side[order] == 1)
        if not len(left) or not len(right):
            return _table([], [])
        r, c = link_tile(x[left], x[right], axes, t, same)
        r, c = left[r], right[c]
        add = np.bincount(r, m[c], len(cid)) + np.bincount(c, m[r], len(cid))
        out = [(int(cid[i]), None, int(add[i])) for i in np.flatnonzero(add)]
        return _table(out, spanning(cid, r, c))

    pairs = classes.select("cid", "m", "vec").mapInArrow(dealt, "a long, ai long, b long, bi long, side long, cid long, m long, vec binary")
    return pairs.groupBy("a", "ai", "b", "bi").applyInArrow(compare, "u long, v long, n long")


def _table(counts: list[tuple], links: list[tuple]):
    import pyarrow as pa

    u = [x[0] for x in counts] + [x[0] for x in links]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array([None] * len(counts) + [x[1] for x in links], pa.int64()), "n": pa.array([x[2] for x in counts] + [0] * len(links), pa.int64())})
