"""Connected components of links that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged, unstaged

HELD = 1 << 19


def forest(batches: Iterator, held: int = HELD) -> Iterator:
    """Star forests (node, smallest node) with the same components as a partition's links (u, v).

    Past `held` nodes what is known goes out and a new forest begins, so a partition of any size fits.
    """
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def stars():
        out = np.array([(n, r) for n in list(parent) if (r := root(n)) != n], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > held:
            yield stars()
            parent.clear()
    yield stars()


def _star(e: DataFrame, small: bool) -> DataFrame:
    """One round: every node's neighbours (the smaller ones only, or the larger ones) move to its smallest one."""
    if small:
        n = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        n = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = n.join(m, "u")
    if small:
        moved = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    else:
        moved = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, name: str, rounds: int = 64) -> DataFrame:
    """(node, component): each node of the links (u, v long) with the smallest node that it is connected to.

    Alternating large-star and small-star rounds, O(log^2 n) of them; each keeps a link per node at most, is staged,
    and aggregates before it shuffles, so a node with very many links is spread over the tasks.
    """
    e = staged(links.select("u", "v").where("u <> v").mapInArrow(forest, "u long, v long"), f"{name}-links")
    seen = None
    for _ in range(rounds):
        e, old = staged(_star(_star(e, small=False), small=True), f"{name}-star"), e
        unstaged(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    e = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return e.unionByName(e.select(F.col("component").alias("node"), "component").distinct())
