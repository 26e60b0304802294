"""Addresses against the standard library, crawl order against a queue."""

import random
from collections import deque
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from marlstone.operators import crawl

BASES = ["https://Ex.org/a/b/c.html?x=1#f", "http://ex.org", "http://ex.org/a/", "https://ex.org/a//b"]
LINKS = ["/x", "x/y", "../x", "../../../x", "./x/./y/", "//Other.org/z//w/", "https://Other.org/P?q#f", "?q=2", "#f", "", "mailto:a@b.c", "javascript:void(0)", "/", "x?y=/..", "/a/../b/."]


def plain(base, link):
    if not link.strip() or link.startswith("#"):
        return None
    p = urlparse(urljoin(base, link.strip()))
    if p.scheme not in ("http", "https"):
        return None
    import re

    return f"{p.scheme}://{p.netloc.lower()}" + (re.sub("/{2,}", "/", p.path).rstrip("/") or "/")


def test_resolved_links(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(rows, "b string, l string").select("b", "l", crawl.resolved(F.col("b"), F.col("l")).alias("u")).collect()
    assert {(r.b, r.l): r.u for r in got} == {(b, x): plain(b, x) for b, x in rows}


def queue(edges, seeds, depth, most=10**9):
    """Level by level; within a level in the order of first and url."""
    seen, level, out = set(), sorted(set(seeds)), {}
    for d in range(depth + 1):
        level = sorted((u for u in level if u not in seen), key=lambda u: ("x" not in u, u))[: most - len(out)]
        seen |= set(level)
        out |= {u: d for u in level}
        level = sorted({b for a, b in edges if a in level} - seen)
    return out


def test_frontier_equals_a_queue(spark):
    rnd = random.Random(1)
    edges = [(f"u{rnd.randrange(60)}", f"{'x' if rnd.random() < 0.2 else 'u'}{rnd.randrange(60)}") for _ in range(120)] + [("x1", "u1"), ("u1", "u1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("u0",), ("u1",), ("u1",), (None,)], "url string")
    for depth, most in ((0, None), (2, None), (9, None), (9, 11)):
        got = {r.url: r.depth for r in crawl.frontier(e, seeds, depth, F.col("url").contains("x"), most).collect()}
        assert got == queue(edges, ["u0", "u1"], depth, most or 10**9)
    assert len(deque(got)) == 11


def test_frontier_of_nothing(spark):
    assert crawl.frontier(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "url string"), 3).count() == 0
