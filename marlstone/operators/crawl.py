"""Crawl order over pages and their links: resolved addresses, breadth first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.streaming.folders import stored

ROOT = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/"), F.array().cast("array<string>"), step), "/"))


def resolved(base: Column, link: Column) -> Column:
    """The canonical address of a link on the page at base: host in lower case, no query, fragment or trailing slash, the
    root as /. Null for a link that leads to no page (an empty one, a fragment, mail, scripts)."""
    link = F.trim(link)
    root, cut = F.regexp_extract(base, ROOT, 1), F.regexp_replace(link, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(T.url_path(base), "[^/]*$", ""), "/{2,}", "/")
    full = (
        F.when(link.rlike(ROOT), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(root, cut))
        .when(link.startswith("?"), F.concat(root, T.url_path(base)))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), cut))
    )
    path = F.regexp_replace(F.regexp_replace(_without_dots(T.url_path(full)), "/{2,}", "/"), "(.)/$", "$1")
    ok = (link != "") & ~link.startswith("#") & (F.regexp_extract(full, ROOT, 1) != "") & T.url_host(full).isNotNull()
    return F.when(ok, F.concat(F.lower(F.regexp_extract(full, ROOT, 1)), path))


def frontier(edges: DataFrame, seeds: DataFrame, depth: int, first: Column | None = None, most: int | None = None) -> DataFrame:
    """(url, depth): the pages in reach of seeds (url) over edges (src, dst), each at its least depth.

    One join and one anti-join against what was seen for each level; levels are written, so that the plan of a level doesn't
    hold those before it, and an empty level ends the search. most: crawl so many pages in all, of the level that goes
    over it those that `first` puts first, then by url; that is a bounded top-k.
    """
    level = stored(seeds.select("url").where("url IS NOT NULL").distinct(), "crawl")
    seen, n = None, 0
    for d in range(depth + 1):
        if most is not None:
            some = level.count()
            if n + some > most:
                order = [F.desc(first)] if first is not None else []
                level = stored(level.orderBy(*order, "url").limit(most - n), "crawl")
            n += some
        here = level.select("url", F.lit(d).alias("depth"))
        seen = here if seen is None else seen.unionByName(here)
        if d == depth or (most is not None and n >= most):
            break
        out = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = stored(out.join(seen.select("url"), "url", "left_anti"), "crawl")
        if not level.limit(1).count():
            break
    return seen
