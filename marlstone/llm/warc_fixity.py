"""Fixity audit of web-archive replicas by Merkle trees, with DataFrame functions only.

A page becomes a WARC resource record. Records are ordered by page id and digest; FILE_PAGES ids in a row make a file,
in which a record's offset is the sum of the lengths before it. Equal records of one id are one leaf with a count. A
leaf range is LEAF_PAGES ids in a row of a file; its hash covers its records' digests, counts and lengths in order.
Every further level hashes the FANOUT nodes below it, up to one root. An audit compares the roots and goes down only
where hashes differ: a level's nodes are joined only under parents that differ, and records only in differing ranges.
A file with more than SPLIT records (one id with very many contents) is split by digest into files of about FILE_PAGES
records, so no group grows without bound.

Defined results: a null url or html is an empty one; null ids form a file of their own (split alike); repeated rows are
counted, and differing counts are a mismatch; an empty replica leaves every record missing, two empty ones give no row;
extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import staged

FILE_PAGES, LEAF_PAGES, FANOUT, SPLIT = 1024, 64, 64, 8192
NO_ID = -1


def record(url: Column, html: Column, page_id: Column) -> Column:
    """The text of a record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """page_id, digest, length, copies, file, part, leaf and offset of every distinct record.

    The texts are hashed where they are read; only ids, digests and lengths are shuffled.
    """
    r = pages.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("r"))
    r = r.select("page_id", F.sha2(F.col("r").cast("binary"), 256).alias("digest"), F.octet_length("r").cast("long").alias("length"))
    r = r.groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies"))
    r = r.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), F.lit(NO_ID)))
    large = r.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("file", F.ceil(F.col("n") / FILE_PAGES).alias("parts"))
    r = r.join(large, "file", "left")
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")  # 32 bits of the digest, in its order
    r = r.withColumn("part", F.coalesce(F.floor(first * F.col("parts") / F.lit(1 << 32)), F.lit(0)).cast("long"))
    r = r.withColumn("leaf", F.coalesce(F.floor(F.pmod("page_id", F.lit(FILE_PAGES)) / LEAF_PAGES), F.lit(0)))
    w = Window.partitionBy("file", "part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.withColumn("offset", F.sum(F.col("length") * F.col("copies")).over(w) - F.col("length") * F.col("copies")).drop("parts")


def _hash(*order: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: F.concat_ws(":", *(x[c].cast("string") for c in order))), "|").cast("binary"), 256).alias("hash")


def tree(leaf_rows: DataFrame, height: int) -> list[DataFrame]:
    """Nodes by level: leaf ranges, files' parts, files, then FANOUT to one; every group is bounded, every level staged."""
    ranges = staged(leaf_rows.groupBy("file", "part", "leaf").agg(_hash("page_id", "digest", "copies", "length")), "warc-ranges")
    parts = staged(ranges.groupBy("file", "part").agg(_hash("leaf", "hash")), "warc-parts")
    # A file has few parts but for a split one: those are first hashed by FANOUT, too.
    bundles = parts.groupBy("file", F.floor(F.col("part") / FANOUT).alias("bundle")).agg(_hash("part", "hash"))
    files = staged(bundles.groupBy("file").agg(_hash("bundle", "hash")).select(F.col("file").alias("node"), "hash"), "warc-files")
    levels = [ranges, parts, files]
    for _ in range(height):
        up = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(_hash("node", "hash"))
        levels.append(staged(up.select(F.col("up").alias("node"), "hash"), "warc-level"))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = a.withColumnRenamed("hash", "ha"), b.withColumnRenamed("hash", "hb")
    return x.join(y, keys, "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of either replica: page_id, file, part, offset, length, digest, copies and status.

    status: ok; corrupt (the replica has another record of that id in its place); missing (the replica has none of that
    id); extra (only the replica has it); copies (another number of equal records). Offsets are those of the record's
    own replica.
    """
    a, b = staged(leaves(primary), "warc-a"), staged(leaves(replica), "warc-b")
    top = a.select("file").unionByName(b.select("file")).agg(F.max(F.abs("file"))).first()[0]
    height, reach = 1, FANOUT
    while reach <= (top or 0):
        height, reach = height + 1, reach * FANOUT
    ta, tb = tree(a, height + 1), tree(b, height + 1)
    bad = staged(_differing(ta[-1], tb[-1], ["node"]), "warc-bad")
    for x, y in zip(ta[-2:1:-1], tb[-2:1:-1], strict=True):
        under = lambda t, bad=bad: t.join(bad.select(F.col("node").alias("up")), F.floor(F.col("node") / FANOUT) == F.col("up"), "left_semi")
        bad = staged(_differing(under(x), under(y), ["node"]), "warc-bad")
    bad = bad.select(F.col("node").alias("file"))
    for k, keys in ((1, ["file", "part"]), (0, ["file", "part", "leaf"])):
        bad = staged(_differing(ta[k].join(bad, keys[:-1], "left_semi"), tb[k].join(bad, keys[:-1], "left_semi"), keys), "warc-bad")
    keys = ["file", "part", "leaf"]
    cols = ["page_id", "file", "part", "offset", "length", "digest", "copies"]
    fine = a.join(bad, keys, "left_anti").select(*cols, F.lit("ok").alias("status"))
    x, y = a.join(bad, keys, "left_semi"), b.join(bad, keys, "left_semi")
    same = F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.digest") == F.col("y.digest"))
    j = x.alias("x").join(y.alias("y"), same, "full_outer")
    # An id's records all lie in differing ranges' files or in none; those of split files can lie in other parts.
    ids = b.select(F.col("page_id").alias("other")).join(x.select(F.col("page_id").alias("other")).distinct(), "other", "left_semi").distinct()
    found = j.select(
        *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("page_id", "file", "part", "offset", "length", "digest", "copies")),
        F.when(F.col("x.digest").isNull(), "extra").when(F.col("y.digest").isNull(), "lost").when(F.col("x.copies") != F.col("y.copies"), "copies").otherwise("ok").alias("status"),
    )
    found = found.join(ids, F.col("page_id") == F.col("other"), "left")
    status = F.when(F.col("status") == "lost", F.when(F.col("other").isNull(), "missing").otherwise("corrupt")).otherwise(F.col("status"))
    return fine.unionByName(found.select(*cols[:-1], "copies", status.alias("status")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with the damage of a fixity drill: one character of html lost in every 499th page, every 997th page lost."""
    html = F.when((F.col("page_id") % 499 == 7) & (F.length("html") > 0), F.concat(F.expr("substring(html, 1, length(html) div 2)"), F.expr("substring(html, length(html) div 2 + 2)"))).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html")).where((F.col("page_id") % 997 != 13) | F.col("page_id").isNull())


#: The drill's audit in DuckDB SQL, by comparing records directly.
DRILL_SQL = r"""
WITH rec AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN page_id % 997 = 13 THEN NULL
              WHEN page_id % 499 = 7 AND length(html) > 0
              THEN substr(html, 1, length(html) // 2) || substr(html, length(html) // 2 + 2)
              ELSE coalesce(html, '') END AS other
  FROM pages),
full_rec AS (
  SELECT page_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html))::VARCHAR
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r,
         CASE WHEN other IS NULL THEN NULL ELSE
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(other))::VARCHAR
         || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) END AS o
  FROM rec),
a AS (SELECT page_id, sha256(r) AS digest, octet_length(encode(r))::BIGINT AS length, count(*) AS copies FROM full_rec GROUP BY ALL),
b AS (SELECT page_id, sha256(o) AS digest, octet_length(encode(o))::BIGINT AS length, count(*) AS copies FROM full_rec WHERE o IS NOT NULL GROUP BY ALL),
pa AS (SELECT *, page_id // 1024 AS file, sum(length * copies) OVER (PARTITION BY page_id // 1024 ORDER BY page_id, digest) - length * copies AS off FROM a),
pb AS (SELECT *, page_id // 1024 AS file, sum(length * copies) OVER (PARTITION BY page_id // 1024 ORDER BY page_id, digest) - length * copies AS off FROM b)
SELECT coalesce(pa.page_id, pb.page_id) AS page_id, coalesce(pa.file, pb.file)::BIGINT AS file, 0::BIGINT AS part,
       coalesce(pa.off, pb.off)::BIGINT AS "offset", coalesce(pa.length, pb.length) AS length,
       coalesce(pa.digest, pb.digest) AS digest, coalesce(pa.copies, pb.copies) AS copies,
       CASE WHEN pa.digest IS NULL THEN 'extra'
            WHEN pb.digest IS NULL AND pa.page_id IN (SELECT page_id FROM b WHERE page_id IS NOT NULL) THEN 'corrupt'
            WHEN pb.digest IS NULL THEN 'missing'
            WHEN pa.copies <> pb.copies THEN 'copies' ELSE 'ok' END AS status
FROM pa FULL OUTER JOIN pb ON pa.page_id IS NOT DISTINCT FROM pb.page_id AND pa.digest = pb.digest
"""
