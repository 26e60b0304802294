"""Queries of splitting with limits, of the ingest and of keyed streams, with DuckDB twins for those that write no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import retrieval as R
from marlstone.operators import split
from marlstone.sources import index
from marlstone.streaming import ingest, keyed
from marlstone.streaming.folders import new_folder

LIMIT, SPAN = 3, 12 * 3600
#: Event types stand for routes of answers: two of them are never kept, one isn't known.
ROUTES = {"signup": "identity", "view": "overview", "click": "guidance", "purchase": "pricing", "error": "unsupported"}
_HEAD = "| part | quantity | flag |\n| --- | --- | --- |"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(d: str, name: str) -> str:
    """A pattern for the table, which may be a file or a folder: a stream takes a single file only by a pattern."""
    return f"{d}/{name}.parque[t]"


def _supplier_tables(spark: SparkSession, d: str) -> DataFrame:
    """A markdown table of each supplier's lines; a supplier's lines are a bounded group at any size of the tables."""
    row = F.concat_ws(" ", F.lit("|"), F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_quantity").cast("int").cast("string"), F.lit("|"), F.col("l_returnflag"), F.lit("|"))
    t = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("row")))).alias("rows"))
    return t.select("l_suppkey", F.concat_ws("\n", F.lit(_HEAD), F.array_join(F.col("rows")["row"], "\n")).alias("content"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents and tables as chunks."""
    none = F.lit(None).cast("int").alias("page")
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("source_url"), none, F.lit("section_text").alias("chunk_type"), F.lit("").alias("section_title"), T.clean(F.col("text")).alias("content"))
    tables = _supplier_tables(spark, d).select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("chunk_id"), F.lit("tables").alias("source_url"), none, F.lit("table").alias("chunk_type"), F.lit("").alias("section_title"), "content")
    return docs.unionByName(tables)


def table_pieces(spark, d):
    t = _supplier_tables(spark, d).select(F.col("l_suppkey").cast("string").alias("chunk_id"), F.lit("").alias("source_url"), F.lit(None).cast("int").alias("page"), F.lit("table").alias("chunk_type"), F.lit("").alias("section_title"), "content")
    p = split.embed_limits(t)
    return p.select(F.coalesce("parent", "chunk_id").cast("long").alias("l_suppkey"), F.coalesce("sub", F.lit(0)).alias("piece"), F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def embed_limits(spark, d):
    return split.embed_limits(_chunks(spark, d)).select("chunk_id", "parent", "sub", "chunk_type", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def guard_chunks(spark, d):
    return split.guard(_chunks(spark, d)).select("chunk_id", "parent", "sub", "dropped", "chunk_type", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def lazy_ingest(spark, d):
    return ingest.stored_chunks(spark, ingest.ingest_files(spark, _files(d, "documents"))).select("chunk_id", "doc_id", "chunk_index", F.length("content").alias("n_chars"), "batch")


def _answers(spark, d, rule, to, arg, key) -> DataFrame:
    schema = _t(spark, d, "events").schema
    folder = keyed.answer_files(spark, _files(d, "events"), schema.simpleString()[7:-1].replace(":", " "), rule, key, "event_id", to, arg, delay="40 days")
    return keyed.answers(spark, folder, f"`{key}` {schema[key].dataType.simpleString()}, event_id {schema['event_id'].dataType.simpleString()}, {to} boolean")


def _seconds():
    route = F.element_at(F.create_map(*(F.lit(x) for kv in ROUTES.items() for x in kv)), F.col("event_type"))
    return keyed.seconds_of(route)


def rate_limit_fold(spark, d):
    return keyed.folded(_t(spark, d, "events"), keyed.RateLimit(LIMIT, SPAN), "user_id", "event_id", "allowed")


def ttl_cache_fold(spark, d):
    e = _t(spark, d, "events").withColumn("cache_key", F.concat_ws(":", "user_id", "event_type"))
    return keyed.folded(e, keyed.RouteCache(), "cache_key", "event_id", "hit", F.lit(48 * 3600).cast("long"))


def response_cache(spark, d):
    return keyed.folded(_t(spark, d, "events"), keyed.RouteCache(), "user_id", "event_id", "hit", _seconds())


def rate_limit_stream(spark, d):
    """rate_limit_fold as a stream over the event files."""
    return _answers(spark, d, keyed.RateLimit(LIMIT, SPAN), "allowed", None, "user_id")


def response_cache_stream(spark, d):
    """response_cache as a stream over the event files."""
    return _answers(spark, d, keyed.RouteCache(), "hit", _seconds(), "user_id")


def bm25_stored(spark, d):
    """bm25_topk's scores from an index in files that got the documents in two increments."""
    folder = new_folder(spark, "index")
    docs = _t(spark, d, "documents")
    index.add(docs.where("lang = 'en'"), folder)
    index.add(docs, folder)
    return R.ranked(index.answer(spark, folder, _t(spark, d, "benchmark"), best=20), 20)


QUERIES = {f.__name__: f for f in (table_pieces, embed_limits, guard_chunks, lazy_ingest, rate_limit_fold, ttl_cache_fold, response_cache, rate_limit_stream, response_cache_stream, bm25_stored)}

_NUMBERED = "SELECT event_id, {key} AS key, {more} epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events"
_TTL = "CASE event_type WHEN 'signup' THEN 86400 WHEN 'view' THEN 21600 WHEN 'click' THEN 3600 WHEN 'purchase' THEN 900 ELSE 0 END"


def _cache_sql(key: str, seconds: str, name: str) -> str:
    hit = "s.held IS NOT NULL AND e.us <= s.held AND e.seconds > 0"
    return f"""WITH RECURSIVE e AS ({_NUMBERED.format(key=key, more=f"CAST({seconds} AS BIGINT) AS seconds,")}),
s AS (SELECT event_id, key, i, false AS hit, CASE WHEN seconds > 0 THEN us + seconds * 1000000 END AS held FROM e WHERE i = 1 UNION ALL
SELECT e.event_id, e.key, e.i, {hit}, CASE WHEN ({hit}) OR e.seconds = 0 THEN s.held ELSE e.us + e.seconds * 1000000 END FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
SELECT key AS {name}, event_id, hit FROM s"""


ORACLE_SQL = {
    "rate_limit_fold": f"""WITH RECURSIVE e AS ({_NUMBERED.format(key="user_id", more="")}),
s AS (SELECT event_id, key, i, true AS allowed, [us] AS held FROM e WHERE i = 1 UNION ALL
SELECT event_id, key, i, len(h) < {LIMIT}, CASE WHEN len(h) < {LIMIT} THEN list_append(h, us) ELSE h END FROM (SELECT e.event_id, e.key, e.i, e.us, list_filter(s.held, lambda x: x >= e.us - {SPAN}000000) AS h FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1))
SELECT key AS user_id, event_id, allowed FROM s""",
    "ttl_cache_fold": _cache_sql("concat_ws(':', user_id, event_type)", "172800", "cache_key"),
    "response_cache": _cache_sql("user_id", _TTL, "user_id"),
    "table_pieces": r"""WITH RECURSIVE r AS (
  SELECT l_suppkey, row, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, row) AS i
  FROM (SELECT *, concat_ws(' ', '|', CAST(l_partkey AS VARCHAR), '|', CAST(CAST(l_quantity AS INT) AS VARCHAR), '|', l_returnflag, '|') AS row FROM lineitem)),
m AS (SELECT *, length(row) + 1 AS n, len(string_split(row, ' ')) AS w FROM r),
h AS (SELECT '| part | quantity | flag |' || chr(10) || '| --- | --- | --- |' AS head),
f AS (
  SELECT l_suppkey, i, 0 AS piece, length(head) + n AS chars, 14 + w AS words FROM m, h WHERE i = 1
  UNION ALL
  SELECT m.l_suppkey, m.i, CASE WHEN c.ok THEN f.piece ELSE f.piece + 1 END, CASE WHEN c.ok THEN f.chars + m.n ELSE length(h.head) + m.n END, CASE WHEN c.ok THEN f.words + m.w ELSE 14 + m.w END
  FROM f JOIN m ON m.l_suppkey = f.l_suppkey AND m.i = f.i + 1, h,
  LATERAL (SELECT f.chars + m.n <= 4000 AND (f.chars + m.n) // 3 <= 1500 AND f.words + m.w <= 1500 AS ok) c),
p AS (SELECT f.l_suppkey, f.piece, (SELECT head FROM h) || chr(10) || string_agg(m.row, chr(10) ORDER BY m.i) AS content
  FROM f JOIN m ON m.l_suppkey = f.l_suppkey AND m.i = f.i GROUP BY f.l_suppkey, f.piece)
SELECT l_suppkey, piece, length(content) AS n_chars, md5(content) AS content_md5 FROM p""",
}
