"""Queries of duplicates, audits, pages, sessions, evaluation and events, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import quality as Q
from marlstone.functions import tables as B
from marlstone.functions import text as T
from marlstone.operators import crawl as C
from marlstone.operators import dedup as D
from marlstone.operators import evaluate as E
from marlstone.sources import files, html, pages
from marlstone.streaming import state

BOUNDS = [("minimum", "pass_rate", 0.75), ("minimum", "toxic_rate", 0.0), ("maximum", "toxic_rate", 0.2), ("maximum", "mean_chars", 100000.0), ("minimum", "missing_metric", 1.0)]


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def content_signature_dups(spark, d):
    return D.duplicate_groups(_t(spark, d, "documents"), "doc_id", T.signature(F.col("text"))).withColumnRenamed("key", "signature")


def first_by_signature(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", T.signature(F.col("text")).alias("signature"))
    return D.first_of(docs, "signature", "doc_id")


def incremental_anti(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"), Q.low_information(F.col("text")).alias("low"))
    old = docs.where(F.col("doc_id") % 2 == 0)
    return D.incremental(docs.where((F.col("doc_id") % 2 == 1) & ~F.col("low")), old, "h").select("doc_id", "h")


def keyed_upsert(spark, d):
    parts = _t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    new = parts.where(F.col("p_partkey") % 3 == 0).withColumn("price", F.round(F.col("price") + 1, 2))
    return D.upsert(parts, new, "p_partkey")


def manifest_counts(spark, d):
    return files.manifest(_t(spark, d, "documents"), "lang", "source")


def length_stats(spark, d):
    n = F.length("text")
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def quality_audit(spark, d):
    s = Q.scored_chunks(_t(spark, d, "documents").select("source", "text")).select("source", F.col("score").alias("s"))
    g = s.groupBy("source", F.floor(F.col("s") * 10).alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("grade", F.when(F.col("bin") >= 9, "A").when(F.col("bin") >= 7, "B").when(F.col("bin") >= 5, "C").otherwise("D"))


def coverage(spark, d):
    docs = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    lab = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    return docs.join(lab, "source", "full_outer").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.round(100 * F.coalesce("labelled", F.lit(0)) / F.col("docs"), 2).alias("percent"))


def page_title_links(spark, d):
    h = F.col("html")
    links = html.links(h)
    return _t(spark, d, "pages").select("page_id", html.title(h).alias("title"), F.size(links).alias("n_links"), F.md5(F.array_join(F.array_distinct(links), " ")).alias("links_md5"))


def html_structured(spark, d):
    return html.structured_pages(_t(spark, d, "pages"))


def page_sections(spark, d):
    s = html.structured_pages(_t(spark, d, "pages"))
    return s.select("page_id", F.inline("sections")).withColumn("key", F.substring("content", 1, 80)).withColumn("r", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("ord"))).where("r = 1").drop("r", "key")


def page_chunks(spark, d):
    """HTML pages as structured pages, and those as chunks."""
    h = html.structured_pages(_t(spark, d, "pages")).join(_t(spark, d, "pages").select("page_id", "url"), "page_id")
    p = h.select(
        F.col("page_id").cast("string").alias("file_name"), "url", "title", F.lit("").alias("content"), F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"))).alias("sections"),
        F.transform("faq", lambda f: F.struct(f["question"].alias("question"), f["answer"].alias("answer"), F.lit("").alias("section_title"))).alias("faq"),
        F.transform("tables", lambda t: F.struct(F.lit("").alias("caption"), F.lit("").alias("section_title"), B.table_markdown(t).alias("markdown"))).alias("tables"),
        F.expr("cast(array() as array<struct<title:string,content:string>>)").alias("cards"), F.struct(F.lit("").alias("category"), F.lit("").alias("document_type")).alias("metadata"),
    )
    c = pages.page_chunks(p)
    return c.select(F.col("file_name").cast("long").alias("page_id"), "chunk_index", "chunk_id", "chunk_type", "section_title", F.length("content").alias("n_chars"))


def crawl_frontier(spark, d):
    """From every page's address, as a site map would name them, over the pages' own links."""
    p = _t(spark, d, "pages").select(C.resolved(F.col("url"), F.col("url")).alias("src"), F.explode(html.links(F.col("html"))).alias("l"))
    edges = p.select("src", C.resolved(F.col("src"), F.col("l")).alias("dst")).where("dst IS NOT NULL").distinct()
    seeds = _t(spark, d, "pages").select(C.resolved(F.col("url"), F.col("url")).alias("url"))
    return C.frontier(edges, seeds, 3)


def change_detection(spark, d):
    p = _t(spark, d, "pages").select("url", "page_id", F.sha2("html", 256).alias("h"))
    old = p.select("url", F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("h")).alias("old_h")).where("page_id % 11 <> 0")
    j = p.join(old, "url", "left")
    return j.select("page_id", F.when(F.col("old_h").isNull(), "new").when(F.col("old_h") == F.col("h"), "unchanged").otherwise("changed").alias("state"))


def leaderboards(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("lang", "source", F.col("quality").cast("double").alias("quality"))
    return E.leaderboards(j, ["lang", "source"], "quality")


def report_summary(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    return j.groupBy("lang").agg(F.count("*").alias("n"), E.ratio(F.col("quality") == 1, known).alias("pass_rate"), E.ratio(F.col("toxic") == 1, known).alias("toxic_rate"), E.ratio(F.contains("text", F.lit("\n")), F.length("text") > 500).alias("multiline_rate"))


def gates(spark, d):
    m = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").agg(F.round(F.avg(F.col("quality").cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("toxic_rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    m = m.unpivot([], ["pass_rate", "toxic_rate", "mean_chars"], "name", "value")
    return E.gates(m, spark.createDataFrame(BOUNDS, "kind string, name string, bound double"))


def report_diff(spark, d):
    lab = _t(spark, d, "labels")
    return E.report_diff(lab.select("doc_id", (F.col("quality") == 1).alias("passed")), lab.select("doc_id", (F.col("toxic") == 0).alias("passed")), "doc_id")


def failure_counts_zero_filled(spark, d):
    keys = spark.createDataFrame([("error",), ("click",), ("timeout",), ("refund",)], "event_type string")
    return E.zero_filled(_t(spark, d, "events"), keys, "event_type")


def latency_percentiles(spark, d):
    return E.percentiles(_t(spark, d, "events"), "value", "event_type")


def hit_ratio(spark, d):
    """Scenario statistics: error rate, share of purchases among clicks and purchases, events per hour."""
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), E.ratio(F.col("event_type") == "error").alias("error_rate"), E.ratio(F.col("event_type") == "purchase", F.col("event_type").isin("click", "purchase")).alias("hit_ratio"), F.round(F.avg(k), 6).alias("mean_k"))


def session_gap(spark, d):
    s = E.sessions(_t(spark, d, "events"), 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def trailing_6h_count(spark, d):
    return E.trailing_count(_t(spark, d, "events"), 6 * 3600).select("event_id", "recent")


def first_inflight(spark, d):
    e = _t(spark, d, "events").withColumn("slot", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
    return e.groupBy("event_type", "slot").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("waiting"))


def telemetry(spark, d):
    return state.telemetry(_t(spark, d, "events")).select("event_id", "user_hash", "event_type")


def history_limit(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = _t(spark, d, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 4")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|")).alias("history_md5"))


def last_assistant_turn(spark, d):
    return E.last_before(_t(spark, d, "conversations"), "assistant").select("conv_id", "turn", "role", "last_turn")


def inherit_intent(spark, d):
    """A short user turn takes the first word of the last longer user turn as its topic."""
    c = _t(spark, d, "conversations").where("role = 'user'").withColumn("n", F.size(T.query_tokens(F.col("text"))))
    topic = F.when(F.col("n") > 40, F.element_at(T.query_tokens(F.col("text")), 1))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", (F.col("n") <= 40).alias("follow_up"), F.last(topic, ignorenulls=True).over(w).alias("topic"))


QUERIES = {f.__name__: f for f in (content_signature_dups, first_by_signature, incremental_anti, keyed_upsert, manifest_counts, length_stats, quality_audit, coverage, page_title_links, html_structured, page_sections, page_chunks, crawl_frontier, change_detection, leaderboards, report_summary, gates, report_diff, failure_counts_zero_filled, latency_percentiles, hit_ratio, session_gap, trailing_6h_count, first_inflight, telemetry, history_limit, last_assistant_turn, inherit_intent)}

from marlstone.plans.text_queries import _R, ORACLE_SQL as _TEXT, _clean  # noqa: E402

_SIG = r"md5(array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N} ]', '', 'g'), ' '), lambda w: w <> '')), ' '))"
_QT = r"list_filter(list_transform(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"
_LINKS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_CANON = "(CASE WHEN trim({x}, '/') = '' THEN '/' ELSE rtrim(regexp_replace({x}, '/+', '/', 'g'), '/') END)"
_VALUES = ", ".join(f"('{k}', '{n}', {b}::DOUBLE)" for k, n, b in BOUNDS)

ORACLE_SQL = {
    "content_signature_dups": f"SELECT {_SIG} AS signature, count(*) AS n, min(doc_id) AS first_id, count(*) - 1 AS extra FROM documents GROUP BY 1 HAVING count(*) > 1",
    "first_by_signature": f"SELECT doc_id, source, lang, {_SIG} AS signature FROM documents QUALIFY row_number() OVER (PARTITION BY {_SIG} ORDER BY doc_id) = 1",
    "incremental_anti": f"WITH t AS (SELECT doc_id, sha256({_clean('text')}) AS h, {_R['li']} AS low FROM documents) SELECT doc_id, h FROM t WHERE doc_id % 2 = 1 AND NOT low AND h NOT IN (SELECT h FROM t WHERE doc_id % 2 = 0)",
    "keyed_upsert": "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice + 1, 2) ELSE p_retailprice END AS price FROM part",
    "manifest_counts": "SELECT 'lang' AS field, coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM documents GROUP BY ALL",
    "length_stats": "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6)::DOUBLE AS median, min(length(text))::INT AS shortest, max(length(text))::INT AS longest FROM documents GROUP BY source",
    "quality_audit": f"WITH s AS ({_TEXT['chunk_quality_score']}), g AS (SELECT source, floor(score * 10)::BIGINT AS bin, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY ALL) SELECT *, CASE WHEN bin >= 9 THEN 'A' WHEN bin >= 7 THEN 'B' WHEN bin >= 5 THEN 'C' ELSE 'D' END AS grade FROM g".replace("WITH s AS (WITH t AS", "WITH s AS (WITH t AS"),
    "coverage": "WITH a AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, coalesce(docs, 0) AS docs, coalesce(labelled, 0) AS labelled, round(100 * coalesce(labelled, 0)::DOUBLE / docs, 2) AS percent FROM a FULL OUTER JOIN b USING (source)",
    "page_title_links": f"WITH l AS (SELECT page_id, html, {_LINKS} AS l FROM pages) SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(l)::INT AS n_links, md5(array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]), ' ')) AS links_md5 FROM l",
    "crawl_frontier": rf"""WITH RECURSIVE p AS (SELECT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || {_CANON.format(x="regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)")} AS src, unnest({_LINKS}) AS l FROM pages),
a AS (SELECT DISTINCT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || {_CANON.format(x="regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)")} AS url FROM pages),
e AS (SELECT DISTINCT src, regexp_extract(src, '^([a-z]+://[^/]*)', 1) || {_CANON.format(x="regexp_replace(l, '[?#].*$', '')")} AS dst FROM p WHERE l LIKE '/%' UNION
  SELECT DISTINCT src, lower(regexp_extract(l, '^([a-zA-Z]+://[^/?#]*)', 1)) || {_CANON.format(x="regexp_extract(l, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)")} FROM p WHERE regexp_matches(l, '^[a-zA-Z]+://.')),
f AS (SELECT url, 0 AS depth FROM a UNION SELECT dst, depth + 1 FROM f JOIN e ON e.src = f.url WHERE depth < 3)
SELECT url, min(depth)::INT AS depth FROM f GROUP BY url""",
    "change_detection": "WITH p AS (SELECT url, page_id, sha256(html) AS h FROM pages), o AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN '' ELSE h END AS old_h FROM p WHERE page_id % 11 <> 0) SELECT page_id, CASE WHEN old_h IS NULL THEN 'new' WHEN old_h = h THEN 'unchanged' ELSE 'changed' END AS state FROM p LEFT JOIN o USING (url)",
    "leaderboards": "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS field, coalesce(lang, source) AS value, count(*) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))",
    "report_summary": "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality IS NOT NULL THEN (quality = 1)::INT END), 6) AS pass_rate, round(avg(CASE WHEN quality IS NOT NULL THEN (toxic = 1)::INT END), 6) AS toxic_rate, round(avg(CASE WHEN length(text) > 500 THEN contains(text, chr(10))::INT END), 6) AS multiline_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "gates": f"WITH b(kind, name, bound) AS (VALUES {_VALUES}), j AS (SELECT round(avg(quality), 6) AS pass_rate, round(avg(toxic), 6) AS toxic_rate, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id)), m AS (SELECT 'pass_rate' AS name, pass_rate AS value FROM j UNION ALL SELECT 'toxic_rate', toxic_rate FROM j UNION ALL SELECT 'mean_chars', mean_chars FROM j) SELECT kind, name, bound, value, CASE WHEN value IS NULL THEN 'warning' WHEN kind = 'minimum' AND value < bound OR kind = 'maximum' AND value > bound THEN 'fail' ELSE 'pass' END AS verdict FROM b LEFT JOIN m USING (name)",
    "report_diff": "SELECT CASE WHEN quality = 1 AND toxic <> 0 THEN 'new_failure' WHEN quality <> 1 AND toxic = 0 THEN 'fixed' WHEN quality <> 1 THEN 'still_failing' ELSE 'passing' END AS change, count(*) AS n FROM labels GROUP BY 1",
    "failure_counts_zero_filled": "WITH k(event_type) AS (VALUES ('error'), ('click'), ('timeout'), ('refund')) SELECT event_type, count(event_id) AS n FROM k LEFT JOIN events USING (event_type) GROUP BY 1",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "hit_ratio": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS error_rate, round(avg(CASE WHEN event_type IN ('click', 'purchase') THEN (event_type = 'purchase')::INT END), 6) AS hit_ratio, round(avg((props::JSON ->> '$.k')::INT), 6) AS mean_k FROM events GROUP BY 1",
    "session_gap": "WITH t AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000)::INT, 0) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM t) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2",
    "trailing_6h_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events",
    "first_inflight": "SELECT event_type, epoch_us(ts) // 3600000000 AS slot, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS waiting FROM events GROUP BY 1, 2",
    "telemetry": "SELECT event_id, substr(sha256(user_id::VARCHAR), 1, 16) AS user_hash, event_type FROM events",
    "history_limit": "WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS history_md5 FROM t GROUP BY 1",
    "last_assistant_turn": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_turn FROM conversations",
    "inherit_intent": f"WITH t AS (SELECT conv_id, turn, {_QT} AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, len(q) <= 40 AS follow_up, last_value(CASE WHEN len(q) > 40 THEN q[1] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM t",
}
