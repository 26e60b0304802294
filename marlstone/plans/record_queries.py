"""Queries of ingest joins, document types and answer labels, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import records as R

TITLES = ("Sazebník pro podnikatele", "Osobní účet eKonto", "Karta a výběr z bankomatu", "Hypotéka: odhad", "Všeobecné podmínky", "Časté dotazy", "Již nenabízené produkty", "Investice a fondy", "Vedení účtu zdarma", "Pojištění karet", "Výroční zpráva", "Archived notice")
STRATEGIES = ("identity_direct", "pricing_row_direct", "generic_llm", "overview_fallback", "clarification_direct", "fallback_no_answer", "soft_guidance_direct", "card_overview_direct", "guided_flow_direct", "key_overview_direct", "other")
KINDS = ("table", "pdf_table", "section_text", "pricing_row")


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values, n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def document_types(spark, d):
    x = F.concat_ws(" ", _pick(TITLES, F.col("doc_id")), "source")
    return _t(spark, d, "documents").select("doc_id", R.category(x).alias("category"), R.pricing_type(x).alias("pricing_type"), R.document_type(x).alias("document_type"), R.archived(x).alias("archived"))


def answer_labels(spark, d):
    s = _pick(STRATEGIES, F.col("event_id"))
    origin = R.answer_origin(s)
    strategy = R.answer_strategy(F.col("event_id") % 9 == 0, F.col("event_id") % 3 > 0, _pick(KINDS, F.col("event_id")), F.when(F.col("event_id") % 5 < 3, "pricing").otherwise("terms"))
    return _t(spark, d, "events").select("event_id", s.alias("given"), origin.alias("origin"), R.confidence_bucket(origin).alias("bucket"), s.isin(*R.DEGRADED).alias("degraded"), strategy.alias("strategy"))


def rewrite_guard(spark, d):
    q = F.col("text")
    rewrite = F.when(F.col("turn") % 4 == 0, F.concat(q, F.lit("  "))).when(F.col("turn") % 4 == 1, F.concat(q, F.lit(" "), q)).when(F.col("turn") % 4 == 2, F.lit("zzz")).otherwise(F.concat(F.lit("x "), q))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(R.accepted_rewrite(q, rewrite)).alias("query_md5"))


def metadata_last_wins(spark, d):
    meta = _t(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", "event_type")
    return R.with_metadata(_t(spark, d, "customer").select("c_custkey"), meta, "c_custkey", "ts", "event_id").select("c_custkey", "event_id", "event_type")


def new_downloads(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.format_string("u/%08d", F.col("doc_id") % 5000).alias("url"), T.content_hash(F.col("text")).alias("digest"))
    return R.new_downloads(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")).select("url", "digest")


def replace_derived(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 7 == 0).alias("derived"), F.lit("old").alias("version"))
    fresh = _t(spark, d, "orders").where("o_orderkey % 14 = 0 OR o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("chunk_id"), F.lit(True).alias("derived"), F.lit("new").alias("version"))
    return R.replaced(o, F.col("derived"), fresh, "chunk_id")


def crawl_differences(spark, d):
    return R.differences(_t(spark, d, "customer").select(F.col("c_custkey").alias("key")), _t(spark, d, "orders").select(F.col("o_custkey").alias("key")).where("key % 5 <> 0"), "key")


def resumed_ids(spark, d):
    """Ids of a checkpoint that are stored indeed."""
    return _t(spark, d, "labels").select("doc_id").distinct().join(_t(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi")


def cache_invalidation(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("namespace"), (F.col("user_id") % 10).cast("string").alias("product"))
    return R.invalidated(R.invalidated(e, "click"), None, "3")


def top_frequencies(spark, d):
    return R.top_values(_t(spark, d, "documents"), ["source", "lang"], 3).select("field", "value", "n", F.col("place").cast("int").alias("place"))


QUERIES = {f.__name__: f for f in (document_types, answer_labels, rewrite_guard, metadata_last_wins, new_downloads, replace_derived, crawl_differences, resumed_ids, cache_invalidation, top_frequencies)}


def _has(x, terms):
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _first(x, rules, other):
    return "CASE " + " ".join(f"WHEN {_has(x, terms)} THEN '{n}'" for n, terms in rules) + f" ELSE '{other}' END"


def _of(values, n):
    return f"{[*values]!r}[({n}) % {len(values)} + 1]"


_W = dict(R.CATEGORIES)
_FOLDED = lambda x: f"list_filter(regexp_split_to_array(translate(lower({x}), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_CLEANED = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ORACLE_SQL = {
    "document_types": f"WITH t AS (SELECT doc_id, lower({_of(TITLES, 'doc_id')} || ' ' || source) AS x FROM documents) SELECT doc_id, coalesce({', '.join(f'CASE WHEN {_has(chr(120), _W[k])} THEN {n!r} END' for k, n in R.FIRST_CATEGORIES)}, {_first('x', R.CATEGORIES, 'unknown')}) AS category, {_first('x', R.PRICING_TYPES, 'generic_pricing')} AS pricing_type, {_first('x', R.DOCUMENT_TYPES, 'document')} AS document_type, {_has('x', R.ARCHIVED)} AS archived FROM t",
    "answer_labels": f"WITH t AS (SELECT event_id, {_of(STRATEGIES, 'event_id')} AS given, {_of(KINDS, 'event_id')} AS kind FROM events), o AS (SELECT *, CASE {' '.join(f'WHEN given IN ({', '.join(repr(n) for n in names)}) THEN {k!r}' for k, names in R.ORIGINS)} WHEN ends_with(given, '_overview_direct') THEN 'overview_direct' ELSE 'llm_generated' END AS origin FROM t) SELECT event_id, given, origin, CASE WHEN origin IN {R.HIGH!r} THEN 'high' WHEN origin = 'unsupported' THEN 'low' ELSE 'medium' END AS bucket, given IN {R.DEGRADED!r} AS degraded, CASE WHEN event_id % 9 = 0 THEN 'pricing_row_direct' WHEN event_id % 3 > 0 AND event_id % 5 < 3 AND kind IN ('table', 'pdf_table') THEN 'pricing_table_llm' WHEN event_id % 3 > 0 AND event_id % 5 < 3 THEN 'pricing_section_llm' ELSE 'generic_llm' END AS strategy FROM o",
    "rewrite_guard": f"WITH t AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN text || '  ' WHEN 1 THEN text || ' ' || text WHEN 2 THEN 'zzz' ELSE 'x ' || text END AS r FROM conversations) SELECT conv_id, turn, md5(CASE WHEN coalesce(trim(r) = '' OR lower(trim(r)) = lower(trim(text)) OR length(r) > 1.5 * length(text) OR NOT list_has_any({_FOLDED('text')}, {_FOLDED('r')}), true) THEN text ELSE r END) AS query_md5 FROM t",
    "metadata_last_wins": "WITH m AS (SELECT * FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT c_custkey, event_id, event_type FROM customer LEFT JOIN m ON user_id = c_custkey",
    "new_downloads": f"WITH d AS (SELECT doc_id, printf('u/%08d', doc_id % 5000) AS url, sha256({_CLEANED}) AS digest FROM documents) SELECT min(url) AS url, digest FROM d WHERE doc_id % 3 <> 0 AND url NOT IN (SELECT url FROM d WHERE doc_id % 3 = 0) AND digest NOT IN (SELECT digest FROM d WHERE doc_id % 3 = 0) GROUP BY digest",
    "replace_derived": "SELECT o_orderkey AS chunk_id, false AS derived, 'old' AS version FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, true, 'new' FROM orders WHERE (o_orderkey % 14 = 0 OR o_orderkey % 11 = 0) AND o_orderkey % 7 = 0",
    "crawl_differences": "WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey % 5 <> 0) SELECT 'left' AS side, key FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'right', key FROM b WHERE key NOT IN (SELECT key FROM a)",
    "resumed_ids": "SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
    "cache_invalidation": "SELECT event_id, event_type AS namespace, (user_id % 10)::VARCHAR AS product FROM events WHERE event_type IS DISTINCT FROM 'click' AND user_id % 10 IS DISTINCT FROM 3",
    "top_frequencies": "WITH v AS (SELECT 'source' AS field, coalesce(source, 'unknown') AS value FROM documents UNION ALL SELECT 'lang', coalesce(lang, 'unknown') FROM documents), n AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL) SELECT field, value, n, (row_number() OVER (PARTITION BY field ORDER BY n DESC, value))::INT AS place FROM n QUALIFY place <= 3",
}
