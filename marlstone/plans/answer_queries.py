"""Queries of price rows, rule tables, routing, recovery and saved sessions, with their DuckDB twins.

Price rows are made of lineitem and part: every row is one, their columns stand for a row's fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import pricing as P
from marlstone.operators import recovery as V
from marlstone.operators import rules as R

ASKED = [("red widget", "ECONOMY", True), ("small ring", "STANDARD", False), ("big green gear price", "PROMO", True)]
ALIASES = [("copyright", "legal", 1.0), ("all rights reserved", "legal", 1.0), ("license", "license", 0.95), ("http", "link", 0.9), ("the", "english", 0.5), ("der", "german", 0.5)]
PHRASES = ["how much is a credit card", "which credit card, list them", "is there a business account fee", "activate my card online", "help with a problem", "overview of faq", "who are you", "compare account and card", "debit card list", "password"]
BASE = ("price list", "conditions", "current")
BY_LABEL = (("pricing", ("fee table", "tariff")), ("cards", ("card", "limit", "withdrawal")), ("personal_account", ("account", "statement", "overdraft")), ("product_overview", ("catalog",)))
TTL = 86400.0


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as price rows."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.format_string("part-%d", "l_partkey").alias("product"), F.col("l_returnflag").alias("fee"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("CZK").alias("currency"),
        F.when(F.col("l_linenumber") % 2 == 1, "monthly").otherwise("yearly").alias("period"), F.year("l_shipdate").alias("year"), (F.col("l_linestatus") == "O").alias("active"), F.when(F.col("l_discount") < 0.02, 100).when(F.col("l_discount") < 0.05, 90).otherwise(70).alias("official"),
        (F.col("l_tax") < 0.04).alias("from_table"), (1.0 - F.col("l_tax") * 8.0).alias("confidence"), F.col("l_extendedprice").alias("score"),
    )


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """part as price rows with tokens."""
    t, size = spark.read.parquet(f"{d}/part.parquet"), F.col("p_size")
    return t.select(
        F.col("p_partkey").alias("row_id"), F.col("p_type").alias("product"), F.split(F.lower("p_name"), " ").alias("tokens"), (size > 25).alias("primary"), (size * 2).alias("official"), (F.col("p_retailprice") > 905).alias("active"),
        (F.lit(2015) + size % 12).alias("year"), F.when(size % 7 == 0, 0.5).otherwise(0.9).alias("confidence"), F.col("p_brand").alias("value"), F.col("p_name").alias("line"),
    )


def price_exact_facts(spark, d):
    return P.exact_facts(_facts(spark, d)).select("product", "fee", "value", "currency", "period", "year", "score")


def price_fee_slots(spark, d):
    return P.fee_slots(_facts(spark, d)).select("product", "fee", "period", "active", "year", "official", "from_table", "score")


def price_index_rows(spark, d):
    return P.index_rows(_facts(spark, d)).select("product", "fee", "period", "year", "official", "from_table", "confidence")


def price_resolve(spark, d):
    return P.resolve(_rows(spark, d), ASKED).select("query", "rank", "row_id", "score", "sure")


def price_generations(spark, d):
    return P.generations(_rows(spark, d)).select("product", "row_id", "class", "year")


def product_detection(spark, d):
    p = P.product_of(F.col("text"), ALIASES)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", p["product"].alias("product"), p["confidence"].alias("confidence"))


def answer_assembly(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_brand", F.col("p_type").alias("product"), F.col("p_name").alias("line"), F.col("p_partkey").alias("rank"))
    return P.answer_lines(rows, "p_brand")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int"))
    return spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", F.when(F.col("turn") % 4 < 2, phrase).otherwise(F.concat_ws(" ", "text", phrase)).alias("text"))


def query_labels(spark, d):
    q = _asked(spark, d).withColumn("labels", R.labels(F.col("text")))
    w = R.weights(F.col("labels"))
    return q.select("conv_id", "turn", F.array_join("labels", ",").alias("labels"), w["sparse"].alias("sparse"), w["dense"].alias("dense"), w["min_score"].alias("min_score"), R.route(F.col("text"), F.col("labels")).alias("route"), F.md5(R.wider_query(F.col("text"), F.col("labels"), BASE, BY_LABEL)).alias("wider_md5"))


def recovery_merge(spark, d):
    """Each language's three longest documents, and two more from a restricted pool of the twelve with the least ids."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.coalesce("lang", F.lit("?")).alias("query"), F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("family"), (F.col("doc_id") % 3 != 0).alias("current"), "n_chars")
    from pyspark.sql import Window

    w = Window.partitionBy("query")
    first = docs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "key"))).where("rank <= 3")
    pool = docs.withColumn("rank", F.row_number().over(w.orderBy("key"))).where("rank <= 12")
    return V.merge_recovery(first, V.restrict_pool(pool, first))


def session_saves(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    saves = e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_type") == "error", (F.col("event_id") % 3).cast("long")).alias("expected"))
    return V.saved_versions(saves, "user_id", "at", "expected", "event_id", TTL).select("event_id", "user_id", "accepted", "version")


QUERIES = {f.__name__: f for f in (price_exact_facts, price_fee_slots, price_index_rows, price_resolve, price_generations, product_detection, answer_assembly, query_labels, recovery_merge, session_saves)}

_FACTS = "SELECT 'part-' || l_partkey AS product, l_returnflag AS fee, l_quantity::INT::VARCHAR AS value, 'CZK' AS currency, CASE WHEN l_linenumber % 2 = 1 THEN 'monthly' ELSE 'yearly' END AS period, year(l_shipdate)::INT AS year, l_linestatus = 'O' AS active, CASE WHEN l_discount < 0.02 THEN 100 WHEN l_discount < 0.05 THEN 90 ELSE 70 END AS official, l_tax < 0.04 AS from_table, 1.0::DOUBLE - l_tax * 8.0::DOUBLE AS confidence, l_extendedprice AS score FROM lineitem"
_ROWS = "SELECT p_partkey AS row_id, p_type AS product, string_split(lower(p_name), ' ') AS tokens, p_size > 25 AS prim, p_size * 2 AS official, p_retailprice > 905 AS active, 2015 + p_size % 12 AS year, CASE WHEN p_size % 7 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, p_brand AS value FROM part"


def _best(keys: str, rank: str, out: str, where: str = "true") -> str:
    return f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank}) AS r FROM ({_FACTS}) WHERE {where}) WHERE r = 1"


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]::VARCHAR[]"


_QS = ", ".join(f"('{q}', '{p}', {str(m).lower()})" for q, p, m in ASKED)
_SCORE = f"round(len(list_intersect(list_distinct(tokens), string_split(lower(query), ' '))) * {P.OVERLAP}::DOUBLE + official / 10.0 + CASE WHEN active THEN {P.ACTIVE} ELSE {P.INACTIVE} END + CASE WHEN product = asked THEN {P.PRODUCT} ELSE 0 END + CASE WHEN NOT asked_primary THEN 0 WHEN prim THEN {P.PRIMARY} ELSE {P.NOT_PRIMARY} END + CASE WHEN value IS NOT NULL THEN {P.KNOWN} ELSE {P.MISSING} END + least({P.YEAR_MOST}, greatest(0.0, (coalesce(year, 0) - {P.BASE_YEAR}) * {P.YEAR_STEP}::DOUBLE)), 4)"
_SINGLE = [(a, p, min(c, 0.82) if " " not in a else c, i) for i, (a, p, c) in enumerate(ALIASES)]
_BY_SURE = sorted(_SINGLE, key=lambda x: (-x[2], x[3]))


def _hit(a: str) -> str:
    return f"contains(lower(text), '{a}')" if " " in a else rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){a}([^\p{{L}}\p{{N}}_]|$)')"


_RULES = ", ".join(f"({i}, {', '.join(_list(getattr(r, f)) for f in ('any', 'none', 'requires', 'lacks', 'add', 'remove'))})" for i, r in enumerate(R.RULES, 1))
_SOME = lambda xs, t="t": f"len(list_filter({xs}, lambda w: contains({t}, w))) > 0"
_HAS = lambda x: f"list_contains(labels, '{x}')"
_TERMS = f"list_concat({_list(BASE)}, " + ", ".join(f"CASE WHEN {_HAS(n)} THEN {_list(ts)} ELSE []::VARCHAR[] END" for n, ts in BY_LABEL) + ")"

ORACLE_SQL = {
    "price_exact_facts": _best("product, fee, value, currency, period", "year DESC, score DESC", "product, fee, value, currency, period, year, score"),
    "price_fee_slots": _best("product, fee, period", "active DESC, year DESC, official DESC, from_table DESC, score DESC", "product, fee, period, active, year, official, from_table, score"),
    "price_index_rows": _best("product, fee, period", "year DESC, official DESC, from_table DESC, confidence DESC", "product, fee, period, year, official, from_table, confidence", "active"),
    "price_resolve": f"WITH q(query, asked, asked_primary) AS (VALUES {_QS}), s AS (SELECT *, CASE WHEN confidence < {P.LEAST_CONFIDENCE} THEN {P.REJECTED} ELSE {_SCORE} END AS score FROM ({_ROWS}), q), g AS (SELECT *, max((prim AND asked_primary)::INT) OVER (PARTITION BY query) AS left_over FROM s WHERE score > 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row_id)::INT AS rank FROM g WHERE left_over = 0 OR prim) SELECT query, rank, row_id, score::DOUBLE AS score, CASE WHEN product = asked AND prim AND official >= 80 THEN 'high' WHEN product = asked OR official >= 70 THEN 'medium' ELSE 'low' END AS sure FROM k WHERE rank <= 5",
    "price_generations": f"WITH c AS (SELECT *, CASE WHEN active AND prim THEN 1 WHEN prim THEN 2 WHEN active THEN 3 ELSE 4 END AS class FROM ({_ROWS})), m AS (SELECT *, min(class) OVER (PARTITION BY product) AS least FROM c), y AS (SELECT *, max(year) OVER (PARTITION BY product) AS newest FROM m WHERE class = least) SELECT product, row_id, class, year FROM y WHERE year = newest",
    "product_detection": f"SELECT doc_id, CASE {' '.join(f'WHEN {_hit(a)} THEN {p!r}' for a, p, _, _ in _BY_SURE)} END AS product, CASE {' '.join(f'WHEN {_hit(a)} THEN {c}::DOUBLE' for a, _, c, _ in _BY_SURE)} END AS confidence FROM documents",
    "answer_assembly": "WITH d AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS rank FROM part GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY rank, p_name) AS n FROM d), p AS (SELECT p_brand, p_type, min(rank) AS best, string_agg(p_name, '; ' ORDER BY n) AS t FROM l WHERE n <= 3 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY best, p_type) AS i FROM p) SELECT p_brand, string_agg(p_type || ': ' || t, chr(10) ORDER BY i) AS answer FROM o WHERE i <= 3 GROUP BY p_brand",
    "query_labels": rf"""WITH RECURSIVE r(ord, anyt, nonet, req, lacks, adds, rems) AS (VALUES {_RULES}),
q AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN p ELSE concat_ws(' ', text, p) END AS text FROM (SELECT *, ({_list(PHRASES)})[((conv_id + turn) % {len(PHRASES)} + 1)::INT] AS p FROM conversations WHERE role = 'user')),
s AS (SELECT conv_id, turn, text, lower(text) AS t, 0 AS ord, []::VARCHAR[] AS have FROM q UNION ALL
SELECT conv_id, turn, text, t, r.ord, CASE WHEN (len(anyt) = 0 OR {_SOME('anyt')}) AND NOT ({_SOME('nonet')}) AND (len(req) = 0 OR list_has_any(req, have)) AND NOT list_has_any(lacks, have) THEN list_filter(list_concat(have, list_filter(adds, lambda x: NOT list_contains(have, x))), lambda x: NOT list_contains(rems, x)) ELSE have END FROM s JOIN r ON r.ord = s.ord + 1),
l AS (SELECT conv_id, turn, text, t, CASE WHEN len(have) = 0 THEN ['general'] ELSE list_sort(have) END AS labels FROM s WHERE ord = {len(R.RULES)}),
w AS (SELECT *, CASE WHEN {_HAS('pricing')} THEN 0.65 WHEN {_HAS('support')} THEN 0.30 WHEN {_HAS('faq')} THEN 0.35 ELSE 0.40 END::DOUBLE AS a FROM l),
x AS (SELECT *, greatest(a, CASE WHEN {_HAS('product_overview')} THEN 0.50 ELSE 0 END, CASE WHEN {_HAS('credit_card')} THEN 0.45 ELSE 0 END)::DOUBLE AS sparse FROM w)
SELECT conv_id, turn, array_to_string(labels, ',') AS labels, sparse, round(1 - sparse, 2) AS dense, CASE WHEN {_HAS('product_overview')} THEN -10.0 WHEN {_HAS('cards')} THEN -4.0 ELSE -2.0 END::DOUBLE AS min_score,
CASE WHEN contains(t, 'password') OR contains(t, 'hack') THEN 'blocked' WHEN contains(t, 'who are you') OR contains(t, 'are you a robot') THEN 'identity' WHEN {_HAS('activation_flow')} THEN 'procedural' WHEN len(regexp_extract_all(t, '[^ \t\n]+')) < 2 THEN 'clarification' WHEN regexp_matches(t, '\b(versus|vs|compare|difference between)\b') THEN 'comparison' WHEN {_HAS('product_overview')} THEN 'overview' WHEN {_HAS('pricing')} THEN 'price_row' WHEN {_HAS('faq')} OR {_HAS('support')} THEN 'soft_guidance' ELSE 'retrieval' END AS route,
md5(trim(concat_ws(' ', text, array_to_string(list_slice(list_filter({_TERMS}, lambda z: NOT contains(t, lower(z))), 1, 8), ' ')))) AS wider_md5 FROM x""",
    "recovery_merge": """WITH d AS (SELECT coalesce(lang, '?') AS query, doc_id AS key, coalesce(source, '') AS family, doc_id % 3 <> 0 AS cur, n_chars FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, key) AS rank FROM d) WHERE rank <= 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY key) AS rank FROM d) WHERE rank <= 12),
k AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.query = p.query AND f.family = p.family AND f.family <> '') AS known FROM p),
c AS (SELECT * FROM (SELECT *, bool_or(cur) OVER (PARTITION BY query) AS left_over FROM k) WHERE cur OR NOT left_over),
n AS (SELECT * EXCLUDE (left_over) FROM (SELECT * EXCLUDE (left_over), bool_or(known) OVER (PARTITION BY query) AS left_over FROM c) WHERE known OR NOT left_over),
a AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank, key) AS i FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query = n.query AND f.key = n.key))
SELECT query, key, rank::INT AS rank, false AS recovery FROM f UNION ALL SELECT query, key, (i + coalesce((SELECT max(rank) FROM f WHERE f.query = a.query), 0))::INT, true FROM a WHERE i <= 2""",
    "session_saves": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS tm, CASE WHEN event_type = 'error' THEN event_id % 3 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, i, true AS accepted, 1::BIGINT AS version, tm AS written FROM e WHERE i = 1 UNION ALL
SELECT event_id, user_id, i, yes, CASE WHEN yes THEN v + 1 ELSE v END, CASE WHEN yes THEN tm ELSE w END FROM (SELECT e.event_id, e.user_id, e.i, e.tm, CASE WHEN gone THEN NULL ELSE b.written END AS w, CASE WHEN gone THEN 0 ELSE b.version END AS v, e.expected IS NULL OR gone OR e.expected = b.version AS yes FROM (SELECT s.*, e.tm - s.written > {TTL} AS gone FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT event_id, user_id, accepted, version FROM s""",
}
