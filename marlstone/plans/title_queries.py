"""Queries of titles, years, page boxes, prepended rankings and account fees, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import pricing as P
from marlstone.functions import text as T
from marlstone.operators import records as R
from marlstone.operators import retrieval as S

# Made-up metadata of pages and fees by number, in SQL that both engines read.
TITLE = "CASE page_id % 5 WHEN 0 THEN concat('sazebnik_', substr(md5(url), 1, 9), '.pdf') WHEN 1 THEN md5(url) WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN 'Cenik-osobni_ucet 2023.pdf' ELSE 'abc' END"
URL = "CASE page_id % 3 WHEN 0 THEN 'http://x.example.com/cs/' WHEN 1 THEN url ELSE concat('https://x.example.com/en/documents/osobni-ucty/', CAST(page_id AS STRING), 'b_karty/ÚČET-2019') END"
FILE = "CASE page_id % 4 WHEN 0 THEN 'vop-2024_a043bb3907.pdf' WHEN 1 THEN '' WHEN 2 THEN CAST(NULL AS STRING) ELSE 'ab.c' END"
CATEGORY = "CASE page_id % 7 WHEN 0 THEN 'retail' WHEN 1 THEN 'insurance' ELSE '' END"
KIND = "CASE page_id % 2 WHEN 0 THEN 'pricing_row' ELSE '' END"
DATE = "CASE page_id % 4 WHEN 0 THEN '12. 3. 1987' WHEN 1 THEN 'v19990' ELSE CAST(NULL AS STRING) END"
_PAGES = [("page_id", "page_id"), ("title", TITLE), ("url", URL), ("file_name", FILE), ("category", CATEGORY), ("chunk_type", KIND), ("date", DATE)]
FEE = "CASE l_suppkey % 11 WHEN 0 THEN 'Vedení běžného účtu' WHEN 1 THEN 'Monthly account fee' WHEN 2 THEN 'Poplatek za vedení' WHEN 3 THEN 'Cena tarifu' WHEN 4 THEN 'Vedení vedlejší měnové složky účtu' WHEN 5 THEN 'SMS notifikace' WHEN 6 THEN 'Měsíční poplatek' WHEN 7 THEN 'Account maintenance' WHEN 8 THEN CAST(NULL AS STRING) WHEN 9 THEN 'uctu a vedeni' ELSE 'Poplatek' END"
ASKED = "CASE l_partkey % 8 WHEN 0 THEN 'Kolik stojí účet?' WHEN 1 THEN 'Cena konta' WHEN 2 THEN 'cena eKonto' WHEN 3 THEN 'monthly card fee' WHEN 4 THEN 'Vedeni' WHEN 5 THEN 'měsíční poplatek za kartu' WHEN 6 THEN 'account' ELSE CAST(NULL AS STRING) END"
_BLOCK = [("page", "l_orderkey"), ("line", "l_linenumber"), ("part", "l_partkey"), ("x0", "l_quantity * 10"), ("y0", "CAST(l_partkey % 700 AS DOUBLE)"), ("x1", "l_quantity * 10 + l_linenumber * 30"), ("y1", "l_partkey % 700 + 12.0D")]
_BOX = [("page", "o_orderkey"), ("x0", "CAST((o_custkey % 40) * 10 AS DOUBLE)"), ("y0", "CAST(o_orderkey % 500 AS DOUBLE)"), ("x1", "(o_custkey % 40) * 10 + 250.0D"), ("y1", "o_orderkey % 500 + 250.0D")]
PRICED, SPARSE, DENSE = 0.65, 0.4, 0.6


def _t(spark, d, name, columns) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*(f"{e} AS {n}" for n, e in columns))


def human_titles(spark, d):
    title = T.human_title(*(F.col(c) for c in ("title", "url", "file_name", "category", "chunk_type")))
    return _t(spark, d, "pages", _PAGES).select("page_id", title.alias("shown"), T.source_year(*(F.col(c) for c in ("date", "url", "title", "file_name"))).alias("year"))


def text_outside_boxes(spark, d):
    boxes = _t(spark, d, "orders", _BOX).where("page % 3 > 0")
    return R.outside_boxes(_t(spark, d, "lineitem", _BLOCK), boxes).select("page", "line", "part", "x0", "y0")


def price_recall(spark, d):
    """Orders as documents of their customer's query: even customers ask for prices, and orders of status F are price rows."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("day"), ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0)).alias("priced"))
    lists = []
    for by in ("o_totalprice", "day"):
        s = o.withColumn("score", F.col(by))
        lists.append(S.prepended(S.ranked(s.where("priced"), 30).select("qid", "id", "rank"), S.ranked(s, 20).select("qid", "id", "rank")))
    given = F.when(F.col("qid") % 3 > 0, SPARSE).otherwise(0.5)
    profile = F.when(F.col("qid") % 2 == 0, PRICED).otherwise(SPARSE)
    sparse, dense = S.chosen_weight(given, SPARSE, profile), S.chosen_weight(F.lit(DENSE), DENSE, F.round(1 - profile, 2))
    return S.ranked(S.rrf([(lists[0], sparse), (lists[1], dense)]), 5)


def primary_fees(spark, d):
    li = _t(spark, d, "lineitem", [("order_id", "l_orderkey"), ("line", "l_linenumber"), ("part", "l_partkey"), ("fee", FEE), ("asked", ASKED)])
    return li.select("order_id", "line", "part", P.primary_fee(F.col("fee")).alias("is_primary"), P.asks_primary_fee(F.col("asked")).alias("asks"))


QUERIES = {f.__name__: f for f in (human_titles, text_outside_boxes, price_recall, primary_fees)}


def _cols(columns):
    return ", ".join(f"{e.replace('.0D', '.0::DOUBLE')} AS {n}" for n, e in columns)


def _title(x):
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), '')"


def _hashed(x):
    return f"(length({x}) >= 10 AND length(regexp_replace({x}, '[^0-9a-f]', '', 'g')) > 0.75 * length({x}))"


def _file(x):
    return rf"substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\.[^.]*$', ''), '_[a-f0-9]{{8,}}', '', 'g'), '[_-]', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 80)"


def _year(x):
    return rf"CAST(nullif(regexp_extract({x}, '(?:^|[^\p{{L}}\p{{N}}_])(19[5-9]\d|20[0-4]\d|2050)(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS INT)"


def _all(x, ts):
    return "(" + " AND ".join(f"contains({x}, '{t}')" for t in ts) + ")"


_FOLD = lambda x: f"translate(lower(coalesce({x}, '')), '{T.MARKED}', '{T.PLAIN}')"
_WORDS = lambda x: rf"list_filter(regexp_extract_all({_FOLD(x)}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)"
_SETS = " OR ".join(f"list_has_all(have, {[*s]!r})" for s in P.PRIMARY_SETS)
_ENGLISH = " OR ".join(_all("lower(coalesce(fee, ''))", s) for s in P.PRIMARY_ENGLISH)
_W = lambda *ws: f"list_has_any(asked_words, {[*ws]!r})"


def _list(by, out):
    """A query's price rows by one order, then all of its rows, with ranks."""
    order = f"ROW_NUMBER() OVER (PARTITION BY qid ORDER BY {by} DESC, id)::INT AS rank"
    return f"""{out}p AS (SELECT qid, id, {order} FROM o WHERE priced QUALIFY rank <= 30), {out}a AS (SELECT qid, id, {order} FROM o QUALIFY rank <= 20), {out}n AS (SELECT qid, max(rank) AS n FROM {out}p GROUP BY qid),
{out} AS (SELECT * FROM {out}p UNION ALL SELECT qid, id, rank + coalesce(n, 0) FROM {out}a LEFT JOIN {out}n USING (qid))"""


_PROFILE = f"(CASE WHEN qid % 2 = 0 THEN {PRICED}::DOUBLE ELSE {SPARSE}::DOUBLE END)"
ORACLE_SQL = {
    "human_titles": rf"""WITH p AS (SELECT {_cols(_PAGES)} FROM pages),
q AS (SELECT page_id, date, url, title AS t, file_name AS f, trim(coalesce(title, '')) AS title, trim(coalesce(file_name, '')) AS file_name, category, chunk_type, list_filter(string_split(regexp_extract(trim(url), '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '' AND x NOT IN {T.PLAIN_PARTS!r}) AS parts FROM p),
r AS (SELECT *, substr(array_to_string(list_transform(parts[greatest(len(parts) - 2, 1):], lambda x: {_title("trim(regexp_replace(x, '[-_]', ' ', 'g'))")}), ' — '), 1, 80) AS path, {_file('file_name')} AS plain FROM q)
SELECT page_id, CASE WHEN length(title) > 5 AND NOT {_hashed('title')} THEN {_file('title')} WHEN path <> '' THEN path WHEN file_name <> '' AND NOT {_hashed('file_name')} AND length(plain) > 3 THEN plain {' '.join(f"WHEN category = '{k}' THEN '{v}'" for k, v in T.CATEGORY_TITLES)}
WHEN chunk_type <> '' THEN 'Dokument — ' || {_title("replace(chunk_type, '_', ' ')")} ELSE 'Dokument' END AS shown, coalesce({_year('date')}, {_year('url')}, {_year('t')}, {_year('f')}) AS year FROM r""",
    "text_outside_boxes": f"WITH b AS (SELECT {_cols(_BLOCK)} FROM lineitem), t AS (SELECT {_cols(_BOX)} FROM orders WHERE o_orderkey % 3 > 0) SELECT page, line, part, x0, y0 FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 >= t.x0 - 5 AND b.y0 >= t.y0 - 5 AND b.x1 <= t.x1 + 5 AND b.y1 <= t.y1 + 5)",
    "price_recall": f"""WITH o AS (SELECT o_custkey AS qid, o_orderkey AS id, o_totalprice, o_orderdate, o_orderstatus = 'F' AND o_custkey % 2 = 0 AS priced FROM orders), {_list('o_totalprice', 's')}, {_list('o_orderdate', 'd')},
w AS (SELECT qid, id, (CASE WHEN qid % 3 > 0 THEN {_PROFILE} ELSE 0.5::DOUBLE END) / (60 + rank) AS p FROM s UNION ALL SELECT qid, id, round(1 - {_PROFILE}, 2) / (60 + rank) FROM d),
g AS (SELECT qid, id, round(sum(p), 6) AS score FROM w GROUP BY qid, id)
SELECT qid, id, score, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM g QUALIFY rank <= 5""",
    "primary_fees": f"""WITH t AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, {FEE} AS fee, {ASKED} AS asked FROM lineitem),
u AS (SELECT *, {_FOLD('fee')} AS folded, {_WORDS('fee')} AS have, {_WORDS('asked')} AS asked_words, lower(coalesce(asked, '')) AS low FROM t)
SELECT order_id, line, part, NOT ({' OR '.join(f"contains(folded, '{x}')" for x in P.NOT_PRIMARY)}) AND ({_SETS} OR {_ENGLISH}) AS is_primary,
{_W('vedeni')} OR ({_W('stoji')} AND {_W('ucet')}) OR ({_W('stoji', 'cena')} AND {_W('ekonto', 'konto')}) OR ({_W('mesicni')} AND {_W('poplatek')}) OR {_all('low', ('account', 'maintenance'))} OR {_all('low', ('monthly', 'fee'))} AS asks FROM u""",
}
