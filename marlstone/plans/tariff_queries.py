"""Queries of tariff rows and tables, made of lineitem, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import pricing as P
from marlstone.functions import tables as B
from marlstone.functions import text as T
from marlstone.functions import quality as Q
from marlstone.operators import price_filter as X
from marlstone.operators import tariffs as O
from marlstone.plans import text_queries
from marlstone.streaming.folders import new_folder

# Texts of tariff rows by numbers of lineitem, in SQL that both engines read.
_Q = "CAST(CAST(l_quantity AS INT) AS STRING)"
PRODUCT = "CASE l_partkey % 6 WHEN 0 THEN 'eKonto Smart' WHEN 1 THEN 'Aktivní účet vedení účtu' WHEN 2 THEN concat('Karta ', CAST(l_partkey % 20 AS STRING)) WHEN 3 THEN 'cena' WHEN 4 THEN 'Tarif Plus měsíčně' ELSE '' END"
FEE = "CASE l_suppkey % 7 WHEN 0 THEN '1. Vedení účtu' WHEN 1 THEN 'Výběr z bankomatu 2)' WHEN 2 THEN 'Zrušení vedení účtu' WHEN 3 THEN 'Příchozí platba' WHEN 4 THEN 'SMS notifikace' WHEN 5 THEN '2.1 Kreditní obrat' ELSE 'Poplatek' END"
VALUE = f"CASE (l_linenumber + l_partkey) % 10 WHEN 0 THEN 'zdarma' WHEN 1 THEN concat({_Q}, ' Kč měsíčně') WHEN 2 THEN '1 200,50 Kč ročně' WHEN 3 THEN concat({_Q}, ' EUR') WHEN 4 THEN '0,5 %' WHEN 5 THEN 'při aktivním využívání zdarma, jinak 99 Kč měsíčně' WHEN 6 THEN 'v ceně' WHEN 7 THEN 'viz pobočka' WHEN 8 THEN concat({_Q}, '.000 CZK') ELSE '0 Kč, dříve 20 000 Kč' END"
PERIOD = "CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'měsíčně' ELSE 'za rok' END"
CONDITIONS = "CASE l_suppkey % 5 WHEN 0 THEN 'Při obratu 15 000 Kč' WHEN 1 THEN '' WHEN 2 THEN 'minimální příjem 20 000 Kč' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'jen pro aktivní' END"
_ROWS = [("order_id", "l_orderkey"), ("line", "l_linenumber"), ("product", PRODUCT), ("fee", FEE), ("value", VALUE), ("period", PERIOD), ("conditions", CONDITIONS)]
#: A table of three columns for every 40 orders; each 5th line names a product only.
_LINE = f"concat('| ', CASE WHEN l_linenumber = 5 THEN concat('Účet ', CAST(l_partkey % 9 AS STRING)) ELSE {FEE} END, ' | ', CASE WHEN l_linenumber = 5 THEN '' ELSE {VALUE} END, ' | ', CASE WHEN l_linenumber = 5 THEN '' WHEN l_linenumber = 6 THEN 'x' ELSE {PERIOD} END, CASE WHEN l_linenumber = 7 THEN '' ELSE ' |' END)"
HEAD, RULE = "| Název položky | Aktivní účet | Poznámka |", "| --- | :-: | --- |"


def _rows(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*(f"{e} AS {n}" for n, e in _ROWS))


def _tables(spark, d) -> DataFrame:
    """(table_id, markdown); equal lines count once."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("CAST(floor(l_orderkey / 40) AS BIGINT) AS table_id", f"concat(lpad(CAST(l_orderkey % 40 AS STRING), 2, '0'), CAST(l_linenumber AS STRING), {_LINE}) AS line")
    lines = F.transform(F.array_sort(F.collect_set("line")), lambda s: F.substring(s, 4, 1 << 30))
    return li.groupBy("table_id").agg(F.concat(F.lit(f"Sazebník\n{HEAD}\n{RULE}\n"), F.array_join(lines, "\n")).alias("markdown"))


def price_normalize(spark, d):
    p = P.normalized_price(F.col("value"), F.col("period"))
    return _rows(spark, d).select("order_id", "line", p.alias("p")).select("order_id", "line", "p.price", "p.currency", "p.billing_period", "p.label", "p.raw")


def price_conditional(spark, d):
    c = [F.col(x) for x in ("product", "fee", "value", "period", "conditions")]
    df = _rows(spark, d).select("order_id", "line", *c, P.conditional_price(*c, F.lit("Ceník")).alias("p"))
    text = P.conditional_fee_text(F.col("product"), F.col("p"), F.col("period"))
    return df.select("order_id", "line", "p.base_price", "p.conditional_price", "p.currency", "p.billing_period", "p.condition_type", "p.condition_text", text.alias("answer"), P.fee_abolished(c[0], c[1], c[2], c[4]).alias("abolished"))


def price_texts(spark, d):
    c = {x: F.col(x) for x in ("product", "fee", "value", "period", "conditions")}
    line = F.concat_ws(" ", *c.values())
    return _rows(spark, d).select("order_id", "line", P.fee_label(c["fee"]).alias("label"), P.value_with_period(c["value"], c["period"]).alias("shown"), P.product_name(c["product"]).alias("product"), P.fee_value(line).alias("fee_value"), P.blacklisted(c["fee"], c["product"], c["conditions"]).alias("blacklisted"))


# Price rows to be checked, by numbers of lineitem: values, headers and texts that each rule rejects are among them.
CHECKED = [
    ("order_id", "l_orderkey"), ("line", "l_linenumber"), ("part", "l_partkey"), ("product_name", "CASE l_partkey % 11 WHEN 0 THEN 'Sloupec 3' WHEN 1 THEN 'vedení účtu' WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN 'a b c d e f g h' ELSE concat('Aktivní účet ', CAST(l_partkey % 7 AS STRING)) END"),
    ("fee_type", "CASE l_suppkey % 9 WHEN 0 THEN 'Poplatek' WHEN 1 THEN ' Vedení účtu ' WHEN 2 THEN 'ok' WHEN 3 THEN 'Výběr 25 Kč z bankomatu' WHEN 4 THEN 'PPoojjiiššttěěnníí kkaarrttyy' WHEN 5 THEN 'Příchozí platba' ELSE 'Expresní platba v eurech' END"),
    ("fee_value", VALUE), ("currency", "CASE l_linenumber % 4 WHEN 0 THEN 'CZK' WHEN 1 THEN CAST(NULL AS STRING) ELSE '' END"), ("period", PERIOD), ("conditions", CONDITIONS), ("confidence", "CASE l_partkey % 13 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END"),
]


def _checked(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*(f"{e} AS {n}" for n, e in CHECKED))


def price_rows(spark, d):
    return X.with_reason(_checked(spark, d)).select("order_id", "line", "part", "fee_value", "amount", "currency", "period", "reason")


GROUP_TEXT = "CASE l_partkey % 12 WHEN 0 THEN 'Osobní eKonto' WHEN 1 THEN 'eKonto pro podnikatele' WHEN 2 THEN 'eKonto' WHEN 3 THEN 'Kreditní karta a úvěr' WHEN 4 THEN 'Firemní účet' WHEN 5 THEN 'Hypotéka' WHEN 6 THEN 'Základní platební účet' WHEN 7 THEN 'Spořicí účet a fondy' WHEN 8 THEN CAST(NULL AS STRING) WHEN 9 THEN 'Debetní karta' WHEN 10 THEN 'Běžný účet' ELSE 'Podnikatelské eKonto' END"
GROUP_CATEGORY = "CASE l_suppkey % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'corporate' WHEN 2 THEN 'business' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'cards' END"


def product_groups(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS order_id", "l_linenumber AS line", "l_partkey AS part", f"{GROUP_TEXT} AS text", f"{GROUP_CATEGORY} AS category")
    return li.select("order_id", "line", "part", F.array_join(P.product_groups(F.col("text"), F.col("category")), ",").alias("groups"))


def price_row_counters(spark, d):
    return X.with_reason(_checked(spark, d)).agg(*X.counters(F.col("reason")))


def price_row_audit(spark, d):
    """The rejected rows' file, read again; the counters were observed while writing."""
    folder = new_folder(spark, "price-rows")
    X.write_filtered(_checked(spark, d), folder)
    return spark.read.schema("reason string, fee_type string, product_name string").json(f"{folder}/rejected").groupBy("reason", "fee_type", "product_name").count()


def tariff_table_rows(spark, d):
    h, c = F.col("headers"), F.col("cells")

    def made(df: DataFrame) -> DataFrame:
        df = df.where(B.is_pricing_text(F.concat_ws(" ", F.array_join(c, " "), F.array_join(h, " "))))
        df = df.select("head", "line", "cells", B.row_fields(h, c).alias("f"), B.row_text(F.lit("Sazebník"), F.lit("Ceny"), F.lit("https://example.org/cenik"), h, c).alias("text"))
        return df.select("head", "line", F.array_join(c, "/").alias("cells"), "f.product_name", "f.fee_type", "f.fee_value", F.md5("text").alias("text_md5"), B.bad_table_row(F.col("text")).alias("bad_row"))

    return O.repeated_cells(_tables(spark, d), "markdown", made)


def tariff_price_rows(spark, d):
    return O.price_rows(O.repeated_cells(_tables(spark, d), "markdown"))


def tables_to_markdown(spark, d):
    """Tables of cells with merged cells, footnotes, page feet and empty rows, by order."""
    row = f"CASE l_linenumber WHEN 1 THEN array({FEE}, {VALUE}, {PERIOD}) WHEN 2 THEN array({VALUE}, CAST(NULL AS STRING), CAST(NULL AS STRING)) WHEN 3 THEN array(concat('1) ', {FEE}), '', '') WHEN 4 THEN array('www.example.org', '3', '') WHEN 5 THEN array('', CAST(NULL AS STRING), ' ') WHEN 6 THEN array('Oddíl', 'Oddíl', 'Oddíl') ELSE array({FEE}, {VALUE}, CAST(NULL AS STRING)) END"
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS order_id", f"struct(l_linenumber AS n, array_join(array({FEE}, {VALUE}), '') AS k, {row} AS r) AS x")
    t = li.groupBy("order_id").agg(F.array_sort(F.collect_set("x")).alias("x"))
    cells = F.concat(F.expr("array(array('Položka', 'Cena', 'Četnost'))"), F.col("x.r"))
    return t.select("order_id", B.table_markdown(cells).alias("markdown"))


QUERIES = {f.__name__: f for f in (price_normalize, price_rows, product_groups, price_row_counters, price_row_audit, price_conditional, price_texts, tariff_table_rows, tariff_price_rows, tables_to_markdown)}


def _fold(x):
    return f"translate(lower({x}), '{T.MARKED}', '{T.PLAIN}')"


def _any(x, terms):
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _num(x):
    n = f"regexp_extract({x}, '({P.NUMBER})', 1)"
    return f"CASE WHEN {n} <> '' THEN TRY_CAST(replace(regexp_replace({n}, '[ .]', '', 'g'), ',', '.') AS DOUBLE) END"


def _free(x):
    return f"regexp_matches({_fold(x)}, '{P.FREE}')"


def _price(x):
    return f"CASE WHEN {_free(x)} THEN 0.0::DOUBLE ELSE {_num(x)} END"


def _per(x, p):
    t = f"({_fold(x)} || ' ' || {_fold(p)})"
    return f"CASE WHEN {_any(t, P.MONTHLY)} THEN 'monthly' WHEN {_any(t, P.YEARLY)} THEN 'yearly' ELSE 'monthly' END"


def _value(x):
    return f"trim(regexp_extract({x}, '{O.VALUE.replace('(?iu)', '(?i)')}', 1))"


def _re(p):
    return p.replace("(?iu)", "(?i)")


_SRC = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ROWS) + " FROM lineitem)"
_ALL = "(product || ' ' || fee || ' ' || value || ' ' || period || ' ' || coalesce(conditions, '') || ' Ceník')"
_KIND = "CASE " + " ".join(f"WHEN {_any(_fold('txt'), terms)} THEN '{n}'" for n, terms in P.CONDITIONS) + " ELSE 'condition_met' END"


def _money(x):
    return f"(CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE {x}::VARCHAR END || ' Kč')"


_NOTE = f"CASE WHEN trim(coalesce(conditions, '')) <> '' THEN trim(conditions) WHEN contains({_fold('txt')}, 'aktiv') THEN '{P.ACTIVE_TEXT}' END"
_SUM = "coalesce(condition_text, CASE " + " ".join(f"WHEN condition_type = '{k}' THEN '{s}'" for k, s in P.SUMMARIES) + " ELSE 'při splnění podmínek' END)"
_CUT = "coalesce(" + ", ".join(f"CASE WHEN ends_with(lower(trim(product)), '{s}') THEN trim(substr(trim(product), 1, length(trim(product)) - {len(s)})) END" for s in P.SUFFIXES) + ")"
_FEEVAL = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(l, '(?i){p}', 1)), '')" for p in P.VALUE_PATTERNS) + ", '')"
_WORDS = r"list_filter(regexp_split_to_array({x}, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')"
_ONE = r"len(list_filter({w}, lambda t: length(regexp_replace(t, '^[.,;:()\[\]{{}}|]+|[.,;:()\[\]{{}}|]+$', '', 'g')) = 1))"
_CELLS = r"list_transform(string_split(regexp_replace({s}, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c))"
_TABLES = rf"""tb AS (SELECT table_id, 'Sazebník' || chr(10) || '{HEAD}' || chr(10) || '{RULE}' || chr(10) || string_agg(substr(line, 4), chr(10) ORDER BY line) AS markdown
  FROM (SELECT DISTINCT CAST(floor(l_orderkey / 40) AS BIGINT) AS table_id, concat(lpad(CAST(l_orderkey % 40 AS STRING), 2, '0'), CAST(l_linenumber AS STRING), {_LINE}) AS line FROM lineitem) GROUP BY table_id),
tl AS (SELECT table_id, list_filter(list_transform(string_split(markdown, chr(10)), lambda s: trim(s)), lambda s: contains(s, '|')) AS lines FROM tb),
th AS (SELECT table_id, {_CELLS.format(s='lines[1]')} AS headers, list_filter(lines[3:], lambda s: NOT regexp_full_match(s, '[:\-\s|]+')) AS body FROM tl WHERE len(lines) >= 3),
pr AS (SELECT table_id, headers, unnest(range(0, len(body)))::INT AS row_index, unnest(list_transform(body, lambda s: list_concat({_CELLS.format(s='s')}, list_transform(headers, lambda h: ''))[1:len(headers)])) AS cells FROM th)"""
_PAIRS = "list_filter(list_transform(range(1, len(headers) + 1), lambda i: {'h': trim(headers[i]), 'c': trim(cells[i])}), lambda p: p.h <> '' OR p.c <> '')"
_GEN = lambda c: f"({c} = '' OR regexp_matches(trim({c}), '{_re(O.GENERIC)}') OR starts_with(lower({c}), 'sloupec '))"
_NUMERIC = r"CASE WHEN regexp_matches({v}, '(?i)zdarma|v ceně') THEN 0.0::DOUBLE ELSE TRY_CAST(replace(regexp_replace(regexp_extract({v}, '([0-9][\d\s]*(?:[,.]\d+)?)', 1), '\s', '', 'g'), ',', '.') AS DOUBLE) END"
_NOLABEL = lambda c: f"regexp_matches({c}, '{_re(O.NOT_A_LABEL)}')"
_HEADC = "trim(list_filter(cells, lambda c: trim(c) <> '')[1])"
_HASVAL = f"len(list_filter(cells, lambda c: regexp_matches(c, '{_re(O.VALUE)}'))) > 0"
_LABEL_BAD = "(len(w) >= 20 AND (sc / greatest(len(w), 1) > 0.33 OR " + " OR ".join(f"regexp_matches(substr(txt, 1, 2500), '{p}')" for p in B.SPACED) + "))"

ORACLE_SQL = {
    "price_normalize": f"WITH {_SRC} SELECT order_id, line, {_price('trim(value)')} AS price, CASE WHEN {_free('trim(value)')} THEN 'CZK' WHEN contains({_fold('value')}, 'eur') OR contains(value, '€') THEN 'EUR' WHEN {_any(_fold('value'), ('kc', 'czk'))} OR {_num('trim(value)')} = 0 THEN 'CZK' END AS currency, {_per('value', 'period')} AS billing_period, CASE WHEN {_free('value')} THEN 'free' WHEN {_num('value')} IS NOT NULL THEN 'amount' ELSE 'unknown' END AS label, trim(value) AS raw FROM t",
    "price_conditional": rf"""WITH {_SRC}, u AS (SELECT *, {_ALL} AS txt FROM t),
v AS (SELECT *, {_any(_fold('txt'), P.SIGNALS)} AS hit, list_filter(list_transform(regexp_extract_all(txt, '(?i){P.NUMBER}\s*(?:Kč|CZK|kc)?'), lambda a: {_price('a')}), lambda n: n IS NOT NULL) AS nums FROM u),
x AS (SELECT *, CASE WHEN contains({_fold('txt')}, 'zdarma') THEN 0.0::DOUBLE ELSE nums[1] END AS low FROM v),
y AS (SELECT *, list_filter(nums, lambda n: low IS NULL OR n <> low)[-1] AS base FROM x),
z AS (SELECT order_id, line, product, fee, value, period, conditions, hit, CASE WHEN hit THEN base END AS base_price, CASE WHEN hit THEN low END AS conditional_price, CASE WHEN hit AND (base IS NOT NULL OR low IS NOT NULL) THEN 'CZK' END AS currency, CASE WHEN hit THEN {_per('txt', 'period')} END AS billing_period, CASE WHEN hit THEN {_KIND} END AS condition_type, CASE WHEN hit THEN {_NOTE} END AS condition_text FROM y),
a AS (SELECT *, {_SUM} AS cond, CASE WHEN product = '' THEN 'Produkt' ELSE product END AS name, CASE WHEN period = '' THEN billing_period ELSE period END AS per FROM z)
SELECT order_id, line, base_price, conditional_price, currency, billing_period, condition_type, condition_text,
CASE WHEN NOT hit THEN NULL WHEN base_price IS NOT NULL AND conditional_price = 0 THEN name || ' je zdarma ' || cond || '.' || chr(10) || 'Pokud podmínka splněna není, poplatek činí ' || {_money('base_price')} || ' ' || per || '.'
WHEN base_price IS NOT NULL AND conditional_price IS NOT NULL THEN name || ' má podmíněnou cenu ' || {_money('conditional_price')} || ' ' || per || ' ' || cond || '.' || chr(10) || 'Bez splnění podmínky činí poplatek ' || {_money('base_price')} || ' ' || per || '.'
WHEN base_price IS NOT NULL THEN name || ': základní poplatek ' || {_money('base_price')} || ' ' || per || '; podmínka: ' || cond || '.' ELSE name || ': cena je podmíněná; podmínka: ' || cond || '.' END AS answer,
contains({_fold("product || ' ' || fee || ' ' || value || ' ' || coalesce(conditions, '')")}, 'vedeni') AND contains({_fold("product || ' ' || fee || ' ' || value || ' ' || coalesce(conditions, '')")}, 'uct') AND ({_any(_fold('value'), P.FREE_VALUES)} OR {_any(_fold("product || ' ' || fee || ' ' || value || ' ' || coalesce(conditions, '')"), P.ABOLISHED)}) AS abolished FROM a""",
    "price_texts": rf"WITH {_SRC}, u AS (SELECT *, trim(regexp_replace(trim(regexp_replace(fee, '^\s*\d+(?:\.\d+)*\.?\s*', '')), '\s+\d+\)\s*$', '')) AS f, concat_ws(' ', product, fee, value, period, conditions) AS l FROM t) SELECT order_id, line, CASE WHEN f = '' THEN 'poplatek' ELSE lower(substr(f, 1, 1)) || substr(f, 2) END AS label, CASE WHEN period = '' OR contains(lower(value), lower(period)) THEN value ELSE value || ' ' || period END AS shown, CASE WHEN lower(trim(product)) IN ({', '.join(repr(x) for x in P.PRESERVED)}) THEN trim(product) ELSE coalesce(nullif({_CUT}, ''), trim(product)) END AS product, {_FEEVAL} AS fee_value, {_any('lower(' + chr(102) + 'ee || ' + repr(' ') + ' || product || ' + repr(' ') + ' || coalesce(conditions, ' + repr('') + '))', P.BLACKLIST)} AS blacklisted FROM u",
    "tariff_table_rows": rf"""WITH {_TABLES}, p AS (SELECT *, {_PAIRS} AS pairs FROM pr WHERE {_any("lower(array_to_string(cells, ' ') || ' ' || array_to_string(headers, ' '))", B.TABLE_TERMS)}),
q AS (SELECT *, 'Table: Sazebník' || chr(10) || 'Sekce: Ceny' || chr(10) || 'Zdroj: https://example.org/cenik' || chr(10) || chr(10) || array_to_string(list_transform(pairs, lambda p: CASE WHEN p.h = '' THEN 'Sloupec' ELSE p.h END || ': ' || p.c), chr(10)) || CASE WHEN contains(lower(array_to_string(cells, ' ')), 'ekonto') THEN chr(10) || '{B.ALIASES}' ELSE '' END AS txt FROM p),
r AS (SELECT *, {_WORDS.format(x='substr(txt, 1, 2500)')} AS w, {_WORDS.format(x='substr(txt, 1, 1200)')} AS w2 FROM q), s AS (SELECT *, {_ONE.format(w='w')}::DOUBLE AS sc, {_ONE.format(w='w2')}::DOUBLE AS sc2 FROM r)
SELECT table_id, row_index, array_to_string(cells, '/') AS cells, coalesce(nullif(list_filter(pairs, lambda p: {_any('lower(p.h)', B.PRODUCT_HEADS)} AND p.c <> '')[1].c, ''), trim(cells[1]), '') AS product_name, coalesce(list_filter(pairs, lambda p: {_any('lower(p.h)', B.FEE_HEADS)})[1].h, list_filter(pairs, lambda p: {_any('lower(p.c)', ('kč', 'zdarma'))})[1].h, '') AS fee_type, coalesce(list_filter(pairs, lambda p: regexp_matches(lower(p.c), 'kč|zdarma|\b\d+[,.]?\d*\s*(?:czk|%)'))[1].c, '') AS fee_value, md5(txt) AS text_md5, {_LABEL_BAD} OR (len(w2) >= 6 AND sc2 / greatest(len(w2), 1) > 0.28) AS bad_row FROM s""",
    "tariff_price_rows": rf"""WITH {_TABLES}, n AS (SELECT *, coalesce(NOT ({_HASVAL}) AND length({_HEADC}) >= 4 AND NOT {_NOLABEL(_HEADC)} AND NOT regexp_matches({_HEADC}, '{_re(O.GENERIC)}') AND {_any(f'lower({_HEADC})', O.PRODUCT_WORDS)}, false) AS names FROM pr),
m AS (SELECT *, last_value(CASE WHEN names THEN {_HEADC} END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS parent, array_to_string(cells, ' ') AS txt FROM n),
k AS (SELECT *, {_WORDS.format(x='txt')} AS w FROM m WHERE NOT names AND {_HASVAL} AND NOT regexp_matches(txt, '{O.SPACING}')),
e AS (SELECT *, unnest(range(0, len(cells)))::INT AS "column" FROM k WHERE len(w) > 0 AND {_ONE.format(w='w')}::DOUBLE / len(w) <= 0.28),
f AS (SELECT *, cells["column" + 1] AS cell, coalesce(headers["column" + 1], '') AS header, {_value('cells["column" + 1]')} AS fee_value FROM e),
g AS (SELECT *, CASE WHEN "column" > 0 AND lower(header) NOT IN ('cena', 'poplatek', 'hodnota') THEN header ELSE cells[1] END AS prod, CASE WHEN "column" > 0 THEN cells[1] ELSE header END AS fee_type FROM f WHERE fee_value <> ''),
h AS (SELECT *, CASE WHEN parent IS NOT NULL AND {_GEN('prod')} THEN parent WHEN parent IS NOT NULL AND "column" > 0 AND NOT starts_with(lower(prod), lower(parent)) THEN parent || ' – ' || prod ELSE prod END AS product_name, CASE WHEN regexp_matches(fee_value, '(?i)kč|czk|zdarma|v ceně') THEN 'CZK' ELSE '' END AS currency, regexp_extract(cell || ' ' || fee_type || ' ' || array_to_string(headers, ' ') || ' ' || txt, '{_re(O.PERIOD)}', 1) AS period, array_to_string(list_filter(list_transform(cells, lambda c, j: CASE WHEN j > 1 AND j <> "column" + 1 AND c <> '' AND NOT regexp_matches(c, '{_re(O.VALUE)}') THEN c END), lambda c: c IS NOT NULL), '; ') AS conditions, {_NUMERIC.format(v='fee_value')} AS num FROM g),
i AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN product_name <> '' AND NOT {_NOLABEL('product_name')} THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN fee_type <> '' AND NOT {_NOLABEL('fee_type')} THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN num IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN currency <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN period <> '' OR {_any('lower(fee_type)', O.PERIODIC)} THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN num > 10000 AND regexp_matches(fee_type, '{_re(O.THRESHOLD)}') THEN 0.40::DOUBLE ELSE 0 END)), 3) AS confidence FROM h)
SELECT table_id, row_index, "column", product_name, fee_type, fee_value, currency, period, conditions, confidence FROM i WHERE confidence >= 0.70 AND NOT {_GEN('product_name')} AND NOT {_NOLABEL('product_name')} AND NOT {_NOLABEL('fee_type')} AND fee_type <> '' AND NOT (num > 10000 AND regexp_matches(fee_type, '{_re(O.THRESHOLD)}'))""",
    "tables_to_markdown": rf"""WITH x AS (SELECT DISTINCT l_orderkey AS order_id, l_linenumber AS n, {FEE} AS fee, {VALUE} AS val, {PERIOD} AS per FROM lineitem),
y AS (SELECT order_id, n, fee || val AS k, per, CASE n WHEN 1 THEN [fee, val, per] WHEN 2 THEN [val, val, val] WHEN 3 THEN ['1) ' || fee, '', ''] WHEN 6 THEN ['Oddíl', 'Oddíl', 'Oddíl'] ELSE [fee, val, NULL] END AS r FROM x WHERE n NOT IN (4, 5)),
z AS (SELECT DISTINCT order_id, n, k, r FROM y),
s AS (SELECT order_id, string_agg(CASE WHEN n IN (2, 6) THEN r[1] ELSE array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ') END, chr(10) ORDER BY n, k) FILTER (n <> 3) AS shown, string_agg(r[1], chr(10) ORDER BY n, k) FILTER (n = 3) AS notes FROM z GROUP BY order_id),
o AS (SELECT DISTINCT l_orderkey AS order_id FROM lineitem)
SELECT order_id, 'Položka | Cena | Četnost' || chr(10) || '--- | --- | ---' || coalesce(chr(10) || shown, '') || coalesce(chr(10) || chr(10) || notes, '') AS markdown FROM o LEFT JOIN s USING (order_id)""",
}

_RULES = {k: text_queries._rules(k) for k in ("fee", "product", "every")}
_SHARE = f"len(list_filter(list_distinct(regexp_extract_all(lower(fee || ' ' || product), '[\\p{{L}}\\p{{N}}_]+')), lambda w: list_contains({[*Q.VOCABULARY]}, w)))::DOUBLE / greatest(len(list_distinct(regexp_extract_all(lower(fee || ' ' || product), '[\\p{{L}}\\p{{N}}_]+'))), 1)"
_p = lambda p: p.replace("(?iu)", "(?i)")
_ANY = "(" + " OR ".join(f"contains(lower(line_text), '{t}')" for t in X.MONTHLY) + ")"
_REASONS = f"""x0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CHECKED)} FROM lineitem),
x1 AS (SELECT *, trim(coalesce(fee_type, '')) AS fee, trim(coalesce(product_name, '')) AS product, trim(coalesce(fee_value, '')) AS value, coalesce(fee_value, '') || ' ' || coalesce(fee_type, '') || ' ' || coalesce(conditions, '') AS line_text FROM x0),
x2 AS (SELECT * EXCLUDE (currency, period), fee || ' ' || product || ' ' || value AS every,
  CASE WHEN regexp_matches(value, '{_p(X.INCLUDED)}') THEN '0' ELSE replace(regexp_extract(value, '{X.NUMBER}', 1), ' ', '') END AS amount,
  coalesce(nullif(trim(coalesce(currency, '')), ''), CASE WHEN regexp_matches(value, '{_p(X.CROWNS)}') THEN 'CZK' WHEN regexp_matches(value, '{_p(X.EUROS)}') THEN 'EUR' ELSE '' END) AS currency,
  CASE WHEN trim(coalesce(period, '')) <> '' THEN trim(period) WHEN regexp_matches(line_text, '{_p(X.PERIOD)}') THEN regexp_extract(line_text, '({_p(X.PERIOD)})', 1) WHEN {_ANY} THEN 'měsíčně' ELSE '' END AS period FROM x1),
x AS (SELECT *, CASE WHEN regexp_matches(lower(fee), '{_p(X.HEADER)}') OR regexp_matches(lower(product), '{_p(X.COLUMN_ONLY)}') THEN 'header_artifact'
  WHEN length(fee) < 3 OR length(product) < 3 OR coalesce(fee_value, '') = '' THEN 'missing_fields'
  WHEN regexp_matches(fee, '{_p(X.PRICE)}') OR length(fee) > 100 OR regexp_matches(product, '{_p(X.COLUMN)}') THEN 'merged_column'
  WHEN {_RULES['every']['marks']} THEN 'broken_unicode' WHEN {_RULES['fee']['garbage']} OR (length(product) > 12 AND {_RULES['product']['garbage']}) OR {_RULES['every']['garbage']} THEN 'garbage_text'
  WHEN NOT regexp_matches(value, '{_p(X.PRICE)}') AND {_SHARE} < 0.05 THEN 'missing_pricing_value' WHEN coalesce(confidence, 0) < 0.70 THEN 'low_confidence'
  WHEN product = '' OR regexp_matches(product, '{_p(X.GENERIC)}') OR lower(product) = lower(fee) OR starts_with(lower(product), 'sloupec ') THEN 'orphan_product_context'
  WHEN amount = '' THEN 'missing_amount' WHEN lower(value) NOT IN {X.FREE!r} AND currency = '' THEN 'missing_currency' WHEN lower(value) NOT IN {X.FREE!r} AND period = '' THEN 'missing_period' END AS reason FROM x2)"""
ORACLE_SQL |= {
    "price_rows": f"WITH {_REASONS} SELECT order_id, line, part, fee_value, amount, currency, period, reason FROM x",
    "price_row_counters": f"WITH {_REASONS} SELECT count(*) AS total_input, count(*) FILTER (reason IS NULL) AS valid_output, {', '.join(f'count(*) FILTER (reason IN {rs!r}) AS filtered_{n}' if len(rs) > 1 else f'count(*) FILTER (reason = {rs[0]!r}) AS filtered_{n}' for n, rs in X.COUNTERS.items())}, count(*) FILTER (reason NOT IN {tuple(r for rs in X.COUNTERS.values() for r in rs)!r}) AS filtered_other FROM x",
}

_in = lambda terms: "(" + " OR ".join(f"contains(low, '{t}')" for t in terms) + ")"
_OWN = {n: _in(terms) for n, terms in P.GROUPS.items()} | {
    "podnikatelsky_ucet": f"({_in(P.GROUPS['podnikatelsky_ucet'])} OR business)", "ekonto_podnikatelske": f"(business OR (NOT ekonto AND {_in(P.GROUPS['ekonto_podnikatelske'])}))", "ekonto_osobni": "personal",
    "osobni_ucet": f"({_in(P.GROUPS['osobni_ucet'])} OR personal OR (cat = 'retail' AND NOT {_in(P.GROUPS['podnikatelsky_ucet'])} AND NOT business AND NOT {_in(P.GROUPS['firemni_ucet'])}))",
    "firemni_ucet": f"({_in(P.GROUPS['firemni_ucet'])} OR cat IN ('corporate', 'business'))",
}
ORACLE_SQL["product_groups"] = f"""WITH g0 AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, translate(lower(coalesce({GROUP_TEXT}, '')), '{T.MARKED}', '{T.PLAIN}') AS low, coalesce({GROUP_CATEGORY}, '') AS cat FROM lineitem),
g1 AS (SELECT *, {_in(P.EKONTO)} AS ekonto, {_in(P.EKONTO)} AND {_in(P.BUSINESS)} AS business FROM g0), g2 AS (SELECT *, ekonto AND NOT business AND ({_in(P.PERSONAL)} OR cat = 'retail') AS personal FROM g1)
SELECT order_id, line, part, array_to_string(list_filter([{', '.join(f"CASE WHEN {_OWN[n]} THEN '{n}' END" for n in sorted(_OWN))}], lambda x: x IS NOT NULL), ',') AS groups FROM g2"""
