"""The query of dialogue states, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dialogue as D

# What users say, and what assistants leave open, by numbers of their turns, in SQL that both engines read.
SAYS = [
    "A kolik stojí?", "Jaké mají výhody?", "osobní", "firma prosím", "A co pojištění k tomu?", "Jaké je počasí?", "smart", "Chci vědět víc o hypotéky", "a jaké limity má k tomu", "Pro studenty",
    "Potřebuji osobní účet", "Nabídka kreditní karta a její poplatky", "Jaká je sazba?", "Zajímá mě spoření pro celou rodinu a na delší dobu",
]
ASKED = "CASE (conv_id * 7 + turn) % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'ekonto' END"
PRODUCTS = [("osobni_ucet", ("osobní účet", "osobni ucet")), ("kreditni_karta", ("kreditní karta", "kreditni karta")), ("hypoteky", ("hypotéky", "hypotek")), ("sporeni", ("spoření", "sporeni"))]
INTENTS = [("pricing", ("poplat", "kolik stojí", "cena")), ("rates", ("sazb",)), ("faq", ("otázk", "question"))]


def dialogue_states(spark, d):
    n = F.col("conv_id") * 5 + F.col("turn") * 3
    says = F.get(F.array(*map(F.lit, SAYS)), (n % (len(SAYS) + 2)).cast("int"))
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.when(F.col("role") == "user", F.coalesce(says, F.col("text"))).otherwise(F.col("text")))
    s = D.states(c.withColumn("asked", F.when(F.col("role") == "assistant", F.expr(ASKED))), PRODUCTS, INTENTS)
    return s.select("conv_id", "turn", F.col("resolved.target").alias("target"), F.col("resolved.label").alias("label"), F.col("resolved.query").alias("query"), "product", "intent", "follow_up", "inherited_product", "inherited_intent", "aspect", "rewritten")


QUERIES = {"dialogue_states": dialogue_states}


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _first(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_has(x, terms)} THEN '{n}'" for n, terms in rules) + " END"


def _answer(k: int) -> str:
    return "CASE " + " ".join(f"WHEN before = '{a[0]}' AND {_has('q', a[1])} THEN '{a[k]}'" for a in D.ANSWERS) + " END"


_ROWS = ", ".join(f"('{p}', '{a}', '{x}')" for p, by in D.QUESTIONS.items() for a, x in by.items())
ORACLE_SQL = {
    "dialogue_states": f"""WITH t0 AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN coalesce({SAYS!r}[(conv_id * 5 + turn * 3) % {len(SAYS) + 2} + 1], text) ELSE text END AS text, CASE WHEN role = 'assistant' THEN {ASKED} END AS asked FROM conversations),
t1 AS (SELECT *, lower(trim(coalesce(text, ''))) AS q, lag(asked) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t0),
t2 AS (SELECT *, CASE WHEN role = 'user' THEN {_answer(2)} END AS target, CASE WHEN role = 'user' THEN {_answer(3)} END AS label, CASE WHEN role = 'user' THEN {_answer(4)} END AS query,
  CASE WHEN role = 'user' THEN {_first('q', PRODUCTS)} END AS named, CASE WHEN role = 'user' THEN {_first('q', INTENTS)} END AS intent FROM t1),
t3 AS (SELECT *, coalesce(named, target) AS product FROM t2),
t4 AS (SELECT *, last_value(product IGNORE NULLS) OVER w AS bp, last_value(intent IGNORE NULLS) OVER w AS bi, coalesce(max((role = 'user')::INT) OVER w, 0) = 1 AS earlier FROM t3 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t5 AS (SELECT *, {_has('q', D.REFERENCES)} AND bp IS NOT NULL AS refers FROM t4 WHERE role = 'user'),
t6 AS (SELECT *, (len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '')) <= {D.SHORT} OR starts_with(q, 'a ') OR {_has('q', D.CUES)} OR contains(' ' || q, ' premium') OR refers) AND (NOT {_has('q', D.NEW_TOPICS)} OR refers) AND named IS NULL AND earlier AND (bp IS NOT NULL OR bi IS NOT NULL) AS follow_up,
  CASE WHEN refers THEN {_first('q', D.ASPECTS)} END AS aspect FROM t5),
m(p, a, rewritten) AS (VALUES {_ROWS})
SELECT conv_id, turn, target, label, query, product, intent, follow_up, CASE WHEN follow_up THEN bp END AS inherited_product, CASE WHEN follow_up THEN bi END AS inherited_intent, aspect, rewritten FROM t6 LEFT JOIN m ON m.p = bp AND m.a = aspect""",
}
