"""What a user's turn means by the turns before it: answers to a pending question, what it inherits, and what it stands for.

A conversation's turns are in one window, by turn; state is carried by lag and by the last value that isn't null, so a
conversation needs no fold. Rules are fixed tables; the questions of products by aspects are a small table that is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.pricing import has_any

# By the kind of the pending question, words of an answer, what it means, its label and the question it stands for.
ANSWERS = [
    ("ekonto", ("osob", "soukrom", "retail"), "ekonto_osobni", "osobní eKonto", "Kolik stojí vedení osobního eKonta?"),
    ("ekonto", ("podnik", "osvč", "osvc", "firma", "firem"), "ekonto_podnikatelske", "podnikatelské eKonto", "Kolik stojí vedení podnikatelského eKonta?"),
    ("ekonto", ("smart", "chytry"), "ekonto_osobni", "eKonto SMART", "Kolik stojí vedení eKonto SMART?"),
    ("ekonto", ("komplet",), "ekonto_osobni", "eKonto KOMPLET", "Kolik stojí vedení eKonto KOMPLET?"),
    ("ekonto", ("premium", "vyhody"), "ekonto_osobni", "eKonto Výhody Prémium", "Kolik stojí vedení eKonto Výhody Prémium?"),
    ("ekonto", ("student",), "ekonto_osobni", "eKonto STUDENT", "Kolik stojí vedení eKonto STUDENT?"),
    ("account", ("osob", "soukrom", "retail"), "osobni_ucet", "osobní účet", "Jaký je poplatek za vedení osobního účtu?"),
    ("account", ("podnik", "osvč", "osvc", "firma", "firem"), "podnikatelsky_ucet", "podnikatelský účet", "Jaký je poplatek za vedení podnikatelského účtu?"),
    ("account", ("student",), "osobni_ucet", "studentský účet", "Jaký je poplatek za vedení studentského účtu?"),
]
SHORT = 4
CUES = ("kolik stojí", "kolik stoji", "ta premium", "ten premium", "aktivní", "aktivni", "nejdražší", "nejdrazsi", "sazba", "úrok", "urok")
NEW_TOPICS = ("počasí", "pocasi", "bitcoin", "akcie", "pojištění", "pojisteni", "hypotéka", "hypoteka", "hypotek", "hypotéky", "účet", "ucet", "karta", "karty", "investice")
REFERENCES = (
    "k nim", "k tomu", "k němu", "k nemu", "k ni", "k ní", "a co", "a jaké", "a jake", "a jaký", "a jaky", "a kolik", "a mají", "a maji", "a má", "a ma", "je k nim", "je k tomu", "mají k tomu",
    "maji k tomu", "mají k nim", "maji k nim",
)
ASPECTS = [
    ("insurance", ("pojist", "pojišt")), ("pricing", ("poplat", "kolik stojí", "kolik stoji", "a kolik")), ("conditions", ("podmink", "podmínk")), ("benefits", ("vyhod", "výhod", "maji vyhody", "mají výhody")),
    ("limits", ("limit",)), ("rates", ("sazb", "urok", "úrok")),
]
QUESTIONS = {
    "osobni_ucet": {
        "insurance": "Jaké pojištění nebo doplňkové služby jsou k osobním účtům?", "pricing": "Jaké jsou poplatky k osobním účtům?", "conditions": "Jaké jsou podmínky osobních účtů?", "benefits": "Jaké výhody mají osobní účty?",
    },
    "kreditni_karta": {
        "insurance": "Jaké pojištění nebo doplňkové služby jsou ke kreditním kartám?", "pricing": "Jaké jsou poplatky ke kreditním kartám?", "limits": "Jaké limity mají kreditní karty?", "benefits": "Jaké výhody mají kreditní karty?",
    },
    "hypoteky": {"conditions": "Jaké jsou podmínky hypotéky?", "rates": "Jaká je sazba hypotéky?", "insurance": "Jaké pojištění lze sjednat k hypotéce?", "pricing": "Jaké jsou poplatky u hypotéky?"},
    "investice": {"pricing": "Jaké jsou poplatky u investic?", "conditions": "Jaké jsou podmínky investičních produktů?", "benefits": "Jaké výhody mají investiční produkty?"},
    "sporeni": {"pricing": "Jaké jsou poplatky u spoření?", "conditions": "Jaké jsou podmínky spořicích produktů?", "rates": "Jaké jsou sazby spořicích produktů?", "benefits": "Jaké výhody mají spořicí produkty?"},
    "pujcky": {"pricing": "Jaké jsou poplatky u půjček?", "conditions": "Jaké jsou podmínky půjčky?", "insurance": "Jaké pojištění lze sjednat k půjčce?", "benefits": "Jaké výhody mají půjčky?"},
}


def _first(x: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    return F.coalesce(*(F.when(has_any(x, terms), F.lit(name)) for name, terms in rules))


def pending_answer(asked: Column, answer: Column) -> Column:
    """struct(target, label, query) of the first of ANSWERS that fits what was asked and what is answered, or null."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return F.coalesce(*(F.when((asked == kind) & has_any(low, terms), F.struct(F.lit(t).alias("target"), F.lit(label).alias("label"), F.lit(q).alias("query"))) for kind, terms, t, label, q in ANSWERS))


def states(turns: DataFrame, products: list[tuple[str, tuple[str, ...]]], intents: list[tuple[str, tuple[str, ...]]], short: int = SHORT, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User turns of (conv, turn, role, text, asked) with what they answer, inherit and stand for.

    asked: the kind of question that an assistant's turn left open. resolved: pending_answer of the turn right after it.
    product and intent are a turn's own; a follow-up (a short turn or one with a cue, that names no product and starts no
    new topic) inherits the last of each before it. rewritten: the question of QUESTIONS for the product before and the
    aspect of a turn that refers back to it.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    q = F.lower(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    user = F.col("role") == "user"
    d = turns.withColumns({"_q": q, "resolved": F.when(user, pending_answer(F.lag("asked").over(w), F.col("text")))})
    d = d.withColumns({"_named": F.when(user, _first(F.col("_q"), products)), "intent": F.when(user, _first(F.col("_q"), intents))})
    d = d.withColumn("product", F.coalesce("_named", F.col("resolved.target")))
    d = d.withColumns({"_product": F.last("product", ignorenulls=True).over(before), "_intent": F.last("intent", ignorenulls=True).over(before), "_earlier": F.coalesce(F.max(user.cast("int")).over(before), F.lit(0)) == 1})
    refers = has_any(F.col("_q"), REFERENCES) & F.col("_product").isNotNull()
    words = F.size(F.filter(F.split("_q", r"\s+"), lambda x: x != ""))
    follows = (words <= short) | F.col("_q").startswith("a ") | has_any(F.col("_q"), CUES) | F.contains(F.concat(F.lit(" "), F.col("_q")), F.lit(" premium")) | refers
    follows = follows & (~has_any(F.col("_q"), NEW_TOPICS) | refers) & F.col("_named").isNull() & F.col("_earlier")
    d = d.where(user).withColumns({"follow_up": follows & (F.col("_product").isNotNull() | F.col("_intent").isNotNull()), "aspect": F.when(refers, _first(F.col("_q"), ASPECTS))})
    rows = [(p, a, x) for p, by in QUESTIONS.items() for a, x in by.items()]
    asks = d.sparkSession.createDataFrame(rows, "_p string, _a string, rewritten string")  # as many rows as QUESTIONS has
    d = d.join(F.broadcast(asks), (F.col("_product") == F.col("_p")) & (F.col("aspect") == F.col("_a")), "left")
    inherits = lambda c: F.when(F.col("follow_up"), F.col(c))
    return d.select(conv, turn, "text", "resolved", "product", "intent", "follow_up", inherits("_product").alias("inherited_product"), inherits("_intent").alias("inherited_intent"), "aspect", "rewritten")
