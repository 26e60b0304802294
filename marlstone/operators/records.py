"""Joins and look-ups of an ingest: metadata, what is new, what replaces what; and how an answer is labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.pricing import has_any
from marlstone.functions.tables import PRICING_TERMS

# Words of the categories and types, and the origins and buckets of answers.
CATEGORIES = [
    ("corporate", ("firmy", "firma", "podnikatele", "podnikatel", "corporate", "firemní", "firemni", "podnikatelský", "podnikatelsky", "corp")),
    ("retail", ("osobni", "osobní", "aktivní účet", "aktivni ucet", "ekonto", "běžný účet", "bezny ucet", "chytrý účet", "chytry ucet")),
    ("accounts", ("ucet", "účet", "ucty", "účty", "ekonto")), ("cards", ("karta", "karty", "kreditni", "kreditní", "debetni", "debetní")),
    ("mortgages", ("hypoteka", "hypotéka", "hypotec")), ("loans", ("pujcka", "půjčka", "uver", "úvěr", "rpsn")), ("savings", ("sporeni", "spoření", "vklad")),
    ("investments", ("invest", "fond", "dip")), ("insurance", ("pojist", "pojišt")), ("pricing", ("cenik", "ceník", "sazebnik", "sazebník", "poplat")),
    ("documents", ("podmink", "podmínk", "dokument", "formular", "formulář")),
]
FIRST_CATEGORIES = (("corporate", "corporate"), ("retail", "retail"), ("cards", "cards"), ("mortgages", "mortgages"), ("investments", "investing"), ("insurance", "insurance"))
PRICING_TYPES = [
    ("account_fee", ("vedení účtu", "vedeni uctu", "měsíční poplatek", "mesicni poplatek", "běžný účet", "bezny ucet", "aktivní účet", "aktivni ucet", "ekonto")),
    ("withdrawal_fee", ("výběr", "vyber", "bankomat", "zahraničí", "zahranici", "atm")), ("card_fee", ("karta", "karty", "kreditní", "kreditni", "debetní", "debetni")),
    ("mortgage_fee", ("hypot", "odhad", "zástav", "zastav", "úvěr na bydlení", "uver na bydleni")),
]
DOCUMENT_TYPES = [("pricing", PRICING_TERMS), ("terms", ("podmín", "podmink", "vop")), ("faq", ("faq", "časté dotazy", "caste-dotazy"))]
ARCHIVED = (
    "již nenabízené", "jiz nenabizene", "discontinued", "archived", "archive", "staré produkty", "stare produkty", "nenabízené produkty", "nenabizene produkty", "již nenabízených", "jiz nenabizenych",
)
ORIGINS = [
    ("identity", ("identity_direct",)), ("procedural", ("guided_flow_direct", "procedural_flow_direct")), ("pricing_row", ("pricing_row_direct",)),
    ("overview_direct", ("card_overview_direct", "account_overview_direct", "mortgage_overview_direct", "investment_overview_direct", "payment_overview_direct", "sepa_swift_overview_direct", "product_overview_direct", "credit_card_catalog_direct", "comparison_direct")),
    ("soft_guidance", ("soft_guidance_direct",)), ("clarification", ("clarification_direct",)), ("unsupported", ("unsupported_direct", "fallback_no_answer")), ("overview_fallback", ("overview_fallback",)),
]
HIGH, LOW = ("pricing_row", "procedural", "identity"), ("unsupported",)
DEGRADED = ("overview_fallback", "unsupported_direct", "fallback_no_answer", "soft_guidance_direct")


def _first(x: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    return F.coalesce(*(F.when(has_any(x, terms), F.lit(name)) for name, terms in rules), F.lit(other))


def category(x: Column, other: str = "unknown") -> Column:
    """The first of FIRST_CATEGORIES whose words occur, else the first category."""
    low, words = F.lower(x), dict(CATEGORIES)
    return F.coalesce(*(F.when(has_any(low, words[k]), F.lit(name)) for k, name in FIRST_CATEGORIES), _first(low, CATEGORIES, other))


def pricing_type(x: Column) -> Column:
    return _first(F.lower(x), PRICING_TYPES, "generic_pricing")


def document_type(x: Column, other: str = "document") -> Column:
    return _first(F.lower(x), DOCUMENT_TYPES, other)


def archived(x: Column) -> Column:
    return has_any(F.lower(x), ARCHIVED)


def answer_origin(strategy: Column) -> Column:
    """Where an answer of that strategy comes from; any direct overview is one, any other unknown strategy a generated one."""
    named = (F.when(strategy.isin(*names), F.lit(o)) for o, names in ORIGINS)
    return F.coalesce(*named, F.when(strategy.endswith("_overview_direct"), F.lit("overview_direct")), F.lit("llm_generated"))


def confidence_bucket(origin: Column) -> Column:
    return F.when(origin.isin(*HIGH), "high").when(origin.isin(*LOW), "low").otherwise("medium")


def answer_strategy(is_price_row: Column, asks_price: Column, chunk_type: Column, document_type: Column) -> Column:
    """By the best document: a price row answers itself; tables and sections of price documents go to the model as such."""
    priced = asks_price & (document_type == "pricing")
    return F.when(is_price_row, "pricing_row_direct").when(priced & chunk_type.isin("table", "pdf_table"), "pricing_table_llm").when(priced, "pricing_section_llm").otherwise("generic_llm")


def accepted_rewrite(query: Column, rewrite: Column) -> Column:
    """The rewritten query, unless it is empty, the same, over 1.5 times as long, or shares no word with the query."""
    words = lambda c: F.filter(F.split(T.fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    same = F.lower(F.trim(rewrite)) == F.lower(F.trim(query))
    bad = (F.trim(rewrite) == "") | same | (F.length(rewrite) > 1.5 * F.length(query)) | ~F.arrays_overlap(words(query), words(rewrite))
    return F.when(F.coalesce(bad, F.lit(True)), query).otherwise(rewrite)


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in that order; rows without key go."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_metadata(files: DataFrame, metadata: DataFrame, key: str, *order: str) -> DataFrame:
    """files with the last metadata row of their key, if there is one."""
    return files.join(last_wins(metadata, key, *order), key, "left")


def new_downloads(found: DataFrame, known: DataFrame, url: str = "url", digest: str = "digest") -> DataFrame:
    """What is found under no known url and with no known content, the first url of equal contents."""
    fresh = found.join(known.select(url).distinct(), url, "left_anti").join(known.select(digest).distinct(), digest, "left_anti")
    w = Window.partitionBy(digest).orderBy(url)
    return fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def replaced(base: DataFrame, derived: Column, fresh: DataFrame, key: str) -> DataFrame:
    """base without its derived rows, and fresh rows whose key it doesn't hold (or that have none)."""
    kept = base.where(~F.coalesce(derived, F.lit(False)))
    return kept.unionByName(fresh.join(kept.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one of two tables holds."""
    x, y = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (a, b))
    return x.join(y, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(y.join(x, key, "left_anti").select(F.lit("right").alias("side"), key))


def invalidated(entries: DataFrame, namespace: str | None = None, product: str | None = None) -> DataFrame:
    """The cache entries that stay when those of a namespace and product (each: any, if not given) are dropped."""
    hit = F.lit(True)
    if namespace is not None:
        hit = hit & F.col("namespace").eqNullSafe(F.lit(namespace))
    if product is not None:
        hit = hit & F.col("product").eqNullSafe(F.lit(product))
    return entries.where(~hit)


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(field, value, n, place) of each column's n most frequent values; ties go to the smaller value. One pass."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns)))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return df.select(each).groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def outside_boxes(blocks: DataFrame, boxes: DataFrame, page: str = "page", slack: float = 5) -> DataFrame:
    """The blocks (x0, y0, x1, y1) that lie in no box of their page, with so much slack on every side."""
    b = boxes.select(F.col(page).alias("_page"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("x0") >= F.col("_x0") - slack) & (F.col("y0") >= F.col("_y0") - slack) & (F.col("x1") <= F.col("_x1") + slack) & (F.col("y1") <= F.col("_y1") + slack)
    return blocks.join(b, (F.col(page) == F.col("_page")) & inside, "left_anti")
