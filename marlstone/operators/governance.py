"""Rules on ranked lists: suppression, lineage, priority, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.pricing import has_any, joined

# Tiers with their authority and place, and the patterns and words that tell them.
AUTHORITY = {
    "product_page": 1.0, "faq_support_page": 0.9, "current_pricing": 0.8, "current_pdf": 0.7, "generic_page": 0.5, "historical_pdf": 0.4, "migration_notice": 0.2, "archived_legal": 0.1, "unknown": 0.5,
}
PRIORITY = {
    "product_page": 1, "current_pricing": 2, "faq_support_page": 3, "current_pdf": 4, "generic_page": 5, "recent_page": 6, "historical_pdf": 7, "migration_notice": 8, "archived_legal": 9, "unknown": 10,
}
URL_TIERS = [
    (r"/(osobni|firmy|podnikatele)/[a-zA-Z0-9_-]+(/[a-zA-Z0-9_-]+)?$", "product_page"), (r"/(karty|hypoteky|investice|ucty|sporeni|pozicky)", "product_page"),
    (r"(faq|casto|pomoc|podpora|kontakt|napoveda)", "faq_support_page"), (r"(cenik|sazebnik|sazebník|cenník|cennik)|/ceny/", "current_pricing"),
    (r"(migrac|change.*notice|zmena|změna|prechod|přechod)", "migration_notice"), (r"(archiv|discontinued|history|historic)", "archived_legal"),
]
TITLE_TIERS = [
    (r"(současn|soucasn|nový|novy|platný|platny|aktuáln)", "current_pricing"), (r"(ceník|cenik|sazebník|sazebnik|cenník|cennik)", "current_pricing"),
    (r"(faq|často|casto|nejčastější|nejcastejsi)", "faq_support_page"), (r"(migračn|migracn|změn|zmen|přechod|prechod)", "migration_notice"),
    (r"(archiv|historick|discontinued|star)", "archived_legal"),
]
MIGRATION = ("migračn", "migracn", "změna", "zmena", "přechod", "prechod", "change notice", "migration", "nový ceník", "novy cenik")
ARCHIVED = ("archiv", "discontinued", "již nenabíz", "jiz nenabiz", "staré produkty", "stare produkty", "historický", "historicky")
CURRENT = ("aktuáln", "současn", "soucasn", "nový ceník", "novy cenik", "2024", "2025", "2026")
SUPPORT_CATEGORIES, PRODUCT_CATEGORIES = ("support", "faq", "help"), ("retail", "accounts", "cards", "payments", "mortgages", "investments")
CURRENT_TIERS = ("product_page", "current_pricing", "faq_support_page", "current_pdf")
BLOCKED_PARTS = ("/podnikatele/", "/firmy/", "/private-banking/")
FAMILY_KEYS = ("file_name", "source_url", "url", "title", "document_family")


def authority_tier(url: Column, title: Column, file_name: Column, document_type: Column, category: Column, chunk_type: Column) -> Column:
    """The tier by metadata, then by patterns of the url, of the title and file name, by words, and by category."""
    u, t, f, kind, cat = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, title, file_name, document_type, category))
    hay = joined(u, t, f)
    out = F.when((kind == "pricing") & has_any(hay, MIGRATION), "migration_notice").when((kind == "pricing") & has_any(hay, ARCHIVED), "historical_pdf").when(kind == "pricing", "current_pricing")
    out = out.when((kind == "faq") | (F.lower(F.coalesce(chunk_type, F.lit(""))) == "faq"), "faq_support_page")
    for p, tier in URL_TIERS:
        out = out.when(u.rlike(p), tier)
    for p, tier in TITLE_TIERS:
        out = out.when(t.rlike(p) | f.rlike(p), tier)
    out = out.when(has_any(hay, MIGRATION), "migration_notice").when(has_any(hay, ARCHIVED), "archived_legal").when(has_any(hay, CURRENT), "current_pdf")
    return out.when(cat.isin(*SUPPORT_CATEGORIES), "faq_support_page").when(cat.isin(*PRODUCT_CATEGORIES), "product_page").otherwise("unknown")


def _by_tier(tier: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), tier)


def authority_boost(tier: Column) -> Column:
    return F.round(F.least(F.lit(0.30), F.greatest(F.lit(-0.30), (_by_tier(tier, AUTHORITY) - 0.5) * 0.6)), 4)


def priority(tier: Column) -> Column:
    return _by_tier(tier, PRIORITY)


def _alike(a: Column, b: Column) -> Column:
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def same_family(a: Column, b: Column) -> Column:
    """Whether any of FAMILY_KEYS of two documents (structs) is equal or part of the other's."""
    out = F.lit(False)
    for k in FAMILY_KEYS:
        out = out | _alike(a[k], b[k])
    return out


def suppression(df: DataFrame, query: str = "qid") -> DataFrame:
    """df with suppressed_by: the first rule that takes a row out of its query's ranked list, null for kept rows.

    df has rank (from 1), tier, archived, document_type, category, product and FAMILY_KEYS. A list is a top-k of tens of
    rows, so that a query's current documents are one array."""
    w = Window.partitionBy(query)
    own = F.struct("rank", "product", *FAMILY_KEYS)
    d = df.withColumn("_own", own)
    firsts = F.array(*(F.min(F.when(F.col("tier") == t, F.col("_own"))).over(w) for t in CURRENT_TIERS))
    d = d.withColumn("_first", F.filter(firsts, lambda x: x.isNotNull())).withColumn("_prices", F.collect_list(F.when(F.col("tier") == "current_pricing", F.col("_own"))).over(w))
    old = F.col("tier").isin("archived_legal", "historical_pdf")
    pricing = (F.col("document_type") == "pricing") | F.contains(F.lower(F.coalesce("category", F.lit(""))), F.lit("pricing"))
    rules = [
        ("archived_not_beats_current", old & F.exists("_first", lambda x: same_family(F.col("_own"), x))),
        ("historical_pricing_blocked", (F.col("tier") == "historical_pdf") & pricing & F.exists("_prices", lambda x: _alike(F.col("product"), x["product"]) | same_family(F.col("_own"), x))),
        ("retail_only_source_filter", has_any(F.lower(F.coalesce("url", F.lit(""))), BLOCKED_PARTS)),
        ("migration_notice_not_primary", (F.col("tier") == "migration_notice") & (F.col("rank") == 1)),
        ("archived_legal_not_primary", (F.col("tier") == "archived_legal") & (F.col("rank") == 1)),
        ("deprecated_faq_not_primary", (F.col("tier") == "faq_support_page") & F.col("archived")),
    ]
    return d.withColumn("suppressed_by", F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))).drop("_own", "_first", "_prices")


def resilience_category(category: Column, *others: Column) -> Column:
    """The category, or the first of the other fields that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (category, *others)), F.lit("unknown"))


def strategy(recovered: Column, collapsed: Column, diversity: Column, n_suppressed: Column) -> Column:
    return F.when(recovered, "governance_recovery").when(collapsed, "collapse_detected_no_recovery").when(diversity, "source_diversity_enforced").when(n_suppressed > 0, "governance_suppressed").otherwise("normal_retrieval")


def governed(df: DataFrame, query: str = "qid") -> tuple[DataFrame, DataFrame]:
    """The whole chain on ranked lists: suppression, lineage, priority, diversity; and a summary of each query.

    df has suppression's columns, id, document, family, generation and year. The list has its final rank, the summary
    counts, the share suppressed, whether too little was left, and the strategy."""
    s = suppression(df, query)
    kept = by_priority(lineage_latest(s.where("suppressed_by is null"), query).withColumn("_p", priority(F.col("tier"))), "_p", query)
    before = kept.select(query, "id", F.col("priority_rank").cast("int").alias("rank"), "document", "family", "tier")
    out = diversified(before, query=query)
    w = Window.partitionBy(query).orderBy("rank")
    out = out.join(before.select(query, "id", "tier"), [query, "id"]).withColumn("final_rank", F.row_number().over(w))
    n = s.groupBy(query).agg(F.count("*").alias("n_in"), F.count("suppressed_by").alias("n_suppressed"))
    m = before.groupBy(query).agg(F.count("*").alias("n_kept"))
    k = out.groupBy(query).agg(F.count("*").alias("n_out"))
    t = n.join(m, query, "left").join(k, query, "left").select(query, "n_in", "n_suppressed", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    collapsed = (F.col("n_suppressed") / F.col("n_in") > 0.5) | (F.col("n_kept") < 3) | (F.col("n_out") < 3)
    label = strategy(F.lit(False), collapsed, F.col("n_out") < F.col("n_kept"), F.col("n_suppressed"))
    return out, t.select("*", F.round(F.col("n_suppressed") / F.col("n_in"), 4).alias("suppression_ratio"), collapsed.alias("collapsed"), label.alias("strategy"))


def lineage_latest(df: DataFrame, query: str = "qid", family: str = "family") -> DataFrame:
    """Of each family only the highest (generation, year), then the best rank."""
    w = Window.partitionBy(query, family).orderBy(F.desc("generation"), F.desc("year"), "rank")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_priority(df: DataFrame, priority: str = "tier", query: str = "qid") -> DataFrame:
    """New ranks by tier, then by the old rank; overridden tells whether the first place changed."""
    w = Window.partitionBy(query).orderBy(priority, "rank")
    first = F.first_value("rank").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("priority_rank", F.row_number().over(w)).withColumn("overridden", first != F.min("rank").over(Window.partitionBy(query)))


def suppressed(df: DataFrame, query: str = "qid") -> DataFrame:
    """Without archived rows of a family that has a current one."""
    w = Window.partitionBy(query, "family")
    return df.withColumn("_current", F.max((~F.col("archived")).cast("int")).over(w)).where(~(F.col("archived") & (F.col("_current") == 1))).drop("_current")


def diversified(df: DataFrame, per_document: int = 2, per_family: int = 3, least: int = 3, query: str = "qid") -> DataFrame:
    """Greedy caps in rank order that never skip while fewer than `least` are kept.

    Takes the ranked top list of each query (tens of rows), so one query's list is one array; the fold runs in the JVM.
    """
    row = F.struct("rank", "id", "document", "family")
    lists = df.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.expr("cast(array() as array<struct<rank:int,id:bigint,document:string,family:string>>)")
    step = lambda kept, x: F.when(
        (F.size(kept) < least) | ((F.size(F.filter(kept, lambda y: y["document"] == x["document"])) < per_document) & (F.size(F.filter(kept, lambda y: y["family"] == x["family"])) < per_family)),
        F.concat(kept, F.array(x)),
    ).otherwise(kept)
    typed = F.transform("rows", lambda r: F.struct(r["rank"].cast("int").alias("rank"), r["id"].cast("bigint").alias("id"), r["document"].alias("document"), r["family"].alias("family")))
    return lists.select(query, F.inline(F.aggregate(typed, none, step)))


def diversity_score(df: DataFrame, query: str = "qid") -> DataFrame:
    return df.groupBy(query).agg(F.round((F.countDistinct("document") / F.count("*") + F.countDistinct("family") / F.count("*")) / 2, 4).alias("diversity"))


def needs_recovery(before: DataFrame, after: DataFrame, query: str = "qid", ratio: float = 0.5, least: int = 3) -> DataFrame:
    """Whether more than `ratio` of a query's rows were suppressed or fewer than `least` are left."""
    n, m = before.groupBy(query).agg(F.count("*").alias("n")), after.groupBy(query).agg(F.count("*").alias("m"))
    left = F.coalesce("m", F.lit(0))
    return n.join(m, query, "left").select(query, F.round(1 - left / F.col("n"), 4).alias("suppression_ratio"), ((1 - left / F.col("n") > ratio) | (left < least)).alias("recover"))
