"""A second, wider search for the queries that governance left with too little, and for those alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import governance as G
from marlstone.operators import recovery
from marlstone.streaming.folders import stored

# What widens a query, for any and by its labels, and how many of these terms at most.
BASE_TERMS = ("aktuální informace", "aktuální zdroj", "oficiální stránka", "FAQ", "podpora")
LABEL_TERMS = {
    "pricing": ("aktuální ceník", "poplatky", "sazebník", "platné ceny"),
    "accounts": ("běžný účet", "osobní účet", "eKonto", "Aktivní účet"),
    "cards": ("platební karta", "kreditní karta", "debetní karta"),
    "payments": ("platba", "převod", "SEPA", "SWIFT"),
    "mortgages": ("hypotéka", "úvěr na bydlení"),
    "investments": ("investice", "fondy", "cenné papíry"),
    "support": ("návod", "jak postupovat", "podpora"),
}
TERMS, LEAST_K, SPARSE, DENSE, KNOWN, ADDED = 8, 12, 0.55, 0.45, 12, 2
OLD_TIERS = ("historical_pdf", "migration_notice", "archived_legal")


def wider(text: Column, labels: Column) -> Column:
    """The query with the first TERMS of the terms that it lacks."""
    arr = lambda terms: F.array(*map(F.lit, terms))
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(arr(BASE_TERMS), *(F.when(F.array_contains(labels, k), arr(v)).otherwise(none) for k, v in LABEL_TERMS.items())))
    new = F.filter(every, lambda t: ~F.contains(F.lower(text), F.lower(t)))
    return F.trim(F.concat_ws(" ", text, F.array_join(F.slice(new, 1, TERMS), " ")))


def weights(sparse: float, dense: float) -> tuple[float, float]:
    """The second search leans on words: at least SPARSE, at most DENSE."""
    return max(sparse, SPARSE), min(dense, DENSE)


def recovered(candidates: DataFrame, queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 20, query: str = "qid") -> tuple[DataFrame, DataFrame]:
    """Governs candidates; for queries that collapsed searches again, governs what comes and appends up to ADDED of it.

    candidates: governance.governed's ranked rows. queries: query, text and labels (array). search answers a table of
    queries (query, text) with as many candidates each; it is given those that collapsed only, so nothing else is read
    twice. Returns the lists (query, id, final_rank, recovery, tier, document, family) and the summaries.
    """
    # top lists are small and used again and again: each is written once, and what it took isn't planned again
    candidates = stored(candidates, "candidates")
    first, summary = (stored(x, "governed") for x in G.governed(candidates, query))
    asked = queries.join(summary.where("collapsed").select(query), query, "left_semi").select(query, wider(F.col("text"), F.col("labels")).alias("text"))
    found = stored(search(stored(asked, "asked"), max(2 * k, LEAST_K)), "candidates")
    second = stored(G.governed(found, query)[0], "governed")
    kept = lambda df, of: df.join(of.select(query, "id", "archived"), [query, "id"])
    known = kept(first, candidates).select(query, "family", "archived").unionByName(candidates.where(F.col("rank") <= KNOWN).select(query, "family", "archived"))
    pool = kept(second, found).withColumn("current", ~F.col("tier").isin(*OLD_TIERS) & ~F.col("archived"))
    pool = recovery.restrict_pool(pool, known.where("not archived"), query)
    ranks = lambda df: df.select(query, "id", F.col("final_rank").alias("rank"))
    merged = recovery.merge_recovery(ranks(first), ranks(pool), ADDED, query, "id")
    places = first.select(query, "id", "document", "family", "tier").unionByName(second.select(query, "id", "document", "family", "tier").join(first.select(query, "id"), [query, "id"], "left_anti"))
    merged = stored(merged.join(places, [query, "id"]), "merged")
    again = merged.join(summary.where("collapsed").select(query), query, "left_semi")
    w = Window.partitionBy(query).orderBy("rank")
    spread = G.diversified(again, query=query).select(query, "id", F.row_number().over(w).alias("final_rank"))
    spread = spread.join(again.select(query, "id", "recovery", "tier", "document", "family"), [query, "id"])
    same = first.join(summary.where("not collapsed").select(query), query, "left_semi")
    cols = [query, "id", "final_rank", "recovery", "tier", "document", "family"]
    out = same.withColumn("recovery", F.lit(False)).select(*cols).unionByName(spread.select(*cols))
    n = out.groupBy(query).agg(F.count("*").alias("n_final"))
    added = merged.groupBy(query).agg(F.count_if("recovery").alias("n_added"))
    s = summary.join(n, query, "left").join(added, query, "left").withColumns({"n_final": F.coalesce("n_final", F.lit(0)), "n_added": F.when(F.col("collapsed"), F.coalesce("n_added", F.lit(0))).otherwise(0)})
    label = F.when(F.col("collapsed"), G.strategy(F.col("n_added") > 0, F.lit(True), F.lit(False), F.lit(0))).otherwise(F.col("strategy"))
    return out, s.withColumns({"strategy": label, "collapse_left": F.col("collapsed") & (F.col("n_added") == 0) & (F.col("n_final") < 3)})
