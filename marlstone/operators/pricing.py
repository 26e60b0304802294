"""Price rows: duplicates, scores against a query, and the choice of rows that answer it.

A row has product, fee, value, currency, period, year, active, official (0-100), from_table and confidence; the names are
parameters where a table differs. Duplicates go by one aggregate with a struct as rank, so that each task sends one row
a key; every rank ends in the row's id, so ties give the same row in every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a price row's score. Fixed values.
OVERLAP, PRODUCT, ACTIVE, INACTIVE, PRIMARY, NOT_PRIMARY, KNOWN, MISSING, YEAR_STEP, YEAR_MOST = 0.08, 5.0, 5.0, -100.0, 6.0, -20.0, 2.0, -1.0, 0.2, 2.0
REJECTED, LEAST_CONFIDENCE, BASE_YEAR = -999.0, 0.70, 2020


def best_by(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], id_col: str) -> DataFrame:
    """The row of each key with the highest rank, the smallest id among equals. Null keys are a key of their own."""
    order = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), (-F.col(id_col)).alias("tie"))
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order)
    return df.groupBy(*(F.lower(F.trim(F.col(k).cast("string"))).alias(f"_k{i}") for i, k in enumerate(keys))).agg(best.alias("_b")).select("_b.*")


def exact_facts(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row of each identical fact: the newest, then the best scored."""
    return best_by(rows, ["product", "fee", "value", "currency", "period"], [F.coalesce("year", F.lit(0)), F.col("score")], id_col)


def fee_slots(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row of each product, fee and period, whatever its value: a stale price does not survive beside a current one."""
    return best_by(rows, ["product", "fee", "period"], [F.col("active").cast("int"), F.coalesce("year", F.lit(0)), F.col("official"), F.col("from_table").cast("int"), F.col("score")], id_col)


def index_rows(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows for the sparse index: active ones, one of each slot by (year, official, table, confidence)."""
    return best_by(rows.where("active"), ["product", "fee", "period"], [F.coalesce("year", F.lit(0)), F.col("official"), F.col("from_table").cast("int"), F.col("confidence")], id_col)


def score(tokens: Column, wanted: Column, same_product: Column, primary_row: Column, primary_query: Column) -> Column:
    """A row's score for a query: rejected below the least confidence, else the sum of its parts."""
    part = lambda c, yes, no=0.0: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    year = F.least(F.lit(YEAR_MOST), F.greatest(F.lit(0.0), (F.coalesce("year", F.lit(0)) - BASE_YEAR) * YEAR_STEP))
    s = F.size(F.array_intersect(tokens, wanted)) * OVERLAP + F.col("official") / 10.0 + part(F.col("active"), ACTIVE, INACTIVE)
    s = s + part(same_product, PRODUCT) + F.when(primary_query, part(primary_row, PRIMARY, NOT_PRIMARY)).otherwise(F.lit(0.0))
    s = s + part(F.col("value").isNotNull(), KNOWN, MISSING) + year
    return F.round(F.when(F.col("confidence") < LEAST_CONFIDENCE, F.lit(REJECTED)).otherwise(s), 4)


def resolve(rows: DataFrame, queries: Sequence[tuple[str, str, bool]], k: int = 5, id_col: str = "row_id") -> DataFrame:
    """The k best rows of each query (text, product, about the primary fee).

    rows have tokens (array) and primary (boolean). The queries are a literal array, unrolled beside each row; rejected
    rows go; of a query about the primary fee only primary rows count, if there are any. The rank's limit is applied in
    every task before the shuffle.
    """
    asked = F.array(*(F.struct(F.lit(q).alias("query"), F.lit(p).alias("asked_product"), F.lit(m).alias("asked_primary")) for q, p, m in queries))
    # Inactive rows are rejected too: a price that no longer holds never answers.
    s = rows.select("*", F.inline(asked))
    wanted = F.split(F.lower("query"), " ")
    s = s.withColumn("score", score(F.col("tokens"), wanted, F.col("product") == F.col("asked_product"), F.col("primary"), F.col("asked_primary"))).where(F.col("score") > 0)
    # "Only if something is left": the flag is one row a query.
    some = s.where("primary and asked_primary").groupBy("query").agg(F.lit(True).alias("has_primary"))
    s = s.join(F.broadcast(some), "query", "left").where("has_primary is null or primary")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col(id_col))
    exact = F.col("product") == F.col("asked_product")
    sure = F.when(exact & F.col("primary") & (F.col("official") >= 80), "high").when(exact | (F.col("official") >= 70), "medium").otherwise("low")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("sure", sure)


def generations(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Of each product the rows of the best class there is: active and primary, archived and primary, active, archived;
    then those of its newest year. (rows with class)"""
    cls = F.when(F.col("active") & F.col("primary"), 1).when(F.col("primary"), 2).when(F.col("active"), 3).otherwise(4)
    c = rows.withColumn("class", cls)
    best = c.groupBy("product").agg(F.min(F.struct("class", (-F.coalesce("year", F.lit(0))).alias("y"))).alias("_b"))
    return c.join(best, "product").where((F.col("class") == F.col("_b.class")) & (F.coalesce("year", F.lit(0)) == -F.col("_b.y"))).drop("_b")


def product_of(text: Column, aliases: Sequence[tuple[str, str, float]], single: float = 0.82) -> Column:
    """(product, confidence) of the best alias (alias, product, confidence) in the text; the first one wins a tie.

    An alias of one word must be a whole word and counts at most `single`; one of several words may be any substring.
    """
    low = F.lower(text)
    found = []
    for i, (alias, product, sure) in enumerate(aliases):
        one = " " not in alias
        hit = low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){alias}(?![\p{{L}}\p{{N}}_])") if one else F.contains(low, F.lit(alias))
        found.append(F.when(hit, F.struct(F.lit(min(sure, single) if one else sure).alias("confidence"), F.lit(-i).alias("place"), F.lit(product).alias("product"))))
    return F.array_max(F.array(*found))


def answer_lines(rows: DataFrame, group: str, products: int = 3, lines: int = 3) -> DataFrame:
    """(group, answer): the first `products` products by their best rank, of each the first `lines` distinct lines.

    rows have the group column, product, line and rank.
    """
    d = rows.groupBy(group, "product", "line").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(group, "product").orderBy("rank", "line")
    d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines)
    p = d.groupBy(group, "product").agg(F.min("rank").alias("_best"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "; ").alias("_text"))
    p = p.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy("_best", "product"))).where(F.col("_p") <= products)
    item = F.struct("_p", F.concat_ws(": ", "product", "_text").alias("t"))
    return p.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n").alias("answer"))
