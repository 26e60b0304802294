"""Price rows: the first rule that rejects a row, counters of the reasons, and the valid and the rejected rows as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.functions import quality as Q
from marlstone.functions.pricing import has_any

# What a price, a header, a numbered column, a generic product and a period look like, and what is free.
PRICE = r"(?iu)(zdarma|v ceně|[0-9]+[\s,.]*[0-9]*\s*(Kč|CZK|%))"
HEADER = r"(?iu)^(název položky|nazev polozky|poplatek|cena|hodnota|typ|měna|frekvence|sloupec\s+\d+)$"
COLUMN, COLUMN_ONLY = r"(?iu)^sloupec\s+\d+", r"(?iu)^sloupec\s+\d+$"
GENERIC = r"(?iu)^(?:veden[ií]\s+(?:jednoho\s+)?b[eě][zž]n[eé]ho\s+[uú][cč]tu|veden[ií]\s+[uú][cč]tu|cena\s+tarifu|poplatek|cena|hodnota|měsíčně|mesicne|ročně|rocne)$"
PERIOD = r"(?iu)měsíčně|mesicne|ročně|rocne|jednorázově|jednorazove|denně|denne"
MONTHLY = ("vedení", "vedeni", "cena tarifu", "měsíční", "mesicni")
INCLUDED, CROWNS, EUROS = r"(?iu)zdarma|v\s+ceně|v\s+cene", r"(?iu)kč|czk|zdarma|v\s+ceně|v\s+cene", r"(?iu)eur|€"
NUMBER = r"(\d+(?:[\s.]\d{3})*(?:[,.]\d+)?)"
FREE = ("zdarma", "free", "bez poplatku", "0 kč", "0 czk")
SHORT, MERGED, NAMED, SIGNAL, CONFIDENCE, SHOWN = 3, 100, 12, 0.05, 0.70, 60
#: The counter of each reason; any other reason counts as other. Some counters belong to reasons that no rule gives.
COUNTERS = {
    "garbage_ocr": ("garbage_text", "merged_column"), "corrupted_chars": ("corrupted_chars",), "header_artifact": ("header_artifact",), "scrambled": ("scrambled",), "dot_noise": ("dot_noise",),
    "broken_unicode": ("broken_unicode",), "excessive_symbols": ("excessive_symbols",), "low_alpha": ("low_alpha",),
    "missing_fields": ("missing_fields", "missing_pricing_value", "missing_amount", "missing_currency", "missing_period", "orphan_product_context"), "low_confidence": ("low_confidence",),
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def amount(value: Column) -> Column:
    """0 where it's included, else the first number with its spaces taken out; empty if there is none."""
    return F.when(value.rlike(INCLUDED), "0").otherwise(F.replace(F.regexp_extract(value, NUMBER, 1), F.lit(" "), F.lit("")))


def currency(value: Column) -> Column:
    return F.when(value.rlike(CROWNS), "CZK").when(value.rlike(EUROS), "EUR").otherwise("")


def period(given: Column, value: Column, fee: Column, conditions: Column) -> Column:
    """The given one, else one that the texts name, else monthly for fees of keeping an account; empty if unknown."""
    line = F.concat(value, F.lit(" "), fee, F.lit(" "), conditions)
    named = F.regexp_extract(line, f"({PERIOD})", 1)
    return F.when(Q.stripped(given) != "", Q.stripped(given)).when(named != "", named).when(has_any(F.lower(line), MONTHLY), "měsíčně").otherwise("")


def with_reason(rows: DataFrame) -> DataFrame:
    """rows (product_name, fee_type, fee_value, currency, period, conditions, confidence) with amount, currency and period as
    they are given or read from the texts, and `reason`: the first failing rule, null for a valid row. A missing confidence is 0."""
    fee, product, value = (Q.stripped(_text(F.col(c))) for c in ("fee_type", "product_name", "fee_value"))
    d = rows.withColumns({"_fee": fee, "_product": product, "_value": value, "_period": period(_text(F.col("period")), _text(F.col("fee_value")), _text(F.col("fee_type")), _text(F.col("conditions")))})
    d = d.withColumns({"amount": amount(F.col("_value")), "currency": F.coalesce(F.nullif(Q.stripped(_text(F.col("currency"))), F.lit("")), currency(F.col("_value"))), "_all": F.concat_ws(" ", "_fee", "_product", "_value")})
    fee, product, value, every = (F.col(c) for c in ("_fee", "_product", "_value", "_all"))
    low = F.lower(product)
    rules = [
        ("header_artifact", F.lower(fee).rlike(HEADER) | low.rlike(COLUMN_ONLY)),
        ("missing_fields", (F.length(fee) < SHORT) | (F.length(product) < SHORT) | (_text(F.col("fee_value")) == "")),
        ("merged_column", fee.rlike(PRICE) | (F.length(fee) > MERGED) | product.rlike(COLUMN)),
        ("broken_unicode", Q.broken_marks(every)),
        ("garbage_text", Q.garbage(fee) | ((F.length(product) > NAMED) & Q.garbage(product)) | Q.garbage(every)),
        ("missing_pricing_value", ~value.rlike(PRICE) & (Q.vocabulary_share(F.concat_ws(" ", fee, product)) < SIGNAL)),
        ("low_confidence", F.coalesce(F.col("confidence"), F.lit(0.0)) < CONFIDENCE),
        ("orphan_product_context", (product == "") | product.rlike(GENERIC) | (low == F.lower(fee)) | low.startswith("sloupec ")),
        ("missing_amount", F.col("amount") == ""),
        ("missing_currency", ~F.lower(value).isin(*FREE) & (F.col("currency") == "")),
        ("missing_period", ~F.lower(value).isin(*FREE) & (F.col("_period") == "")),
    ]
    return d.withColumn("reason", F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))).withColumn("period", F.col("_period")).drop("_fee", "_product", "_value", "_period", "_all")


def counters(reason: Column) -> list[Column]:
    """total_input, valid_output and a count for each of COUNTERS and the rest, zeros included."""
    known = [r for rs in COUNTERS.values() for r in rs]
    each = [F.count_if(reason.isin(*rs)).alias(f"filtered_{n}") for n, rs in COUNTERS.items()]
    return [F.count(F.lit(1)).alias("total_input"), F.count_if(reason.isNull()).alias("valid_output"), *each, F.count_if(~reason.isin(*known)).alias("filtered_other")]


def write_filtered(rows: DataFrame, folder: str) -> dict[str, int]:
    """Writes below folder the `checked` rows (Parquet), and of them the `valid` ones and an audit of the `rejected` ones
    (JSON lines); returns the counters, which are observed while the checked rows are written. The rules run once."""
    seen = Observation("price rows")
    checked = with_reason(rows)
    checked.observe(seen, *counters(F.col("reason"))).write.parquet(f"{folder}/checked")
    checked = rows.sparkSession.read.schema(checked.schema).parquet(f"{folder}/checked")
    checked.where("reason IS NULL").drop("reason").write.json(f"{folder}/valid")
    shown = [F.substring(_text(F.col(c)), 1, SHOWN).alias(c) for c in ("fee_type", "product_name")]
    checked.where("reason IS NOT NULL").select("reason", *shown).write.json(f"{folder}/rejected")
    return dict(seen.get)
