"""Price rows out of table cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.pricing import has_any
from marlstone.functions.tables import line_cells, markdown_lines, single_share
from marlstone.operators.once import once, once_of
from marlstone.streaming.folders import stored

# Patterns of price tables. A word ends where no letter, digit or underscore follows.
VALUE = r"(?iu)(?:^|[^\p{L}\p{N}_])(zdarma|v ceně|[0-9][\d\s]*(?:[,.]\d+)?\s*(?:Kč|CZK))(?:$|[^\p{L}\p{N}_])"
PERIOD = r"(?iu)(?:^|[^\p{L}\p{N}_])(měsíčně|mesicne|ročně|rocne|denně|denne|jednorázově|jednorazove|za\s+měsíc|za\s+mesic|za\s+rok)(?:$|[^\p{L}\p{N}_])"
SPACING = r"(?:^|[^\p{L}\p{N}_])[\p{L}\p{N}_]\s+[\p{L}\p{N}_]\s+[\p{L}\p{N}_]\s+[\p{L}\p{N}_](?:$|[^\p{L}\p{N}_])"
NOT_A_LABEL = (
    r"(?iu)pozn\.?|podmín|podmin|kreditní\s+obrat|kreditni\s+obrat|aktiv[\p{L}\p{N}_]*\s+využív|aktiv[\p{L}\p{N}_]*\s+vyuziv|transakce|"
    r"minimální\s+vklad|minimalni\s+vklad|příjem\s+na\s+účet|prijem\s+na\s+ucet|bonus|akc|poznámka|poznamka"
)
THRESHOLD = r"(?iu)obrat|příjem|prijem|vklad|kredit|transakce"
GENERIC = r"(?iu)^(?:cena|poplatek|hodnota|měsíčně|mesicne|ročně|rocne|vedení\s+(?:jednoho\s+)?běžného\s+účtu|vedeni\s+(?:jednoho\s+)?bezneho\s+uctu)$"
PRODUCT_WORDS = ("účet", "ucet", "ekonto", "konto", "tarif", "karta", "program")
PLAIN_HEADS = ("cena", "poplatek", "hodnota")
PRICE_ROW = ("column", "product_name", "fee_type", "fee_value", "currency", "period", "conditions", "confidence")
PERIODIC = ("měsí", "mesic", "roč", "roc", "jednor")


def value_of(x: Column) -> Column:
    return F.trim(F.regexp_extract(x, VALUE, 1))


def numeric(value: Column) -> Column:
    """0 for free, else the number with spaces between thousands."""
    n = F.regexp_extract(value, r"([0-9][\d\s]*(?:[,.]\d+)?)", 1)
    return F.when(value.rlike(r"(?iu)zdarma|v ceně"), F.lit(0.0)).otherwise(F.replace(F.regexp_replace(n, r"\s", ""), F.lit(","), F.lit(".")).try_cast("double"))


def confidence(product: Column, fee: Column, value: Column, currency: Column, period: Column) -> Column:
    """Weights of the parts that are there; a threshold in place of a fee costs 0.40."""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    number = numeric(value)
    named = lambda c: (c != "") & ~c.rlike(NOT_A_LABEL)
    s = part(named(product), 0.25) + part(named(fee), 0.25) + part(number.isNotNull(), 0.25) + part((currency != "") | value.rlike(r"(?iu)zdarma|v ceně"), 0.15)
    s = s + part((period != "") | has_any(F.lower(fee), PERIODIC), 0.10) - part((number > 10000) & fee.rlike(THRESHOLD), 0.40)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)


def repeated_cells(tables: DataFrame, markdown: str, made: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """markdown_lines with headers and cells, and with what `made` makes of rows of these two; a row that it leaves out goes.

    Lines of price lists repeat, so that a line is cut into cells, and `made` computed, once for each head and line."""
    lines = stored(markdown_lines(tables, markdown), "table-lines")
    return once(lines, ["head", "line"], lambda d: made(line_cells(d)), "table-cells").drop("head", "line")


def _priced_cells(d: DataFrame) -> DataFrame:
    """The price rows of rows (headers, cells, parent) with their other columns."""
    rest = d.columns
    text = F.array_join("cells", " ")
    d = d.select("*", F.posexplode("cells").alias("column", "cell"))
    d = d.withColumn("fee_value", value_of(F.col("cell"))).where("fee_value <> ''")
    i, first = F.col("column"), F.coalesce(F.get(F.col("cells"), F.lit(0)), F.lit(""))
    header = F.coalesce(F.get(F.col("headers"), i), F.lit(""))
    product = F.when((i > 0) & ~F.lower(header).isin(*PLAIN_HEADS), header).otherwise(first)
    generic = lambda c: (c == "") | F.trim(c).rlike(GENERIC) | F.lower(c).startswith("sloupec ")
    parent = F.col("parent")
    grouped = F.when(parent.isNotNull() & generic(product), parent).when(parent.isNotNull() & (i > 0) & ~F.startswith(F.lower(product), F.lower(parent)), F.concat(parent, F.lit(" – "), product)).otherwise(product)
    d = d.withColumn("product_name", grouped).withColumn("fee_type", F.when(i > 0, first).otherwise(header))
    cur = F.when(F.col("fee_value").rlike("(?iu)kč|czk|zdarma|v ceně"), "CZK").otherwise("")
    period = F.regexp_extract(F.concat_ws(" ", "cell", "fee_type", F.array_join("headers", " "), text), PERIOD, 1)
    others = F.filter(F.transform("cells", lambda c, j: F.when((j > 0) & (j != i) & (c != "") & ~c.rlike(VALUE), c)), lambda c: c.isNotNull())
    d = d.withColumn("currency", cur).withColumn("period", period).withColumn("conditions", F.array_join(others, "; "))
    d = d.withColumn("confidence", confidence(F.col("product_name"), F.col("fee_type"), F.col("fee_value"), F.col("currency"), F.col("period")))
    bad = generic(F.col("product_name")) | F.col("product_name").rlike(NOT_A_LABEL) | F.col("fee_type").rlike(NOT_A_LABEL) | (F.col("fee_type") == "") | ((numeric(F.col("fee_value")) > 10000) & F.col("fee_type").rlike(THRESHOLD))
    return d.where(~F.coalesce(bad, F.lit(False)) & (F.col("confidence") >= 0.70)).select(*rest, *PRICE_ROW)


def price_rows(cells: DataFrame, table: str = "table_id", row: str = "row_index") -> DataFrame:
    """(table, row, column, product_name, fee_type, fee_value, currency, period, conditions, confidence) of every cell that
    holds a price.

    cells: one row for each table row, with its number, the table's `headers` and its own `cells`. A row without a price
    that names a product is the product of the rows after it. Rows with scattered letters, generic products, labels that
    are no fees, thresholds and confidences under 0.70 are left out.

    Rows of price lists repeat, so the tests are made once for each different row, and its price rows once for each
    product that it stands under; tables meet them by a number.
    """
    solid = F.filter("cells", lambda c: F.trim(c) != "")
    head = F.trim(F.get(solid, F.lit(0)))
    priced = F.exists("cells", lambda c: c.rlike(VALUE))
    names = ~priced & (F.length(head) >= 4) & ~head.rlike(NOT_A_LABEL) & ~head.rlike(GENERIC) & has_any(F.lower(head), PRODUCT_WORDS)
    text = F.array_join("cells", " ")
    n, share = single_share(text)

    def kinds(d: DataFrame) -> DataFrame:
        d = d.withColumn("_names", F.coalesce(names, F.lit(False))).withColumn("_number", F.monotonically_increasing_id())
        holds = ~F.col("_names") & priced & (n > 0) & (share <= 0.28) & ~text.rlike(SPACING)
        d = d.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_head", F.when(F.col("_names"), head))
        return d.where(F.col("_holds") | F.col("_names")).drop("_names")

    d, different = once_of(cells.select(table, row, "headers", "cells"), ["headers", "cells"], kinds, "row-kinds")
    w = Window.partitionBy(table).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select(table, row, "_number", "_holds", F.last("_head", ignorenulls=True).over(w).alias("parent")).where("_holds").drop("_holds")
    whole = different.select("_number", "headers", "cells")
    made = lambda k: _priced_cells(k.join(whole, "_number")).select("_number", "parent", *PRICE_ROW)
    return once(stored(d, "row-parents"), ["_number", "parent"], made, "price-rows").select(table, row, *PRICE_ROW)
