"""Tables in texts: markdown to rows and back, and tests of table rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.pricing import has_any

# Words and patterns of the tariffs' tables.
NAV_PHRASES = ("účty a karty", "půjčky", "spoření a investice", "osobní finance", "privátní bankovnictví")
SPACED = (r"\bp\s+r\s+o\s+v\b", r"\bU\s+S\s+D\b", r"\bz\s+V\s+e\s+c\s+h\s+n\b", r"\b[zv]\s+[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽa-záčďéěíňóřšťúůýž](?:\s+[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽa-záčďéěíňóřšťúůýž]){2,}\b")
PRICING_TERMS = ("sazebník", "sazebnik", "ceník", "cenik", "fee", "price", "poplatek", "poplatky", "kč", "czk", "zdarma", "měsíčně", "mesicne", "ročně", "rocne", "sazba", "rpsn")
TABLE_TERMS = (*PRICING_TERMS, "vedení účtu", "vedeni uctu", "produkt", "účet", "ucet", "tarif")
PRODUCT_HEADS = ("produkt", "účet", "ucet", "program", "tarif", "název", "nazev")
FEE_HEADS = ("vedení", "vedeni", "poplatek", "cena", "frekvence", "výběr", "vyber")
FOOTNOTE = r"^\s*[\d]+\)\s*|^Pozn[.:]|^Poznámka"
ALIASES = "Search aliases: eKonto ekonto ekonta vedení účtu vedeni uctu poplatek cena"
_EDGE = r"^[.,;:()\[\]{}|]+|[.,;:()\[\]{}|]+$"
_BLANK = r"[ \t\n\x0b\f\r]+"


def single_share(x: Column, most: int | None = None) -> tuple[Column, Column]:
    """The number of words, and the share of those with one character between marks."""
    w = F.filter(F.split(F.substring(x, 1, most) if most else x, _BLANK), lambda t: t != "")
    single = F.filter(w, lambda t: F.length(F.regexp_replace(t, _EDGE, "")) == 1)
    return F.size(w), F.size(single) / F.greatest(F.size(w), F.lit(1))


def chunk_label(x: Column) -> Column:
    """navigation_boilerplate, bad_pdf_extraction or ok; the second is judged on the first 2500 characters, as defined."""
    low = F.lower(x)
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in NAV_PHRASES), F.lit(0))
    n, share = single_share(x, 2500)
    spaced = F.lit(False)
    for p in SPACED:
        spaced = spaced | F.substring(x, 1, 2500).rlike(p)
    return F.when((hits >= 3) & (F.length(x) < 500), "navigation_boilerplate").when((n >= 20) & ((share > 0.33) | spaced), "bad_pdf_extraction").otherwise("ok")


def bad_table_row(x: Column) -> Column:
    n, share = single_share(x, 1200)
    return (chunk_label(x) != "ok") | ((n >= 6) & (share > 0.28))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def _padded(line: str) -> Column:
    width = F.size("headers")
    return F.slice(F.concat(_cells(F.col(line)), F.array_repeat(F.lit(""), width)), F.lit(1), width)


def _lines(x: Column) -> Column:
    """The trimmed lines that have a bar; one character to split at spares a search by pattern."""
    plain = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.transform(F.filter(F.split(plain, "\n"), lambda s: F.contains(s, F.lit("|"))), lambda s: F.trim(s))


def markdown_lines(tables: DataFrame, markdown: str) -> DataFrame:
    """One row for each line of a markdown table after its first two, with `head` (the first line), `row_index` and `line`.
    Lines of rules are left out; a text with fewer than three lines that have a bar gives no row. The other columns stay,
    but for the markdown."""
    rest = [c for c in tables.columns if c != markdown]
    # a generator's row, so that the lines are found once and not again in the filter
    d = tables.select(*rest, F.explode(F.array(_lines(F.col(markdown)))).alias("_lines")).where(F.size("_lines") >= 3)
    body = F.filter(F.slice("_lines", F.lit(3), F.size("_lines") - 2), lambda s: ~s.rlike(r"^[:\-\s|]+$"))
    return d.select(*rest, F.get("_lines", F.lit(0)).alias("head"), F.posexplode(body).alias("row_index", "line"))


def line_cells(lines: DataFrame) -> DataFrame:
    """head and line with `headers` (the head's cells) and `cells`, padded or cut to the headers' number."""
    return lines.select("head", "line", _cells(F.col("head")).alias("headers")).select("*", _padded("line").alias("cells"))


def markdown_cells(tables: DataFrame, markdown: str) -> DataFrame:
    """markdown_lines with headers and cells in place of head and line, each line by itself."""
    d = markdown_lines(tables, markdown)
    rest = [c for c in d.columns if c not in ("head", "line", "row_index")]
    return d.select(*rest, _cells(F.col("head")).alias("headers"), "row_index", "line").select(*rest, "headers", "row_index", _padded("line").alias("cells"))


def filled(row: Column) -> Column:
    """A row whose only value stands beside nulls (a merged cell) has it in their places."""
    solid = F.filter(row, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    return F.when((F.size(solid) == 1) & F.exists(row, lambda c: c.isNull()), F.transform(row, lambda c: F.coalesce(c, F.get(solid, F.lit(0))))).otherwise(row)


def table_markdown(rows: Column) -> Column:
    """Rows of cells as markdown: the first is the header. Empty rows and page feet go, rows with one value throughout
    stand alone, and footnotes follow the table. Empty without a header."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), " | ")
    plain = F.transform(rows, filled)
    head = F.get(plain, F.lit(0))
    solid = lambda r: F.filter(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    body = F.filter(F.slice(plain, F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0))), lambda r: (F.size(solid(r)) > 0) & ~F.exists(solid(r), lambda c: c.rlike(r"(?i)^www\.")))
    foot = lambda r: F.trim(F.coalesce(F.get(r, F.lit(0)), F.lit(""))).rlike(FOOTNOTE)
    shown = F.transform(F.filter(body, lambda r: ~foot(r)), lambda r: F.when((F.size(solid(r)) > 1) & (F.size(F.array_distinct(solid(r))) == 1), F.get(solid(r), F.lit(0))).otherwise(line(r)))
    notes = F.transform(F.filter(body, foot), lambda r: F.trim(F.replace(F.get(r, F.lit(0)), F.lit("\n"), F.lit(" "))))
    rule = F.array_join(F.transform(head, lambda c: F.lit("---")), " | ")
    out = F.array_join(F.concat(F.array(line(head), rule), shown), "\n")
    return F.when(F.size(solid(head)) == 0, "").otherwise(F.when(F.size(notes) > 0, F.concat(out, F.lit("\n\n"), F.array_join(notes, "\n"))).otherwise(out))


def is_pricing_text(x: Column) -> Column:
    return has_any(F.lower(x), TABLE_TERMS)


def row_fields(headers: Column, cells: Column) -> Column:
    """struct(product_name, fee_type, fee_value) of a table row, by its headers."""
    pairs = F.filter(F.transform(F.arrays_zip(headers.alias("h"), cells.alias("c")), lambda p: F.struct(F.trim(p["h"]).alias("h"), F.trim(p["c"]).alias("c"))), lambda p: (p["h"] != "") | (p["c"] != ""))
    priced = lambda c: F.lower(c).rlike(r"kč|zdarma|\b\d+[,.]?\d*\s*(?:czk|%)")
    first = lambda test, part: F.get(F.filter(pairs, test), F.lit(0))[part]
    product = F.coalesce(F.nullif(first(lambda p: has_any(F.lower(p["h"]), PRODUCT_HEADS) & (p["c"] != ""), "c"), F.lit("")), F.trim(F.get(cells, F.lit(0))), F.lit(""))
    fee = F.coalesce(first(lambda p: has_any(F.lower(p["h"]), FEE_HEADS), "h"), first(lambda p: has_any(F.lower(p["c"]), ("kč", "zdarma")), "h"), F.lit(""))
    return F.struct(product.alias("product_name"), fee.alias("fee_type"), F.coalesce(first(lambda p: priced(p["c"]), "c"), F.lit("")).alias("fee_value"))


def row_text(title: Column, section: Column, url: Column, headers: Column, cells: Column) -> Column:
    """A table row as a text of its own: where it is from, then a line for each cell with its header."""
    pairs = F.filter(F.arrays_zip(headers.alias("h"), cells.alias("c")), lambda p: (F.trim(p["h"]) != "") | (F.trim(p["c"]) != ""))
    lines = F.transform(pairs, lambda p: F.concat(F.coalesce(F.nullif(F.trim(p["h"]), F.lit("")), F.lit("Sloupec")), F.lit(": "), F.trim(p["c"])))
    top = F.array(F.concat(F.lit("Table: "), F.coalesce(F.nullif(title, F.lit("")), section)), F.concat(F.lit("Sekce: "), section), F.concat(F.lit("Zdroj: "), url), F.lit(""))
    more = F.when(F.contains(F.lower(F.array_join(cells, " ")), F.lit("ekonto")), F.array(F.lit(ALIASES))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, lines, more), "\n")
