"""Crawled pages: nested JSON to chunks, links to documents, site maps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from marlstone.functions import tables as B
from marlstone.functions import text as T
from marlstone.operators import crawl, split

#: A crawled page. Larger files are media exports and are passed over.
PAGE = (
    "url string, title string, content string, sections array<struct<heading string, content string>>, faq array<struct<question string, answer string, section_title string>>, "
    "tables array<struct<caption string, section_title string, markdown string>>, cards array<struct<title string, content string>>, metadata struct<category string, document_type string>"
)
LARGEST = 5 << 20
#: Fewest characters of an entry of each kind, more than which it has to have.
FAQ_LEAST, TABLE_LEAST, CARD_LEAST = 30, 20, 50
SIZE, OVERLAP = 1100, 150


def json_pages(spark: SparkSession, path: str, most: int = LARGEST) -> DataFrame:
    """Pages of JSON files, one in each, with file_name; files that are too large or aren't JSON are left out."""
    d = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= most)
    d = d.select(F.col("_metadata.file_name").alias("file_name"), F.from_json("value", PAGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    return d.where(F.col("p").isNotNull() & F.col("p._bad").isNull()).select("file_name", "p.*").drop("_bad")


def _or(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def _entries(pages: DataFrame) -> DataFrame:
    """A row for each section, question, table and card of a page, numbered in that order over the page."""
    pages, title = pages.withColumn("title", _or(F.col("title"), F.col("url"))), F.col("title")
    made = F.array(F.struct(title.alias("heading"), F.col("content")))
    some = F.when(F.size(F.coalesce("sections", F.array())) > 0, F.col("sections")).when(T.clean(_or(F.col("content"))) != "", made).otherwise(F.array().cast("array<struct<heading:string,content:string>>"))
    kind = _or(F.col("metadata.document_type"), F.lit("product_page"))

    def each(xs: Column, name: str, section, content, least: int, document_type: Column) -> Column:
        row = lambda x: F.struct(F.lit(name).alias("chunk_type"), _or(section(x), title).alias("section_title"), F.coalesce(content(x), F.lit("")).alias("content"), document_type.alias("document_type"))
        out = F.transform(F.coalesce(xs, F.expr("cast(array() as " + dict(pages.dtypes)[{"faq": "faq", "table": "tables", "card": "cards"}.get(name, "sections")] + ")")), row)
        return F.filter(out, lambda r: F.length(T.clean(r["content"])) > least)

    faq = lambda x: F.concat(F.lit("FAQ: "), F.coalesce(x["question"], F.lit("")), F.lit("\n\nOdpověď:\n"), F.coalesce(x["answer"], F.lit("")))
    every = F.concat(
        each(some, "section", lambda x: x["heading"], lambda x: x["content"], 0, kind), each(F.col("faq"), "faq", lambda x: x["section_title"], faq, FAQ_LEAST, F.lit("faq")),
        each(F.col("tables"), "table", lambda x: _or(x["section_title"], x["caption"]), lambda x: x["markdown"], TABLE_LEAST, kind), each(F.col("cards"), "card", lambda x: x["title"], lambda x: x["content"], CARD_LEAST, kind),
    )
    return pages.select("file_name", F.col("url").alias("source_url"), "title", _or(F.col("metadata.category"), F.lit("unknown")).alias("category"), F.posexplode(every).alias("entry", "e")).select("file_name", "source_url", "title", "category", "entry", "e.*")


def _pieces(entries: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sections split into pieces of `size`, other entries whole; `piece` numbers them."""
    names = entries.columns
    text, kind = names.index("content"), names.index("chunk_type")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [(i, k, p) for i, (t, c) in enumerate(zip(b.column(kind).to_pylist(), b.column(text).to_pylist(), strict=True)) for k, p in enumerate(split.text_pieces(c, size, overlap) if t == "section" else [c])]
            row = pa.array([x[0] for x in found], pa.int64())
            columns = [c.take(row) for c in b.columns]
            columns[text] = pa.array([x[2] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in found], pa.int32())], names=[*names, "piece"])

    return entries.mapInArrow(run, P.StructType([*entries.schema.fields, P.StructField("piece", P.IntegerType())]))


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pages: sections in pieces (the page's content where there are none), questions with answers, the price rows
    of each table and the table, cards; numbered over the page in this order, with ids, and within the embedding limits."""
    entries = _entries(pages)
    whole = _pieces(entries, size, overlap).withColumn("last", F.lit(1))
    cells = B.markdown_cells(entries.where("chunk_type = 'table'"), "content")
    rows = cells.where(B.is_pricing_text(F.array_join("cells", " ")) & ~B.bad_table_row(F.array_join("cells", " ")))
    own = B.row_text(F.col("section_title"), F.col("section_title"), F.col("source_url"), F.col("headers"), F.col("cells"))
    rows = rows.select("file_name", "source_url", "title", "category", "entry", F.lit("pricing_row").alias("chunk_type"), "section_title", own.alias("content"), F.lit("pricing").alias("document_type"), F.col("row_index").cast("int").alias("piece"), F.lit(0).alias("last"))
    w = Window.partitionBy("file_name").orderBy("entry", "last", "piece")
    c = whole.unionByName(rows).withColumn("chunk_index", F.row_number().over(w) - 1)
    c = c.withColumns({"content": T.clean(F.col("content")), "chunk_type": F.when(F.col("chunk_type").isin("section", "card"), "section_text").otherwise(F.col("chunk_type")), "page": F.lit(None).cast("int")})
    c = c.withColumn("chunk_id", split.chunk_id(F.coalesce("source_url", F.lit("")), F.col("page"), F.col("chunk_type"), F.col("section_title"), F.col("chunk_index"), F.col("content")))
    return split.embed_limits(c.drop("entry", "last", "piece"))


def document_links(pages: DataFrame, keep: Column | None = None, kind: str = r"\.pdf") -> DataFrame:
    """(url, title, source_page) of the documents that pages (url, html) link to: by anchors, then by data attributes, then as
    quoted texts. An address counts once for a page; its first title stands, or else its file name. keep: a condition on
    `seen`, the address with title and page in lower case."""
    anchor = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"'>]+[\"'][^>]*>.*?</a>)"), F.lit(1)), lambda a: F.struct(F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"'>]+)", 1).alias("link"), F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"\s+", " ").alias("title")))
    bare = lambda p: F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), lambda x: F.struct(x.alias("link"), F.lit("").alias("title")))
    every = F.concat(anchor, bare(r"(?i)\b(?:data-href|data-url|data-src|data-file|href)\s*=\s*[\"']([^\"'>]+)[\"']"), bare(rf"(?i)[\"']([^\"'<>\s]+{kind}(?:\?[^\"'<>\s]*)?)[\"']"))
    d = pages.select(F.col("url").alias("source_page"), F.posexplode(every).alias("at", "x")).withColumn("url", crawl.resolved(F.col("source_page"), F.col("x.link")))
    d = d.where(F.lower(T.url_path(F.col("url"))).rlike(kind))
    d = d.groupBy("source_page", "url").agg(F.trim(F.min_by("x.title", "at")).alias("title"))
    tail = F.replace(F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))
    d = d.withColumn("title", _or(F.col("title"), tail)).withColumn("seen", F.lower(F.concat_ws(" ", "url", "title", "source_page")))
    return (d if keep is None else d.where(keep)).select("url", "title", "source_page")


def sitemap(spark: SparkSession, path: str, section: Column | None = None) -> DataFrame:
    """(url, lastmod, priority, section) of site maps, by Spark's XML reader; addresses are canonical. section: a rule on url."""
    d = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, priority string").load(path)
    u = crawl.resolved(F.trim("loc"), F.trim("loc"))
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = d.select(u.alias("url"), none("lastmod").alias("lastmod"), none("priority").alias("priority")).where("url IS NOT NULL")
    return d.withColumn("section", F.lit("general") if section is None else section)


def sitemaps_of(spark: SparkSession, path: str) -> DataFrame:
    """(url) of the site maps that an index names."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("url")).where("url <> ''")
