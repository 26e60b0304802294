"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T


def text_pages(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """Whole text files: the `URL:` line, the body after a rule of ===, cleaned; short ones dropped."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("v"))
    body = F.when(F.col("v").rlike(r"(?m)^={3,}\s*$"), F.regexp_extract("v", r"(?ms)^={3,}\s*$(.*)", 1)).otherwise(F.regexp_replace("v", r"(?m)^(URL|Title|Date):.*$", ""))
    out = d.select("file_name", F.regexp_extract("v", r"(?m)^URL:\s*(\S+)", 1).alias("source_url"), T.parser_clean(body).alias("page_content"))
    return out.where(F.length("page_content") >= least)


def markdown_pages(spark: SparkSession, path: str, least: int = 80, url_label: str = "Source") -> DataFrame:
    """Markdown exports: the title is the first line, the url follows a label."""
    d = spark.read.text(path, wholetext=True)
    out = d.select(F.regexp_replace(F.element_at(F.split("value", "\n"), 1), r"^#+\s*", "").alias("title"), F.regexp_extract("value", rf"(?m)^{url_label}:\s*(\S+)", 1).alias("source_url"), T.clean(F.col("value")).alias("page_content"))
    return out.where(F.length("page_content") >= least)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def manifest(docs: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) counts by each column, in one pass over the data."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return docs.select(parts.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
