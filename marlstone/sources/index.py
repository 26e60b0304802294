"""An inverted index in files: built once, added to by increments, read for the terms that are asked for.

Each increment is a generation: below `postings/gen=` are (term, id, tf, dl) and below `terms/gen=` (term, df), both in
directories by a hash of the term. An increment takes the documents whose ids aren't there yet and writes its own
generation only, in the buckets its terms fall in; nothing that is there is read again but ids and the terms' counts, and
nothing is rewritten. `statistics` (one row) is written last and names the last generation that counts, so an increment
that was cut off leaves nothing to be seen and is overwritten when it runs again. A query's terms decide which
directories are read. A frequent term's postings are spread over several files.

The rows of bucket -1 are the documents (id, dl). Documents without id can't be ranked and aren't indexed; of several
texts of an id one increment takes the smallest; a null text has no terms and counts as a document of length 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import retrieval as R
from marlstone.streaming.folders import exists

BUCKETS, SPREAD, DOCUMENTS = 64, 8, -1
#: Fixed words that are indexed with each price row.
PRICE_ROW_WORDS = "pricing_row poplatek cena vedení účtu vedeni uctu"


def searchable(content: Column, chunk_type: Column, *fields: Column) -> Column:
    """The text to index: of a price row also its product, fee, value and type, those that are there, and the fixed words."""
    more = F.concat_ws("\n", content, *(F.when(f != "", f) for f in fields), F.lit(PRICE_ROW_WORDS))
    return F.when(chunk_type == "pricing_row", more).otherwise(content)


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _statistics(spark: SparkSession, folder: str):
    """The row (gen, n, avgdl, mean), or None before the first increment."""
    if not exists(spark, f"{folder}/statistics"):
        return None
    return spark.read.schema("gen int, n long, avgdl double, mean double").parquet(f"{folder}/statistics").first()


def _read(spark: SparkSession, folder: str, part: str, schema: str, gen: int) -> DataFrame:
    return spark.read.schema(f"{schema}, gen int, bucket int").parquet(f"{folder}/{part}").where(F.col("gen") <= gen)


def _postings(spark: SparkSession, folder: str, gen: int) -> DataFrame:
    return _read(spark, folder, "postings", "term string, id long, tf int, dl int", gen)


def _terms(spark: SparkSession, folder: str, gen: int) -> DataFrame:
    return _read(spark, folder, "terms", "term string, df long", gen)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, dl) of the documents that the index has."""
    s = _statistics(spark, folder)
    if s is None:
        return spark.createDataFrame([], "id long, dl int")
    return _postings(spark, folder, s.gen).where(F.col("bucket") == DOCUMENTS).select("id", "dl")


def with_runs(d: DataFrame, tokens: str) -> DataFrame:
    """d with `r`, an array of (term, tf) for each term of a row's tokens, and `dl`, their number, instead of the tokens: by
    runs of the sorted tokens, so nothing is shuffled. Each step is a column of its own, as a lambda would compute it anew."""
    rest = [c for c in d.columns if c != tokens]
    d = d.select(*rest, F.array_sort(tokens).alias("_s")).withColumn("dl", F.size("_s"))
    at = lambda i: F.element_at("_s", i)
    some = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
    d = d.withColumn("_at", F.when(F.col("dl") > 0, some).otherwise(F.array().cast("array<int>")))
    each = F.transform("_at", lambda i, k: F.struct(at(i).alias("term"), (F.coalesce(F.get("_at", k + 1), F.col("dl") + 1) - i).cast("int").alias("tf")))
    return d.select(*rest, "dl", each.alias("r"))


def add(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Adds the documents whose ids the index doesn't have; returns the buckets that got postings."""
    spark = docs.sparkSession
    s = _statistics(spark, folder)
    gen = 0 if s is None else s.gen + 1
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    if s is not None:
        d = d.join(documents(spark, folder), "id", "left_anti")
    d = d.groupBy("id").agg(F.min("text").alias("text")) if d.groupBy("id").count().where("count > 1").limit(1).count() else d
    t = with_runs(d.select("id", T.index_tokens(F.col("text")).alias("t")), "t")
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    rows = t.select("id", "dl", F.inline(F.concat(own, "r"))).select("term", "id", "tf", "dl", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(bucket_of(F.col("term"), buckets)).alias("bucket"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/gen={gen}")
    new = _postings(spark, folder, gen).where((F.col("gen") == gen) & (F.col("bucket") != DOCUMENTS))
    df = new.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.select("term", "df", "bucket").repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms/gen={gen}")
    _commit(spark, folder, gen)
    return sorted(r[0] for r in _terms(spark, folder, gen).where(F.col("gen") == gen).select("bucket").distinct().collect())  # at most as many as buckets


def _commit(spark: SparkSession, folder: str, gen: int) -> None:
    """Writes the statistics up to gen: documents, their mean length, and the mean of the terms' raw idf."""
    n = _postings(spark, folder, gen).where(F.col("bucket") == DOCUMENTS).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = _terms(spark, folder, gen).groupBy("term").agg(F.sum("df").alias("df"))
    mean = df.crossJoin(F.broadcast(n)).agg(F.avg(_raw(F.col("n"), F.col("df"))).alias("mean"))
    n.crossJoin(F.broadcast(mean)).select(F.lit(gen).alias("gen"), "n", "avgdl", "mean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/statistics")


def _raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def answer(spark: SparkSession, folder: str, queries: DataFrame, q_id: str = "item_id", q_text: str = "text", buckets: int = BUCKETS, best: int | None = None) -> DataFrame:
    """(qid, id, score) like retrieval.bm25, from the index; reads the directories of the queries' terms only."""
    s = _statistics(spark, folder)
    asked = R.query_terms(queries, q_id, q_text).withColumn("bucket", bucket_of(F.col("term"), buckets))
    need = F.col("bucket").isin([r[0] for r in asked.select("bucket").distinct().collect()])
    few = asked.limit(R.MOST_TERMS + 1).count() <= R.MOST_TERMS
    light = F.broadcast if few else lambda x: x
    names = light(asked.select("term").distinct())
    df = _terms(spark, folder, s.gen).where(need).join(names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    raw = _raw(F.lit(s.n), F.col("df"))
    idf = F.when(raw < 0, F.lit(R.FLOOR) * F.lit(s.mean)).otherwise(raw)
    terms = asked.join(df, "term").select(F.lit(0).alias("list"), "qid", "term", (F.col("qtf") * idf).alias("weight"), F.lit(s.avgdl).alias("avgdl"))
    # dealt by document before the queries multiply them, which is the partitioning that the sums need
    hit = _postings(spark, folder, s.gen).where(need).join(names, "term", "left_semi").select("term", "id", "tf", "dl").repartition("id")
    return R.hits_scored(hit, terms, "tf", best).drop("list")
