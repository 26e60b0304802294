"""The inverted index in files against BM25 over the texts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval as R
from marlstone.plans import registry
from marlstone.sources import index

DATA = "/root/testdata/sf0.001"
DOCS = [(i, " ".join(f"w{i * j % 17}" for j in range(1, i % 9 + 3)) + f" only{i} common") for i in range(40)] + [(40, None), (41, ""), (None, "no id common")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(df):
    return {(r.qid, r.id): r.score for r in df.collect()}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "common w3 only7"), (2, "w1 w1 w5"), (3, "unheard"), (4, None)], "item_id long, text string")


def files(folder, part):
    return set(glob.glob(f"{folder}/{part}/*/*/*.parquet"))


def test_index_in_increments_equals_bm25(spark, asked, tmp_path):
    folder = str(tmp_path / "i")
    index.add(docs(spark, DOCS[:15]), folder)
    index.add(docs(spark, DOCS[10:]), folder)
    want = scores(R.bm25(docs(spark, DOCS[:42]), asked))
    assert scores(index.answer(spark, folder, asked)) == pytest.approx(want) and len(want) > 40
    assert index.documents(spark, folder).count() == 42
    assert index.add(docs(spark, DOCS + [(3, "another text of a known id")]), folder) == []
    assert scores(index.answer(spark, folder, asked)) == pytest.approx(want)


def test_an_increment_writes_its_own_buckets(spark, tmp_path):
    folder = str(tmp_path / "i")
    index.add(docs(spark, DOCS), folder)
    before = {part: files(folder, part) for part in ("postings", "terms")}
    touched = index.add(docs(spark, [(900, "common rareword")]), folder)
    assert 1 <= len(touched) <= 2
    for part, old in before.items():
        new = files(folder, part)
        own = {f"bucket={b}" for b in [*touched, index.DOCUMENTS]}
        assert old <= new and {os.path.basename(os.path.dirname(p)) for p in new - old} <= own


def test_an_increment_that_was_cut_off_is_made_up_for(spark, asked, tmp_path, monkeypatch):
    folder = str(tmp_path / "i")
    index.add(docs(spark, DOCS[:20]), folder)
    first = scores(index.answer(spark, folder, asked))

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", dies)
        with pytest.raises(RuntimeError):
            index.add(docs(spark, DOCS), folder)
    assert scores(index.answer(spark, folder, asked)) == first and index.documents(spark, folder).count() == 20
    index.add(docs(spark, DOCS), folder)
    assert scores(index.answer(spark, folder, asked)) == pytest.approx(scores(R.bm25(docs(spark, DOCS[:42]), asked)))


def test_terms_by_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in index.with_runs(df, "t").select("r").collect()] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    folder = str(tmp_path / "i")
    index.add(docs(spark, DOCS), folder)
    one = index.answer(spark, folder, spark.createDataFrame([(1, "common")], "item_id long, text string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    read = {r[0].split("/")[-2] for r in index._postings(spark, folder, 0).where(F.col("bucket").isin([index_bucket(spark, "common")])).select(F.input_file_name()).distinct().collect()}
    assert read == {f"bucket={index_bucket(spark, 'common')}"} and one.count() == 40


def index_bucket(spark, term):
    return spark.range(1).select(index.bucket_of(F.lit(term))).first()[0]


def test_price_rows_are_found_by_their_fields(spark):
    rows = [("pricing_row", "text", "Basic", "", None), ("faq", "text", "Basic", "x", "y")]
    df = spark.createDataFrame(rows, "kind string, content string, a string, b string, c string")
    got = [r[0] for r in df.select(index.searchable(F.col("content"), F.col("kind"), F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["text\nBasic\n" + index.PRICE_ROW_WORDS, "text"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_index_equals_bm25(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    want = R.ranked(R.bm25(read("documents"), read("benchmark")), 20)
    got = registry.QUERIES["bm25_stored"](spark, DATA)
    key = lambda df: sorted((r.qid, r.rank, r.id, round(r.score, 5)) for r in df.collect())
    assert key(got) == key(want)
