"""Operators: invariants, folds against plain Python, streams against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunk, dedup, governance, retrieval
from marlstone.sources import files, html
from marlstone.streaming import keyed, state


def test_recursive_split_bounds_and_coverage():
    text = "First para here.\n\nSecond one is longer. It has two sentences.\n" + "x" * 130
    parts = chunk.recursive_split(text, 50, 10)
    assert all(0 < len(p) <= 50 for p in parts)
    assert all(w in " ".join(parts) for w in text.split() if len(w) < 50)
    assert chunk.recursive_split("", 50, 10) == [] and chunk.recursive_split("short", 50, 10) == ["short"]


def test_table_split_repeats_header():
    t = "|a|b|\n|-|-|\n" + "\n".join(f"|{i}|{'y' * 20}|" for i in range(10))
    parts = chunk.table_split(t, 80)
    assert all(p.startswith("|a|b|\n|-|-|") and len(p) <= 80 for p in parts)
    assert sum(p.count("y" * 20) for p in parts) == 10


def test_first_of_and_upsert(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "i int, k string")
    assert sorted(r["i"] for r in dedup.first_of(df, "k", "i").collect()) == [1, 3]
    new = spark.createDataFrame([(1, "z")], "i int, k string")
    assert sorted(map(tuple, dedup.upsert(df, new, "i").collect())) == [(1, "z"), (2, "a"), (3, "b")]


def test_guard_keeps_everything_if_nothing_would_be_left(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "qid int, v string")
    assert sorted(map(tuple, retrieval.guarded(df, F.col("v") == "x").collect())) == [(1, "x"), (2, "y")]


def test_diversity_never_skips_below_the_least(spark):
    df = spark.createDataFrame([(1, r, r, "d", "f") for r in range(1, 7)], "qid int, rank int, id int, document string, family string")
    assert [r["rank"] for r in governance.diversified(df).orderBy("rank").collect()] == [1, 2, 3]


def test_html_page():
    p = html.parse("<html><head><title>T</title><link rel='canonical' href='/c'></head><body><nav>skip</nav><h1>Head</h1><p>body<h2>Sub</h2>more<table><tr><th>a<th>b<tr><td>1</table><details><summary>Q?</summary>A.</details><a href='/x'>l</a></body>")
    assert p["title"] == "Head" and p["canonical"] == "/c" and p["links"] == ["/x"]
    assert [s["heading"] for s in p["sections"]] == ["Head", "Sub"]
    assert p["tables"] == [[["a", "b"], ["1", ""]]]
    assert p["faq"][0]["question"] == "Q?"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("URL: http://x/a\n=====\n" + "word " * 30)
    (tmp_path / "b.txt").write_text("URL: http://x/b\n=====\nshort")
    assert [r["source_url"] for r in files.text_pages(spark, str(tmp_path / "*.txt")).collect()] == ["http://x/a"]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_rows(spark, str(tmp_path / "rows.jsonl"), "a int").collect()) == [1, 2]


def test_markdown_and_seeds(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Heading\nSource: http://x/a\n" + "word " * 30)
    (tmp_path / "b.md").write_text("# Short\n")
    got = files.markdown_pages(spark, str(tmp_path / "*.md")).collect()
    assert [(r.title, r.source_url) for r in got] == [("Heading", "http://x/a")]
    (tmp_path / "seeds.txt").write_text("# comment\nhttp://x/a\n\n http://x/b \n")
    assert sorted(r.url for r in files.seed_urls(spark, str(tmp_path / "seeds.txt")).collect()) == ["http://x/a", "http://x/b"]


def test_batches_by_budget(spark):
    df = spark.createDataFrame([([5, 5, 5, 20, 1, 1, 1, 1],), ([],)], "s array<long>")
    assert [r[0] for r in df.select(chunk.batches_by_budget(F.col("s"), 10, 3)).collect()] == [[0, 0, 1, 2, 3, 3, 3, 4], []]


@pytest.fixture
def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=10 * i), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")


def test_rate_limit_ignores_rejected(events):
    got = {r["event_id"]: r["allowed"] for r in keyed.folded(events, keyed.RateLimit(2, 60), "user_id", "event_id", "allowed").collect()}
    held = {0: [], 1: []}
    for i in range(40):
        h = held[i % 2] = [x for x in held[i % 2] if x >= 10 * i - 60]
        assert got[i] == (len(h) < 2)
        if len(h) < 2:
            h.append(10 * i)


def test_ttl_hits_do_not_extend(events):
    got = {r["event_id"]: r["hit"] for r in keyed.folded(events, keyed.RouteCache(), "user_id", "event_id", "hit", F.lit(50).cast("long")).collect()}
    assert [got[i] for i in range(0, 16, 2)] == [False, True, True, False, True, True, False, True]


def test_stream_equals_batch(spark, events, tmp_path):
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    s = state.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long", 1)
    q = state.append_sink(state.telemetry(state.first_in_flight(s, ["event_id"], wait="1 day")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_bm25_deals_texts_and_no_postings(spark):
    from marlstone.operators import retrieval as R

    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (2, "b c"), (3, None), (None, "a a"), (4, "d d a"), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "b a"), (11, "z"), (12, "d b b")], "item_id long, text string")
    scored = R.bm25(docs, asked)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(id#" in x for x in dealt) and not any("hashpartitioning(qid#" in x and ", id#" in x or "hashpartitioning(term#" in x and ", id#" in x for x in dealt)
    got = {(r.qid, r.id): r.score for r in scored.collect()}
    assert set(got) == {(10, 1), (10, 2), (10, None), (10, 4), (12, 1), (12, 2), (12, 4)}
    full = {(r.qid, r.id): r.score for r in R.padded(scored, docs, asked, 4).collect()}
    assert full == {(q, i): 0.0 for q in (10, 11, 12) for i in (1, 2, 3)} | got


def test_corpus_terms_count_documents_and_lengths(spark):
    from marlstone.operators import retrieval as R

    got = {r.term: (r.df, r.dl) for r in R.corpus_terms(spark.createDataFrame([("a b b",), (None,), ("",), ("b",)], "text string"), "text").collect()}
    assert got == {None: (4, 4), "a": (1, 0), "b": (2, 0)}
