"""Streams against their batch folds and plain Python, with restarts in the middle."""

import datetime as dt
import os
import random

import pytest

from marlstone.plans import registry
from marlstone.streaming import ingest, keyed

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, route string"
ROUTES = [*keyed.ROUTE_SECONDS, "unheard", None]


def rows(n=600, seed=3):
    rnd = random.Random(seed)
    out = [(i, T0 + dt.timedelta(seconds=rnd.randrange(0, 40_000) // 20 * 20), rnd.choice([None, *range(5), 0, 0, 0]), rnd.choice(ROUTES)) for i in range(n)]
    return [*out, (n, None, 1, "pricing")]


def files_of(spark, data, folder, k=6):
    """k files whose times overlap, in an order of their own."""
    data = sorted(data, key=lambda r: (r[1] or T0, r[0]))
    step = -(-len(data) // k)
    for j in range(k):
        part = data[j * step : (j + 1) * step]
        random.Random(j).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain_limit(data, limit, seconds):
    held, out = {}, {}
    for i, t, u, _ in sorted((r for r in data if r[1]), key=lambda r: (r[1], r[0])):
        h = [x for x in held.get(u, []) if (t - x).total_seconds() <= seconds]
        out[i] = len(h) < limit
        held[u] = [*h, t] if out[i] else h
    return out


def plain_cache(data):
    kept, out = {}, {}
    for i, t, u, route in sorted((r for r in data if r[1]), key=lambda r: (r[1], r[0])):
        seconds = keyed.ROUTE_SECONDS.get(route, 0)
        out[i] = bool(seconds) and u in kept and t <= kept[u]
        if seconds and not out[i]:
            kept[u] = t + dt.timedelta(seconds=seconds)
    return out


def test_batch_folds_equal_plain_ones(spark):
    data = rows()
    events = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = keyed.folded(events, keyed.RateLimit(3, 2000), "user_id", "event_id", "allowed").collect()
    assert {r.event_id: r.allowed for r in got} == plain_limit(data, 3, 2000) and len(got) == 600
    got = keyed.folded(events, keyed.RouteCache(), "user_id", "event_id", "hit", keyed.seconds_of(events.route)).collect()
    want = plain_cache(data)
    assert {r.event_id: r.hit for r in got} == want and 50 < sum(want.values()) < 550


def test_limit_counts_both_ends(spark):
    data = [(0, T0, 1, None), (1, T0 + dt.timedelta(seconds=60), 1, None), (2, T0 + dt.timedelta(seconds=61), 1, None)]
    got = keyed.folded(spark.createDataFrame(data, SCHEMA), keyed.RateLimit(1, 60), "user_id", "event_id", "allowed").orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, False, True]


def test_stream_of_the_limit_equals_the_batch(spark, tmp_path):
    data = rows()
    files_of(spark, data, str(tmp_path / "in"))
    folder = keyed.answer_files(spark, str(tmp_path / "in"), SCHEMA, keyed.RateLimit(3, 2000), "user_id", "event_id", "allowed", files=1, folder=str(tmp_path / "out"))
    got = keyed.answers(spark, folder, "user_id long, event_id long, allowed boolean").collect()
    assert len(got) == 600 and {r.event_id: r.allowed for r in got} == plain_limit(data, 3, 2000)


def test_stream_of_the_cache_survives_a_restart(spark, tmp_path):
    from pyspark.sql import functions as F

    data = sorted(rows(), key=lambda r: (r[1] or T0, r[0]))
    cut = lambda a, b: files_of(spark, data[a:b], str(tmp_path / "in"), 2)
    go = lambda ended: keyed.answer_files(spark, str(tmp_path / "in"), SCHEMA, keyed.RouteCache(), "user_id", "event_id", "hit", keyed.seconds_of(F.col("route")), delay="1 hour", files=1, folder=str(tmp_path / "out"), ended=ended)
    cut(0, 300)
    folder = go(False)
    part = keyed.answers(spark, folder, "user_id long, event_id long, hit boolean").count()
    assert 0 < part < 300  # those of the last hour wait
    cut(300, 601)
    go(True)
    got = keyed.answers(spark, folder, "user_id long, event_id long, hit boolean").collect()
    assert len(got) == 600 and {r.event_id: r.hit for r in got} == plain_cache(data)


@pytest.mark.parametrize("rule", [keyed.RateLimit(2, 100), keyed.RouteCache()])
def test_state_without_effect(rule):
    """What a rule holds answers nothing differently after until()."""
    held, _ = rule.answer([], 1_000_000, 50)
    late = rule.until(held) + 1
    assert rule.answer(held, late, 50) == rule.answer([], late, 50)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("stream", "batch"), [("rate_limit_stream", "rate_limit_fold"), ("response_cache_stream", "response_cache")])
def test_registered_streams_equal_their_batch_queries(spark, stream, batch):
    got, want = (sorted(tuple(sorted(r.asDict().items())) for r in registry.QUERIES[x](spark, DATA).collect()) for x in (stream, batch))
    assert got == want and len(got) == spark.read.parquet(f"{DATA}/events.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_ingest_has_every_chunk_once(spark):
    got = [r.chunk_id for r in registry.QUERIES["lazy_ingest"](spark, DATA).collect()]
    want = ingest.document_chunks(spark.read.parquet(f"{DATA}/documents.parquet")).select("chunk_id").distinct().collect()
    assert len(got) == len(set(got)) and set(got) == {r.chunk_id for r in want}
