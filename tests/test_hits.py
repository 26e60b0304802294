"""BM25's sums by arrays in tasks against the sums by joins."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sums", [8, 1 << 21])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_arrays_and_joins_agree(spark, monkeypatch, sums, kind):
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9 + i % 7)) + (" , w1 w1." if i % 3 else "")) for i in range(300)]
    texts += [(7, "w2 w3 again"), (7, "w2 w3 w3"), (None, "w1 w4"), (None, "?w1 w5 "), (301, None), (302, ""), (303, "--")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 5} w{(q * 3) % 20} w{q}") for q in range(12)] + [(50, "absent"), (51, None)], "item_id long, text string")
    monkeypatch.setattr(R, "SUMS", sums)
    got, lists = rows(R.bm25(docs, asked)), rows(R.bm25_lists(docs, asked, (None, 2)))
    top = rows(R.ranked(R.bm25(docs, asked, best=4), 4))
    assert len(got) > 1000 and len(top) == 48
    plan = R.bm25(docs, asked)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # hits are multiplied by their queries in arrays, not in rows
    monkeypatch.setattr(R, "MOST_TERMS", 0)
    assert got == rows(R.bm25(docs, asked)) and lists == rows(R.bm25_lists(docs, asked, (None, 2))) and top == rows(R.ranked(R.bm25(docs, asked), 4))
    assert not R.bm25(docs.limit(0), asked).count() and not R.bm25(docs, asked.limit(0)).count()


def test_cosine_by_matrices_and_by_joins_agree(spark, monkeypatch):
    vectors = [(i, [float((i * (j + 3)) % 17 - 8) + 0.5 for j in range(6)]) for i in range(400)]
    vectors += [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [1.0, 2.0]), (3, [2.0] * 6), (None, [1.0] * 6), (450, [float("nan")] * 6)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 50 = 0")
    got = R.cosine_topk(v, q, 5)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(R, "MOST_VECTORS", 0)
    assert repr(rows(got)) == repr(rows(R.cosine_topk(v, q, 5))) and got.count() == 50  # by repr, as NaN differs from itself


@pytest.mark.parametrize("most", [3, 4, 100])
def test_cosine_of_many_queries_shuffles_no_vectors(spark, monkeypatch, most):
    """Queries beyond a broadcast's worth go to the vectors block by block; no vector is copied to meet them."""
    vectors = [(i, [float((i * (j + 3)) % 17 - 8) + 0.5 for j in range(6)]) for i in range(400)] + [(3, [2.0] * 6), (250, [1.0] * 6), (401, [1.0, 2.0])]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 50 = 0")
    want = rows(R.cosine_topk(v, q, 5))
    monkeypatch.setattr(R, "MOST_VECTORS", most)
    got = R.cosine_topk(v, q, 5)
    assert rows(got) == want and len(want) == 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert most > 9 or "Generate" not in plan and "Join" not in plan  # only the blocks' best are left to rank
    blocks = [b.count() for b in R._blocks(q, most)]
    assert sum(blocks) == 9 and max(blocks) <= most and all(n == most for n in blocks[:-1])


def test_tokens_are_never_rows_and_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "c b")], "item_id long, text string")
    for d in (R.bm25(docs, asked), R.corpus_terms(docs, "text")):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan
    assert [tuple(r) for r in R.bm25(docs, asked).select("qid", "id").sort("id").collect()] == [(1, 1), (1, 2)]


@pytest.mark.parametrize("tokens, rows", [(3, 1), (50, 7), (1 << 22, 2048)])
def test_counting_in_slices(monkeypatch, tokens, rows):
    import pyarrow as pa

    monkeypatch.setattr(R, "TOKENS", tokens)
    monkeypatch.setattr(R, "ROWS", rows)
    lists = [None if i % 11 == 4 else [""] if i % 7 == 3 else ["", *(f"w{(i * k) % 9}" for k in range(1, 1 + i % 6)), ""] for i in range(60)]
    lists[9] = []
    got, n = {}, 0
    for b in R._counted(iter([pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.string()))], names=["t"]) for x in (lists[:25], lists[25:], [])])):
        n += 1
        for term, df, dl in zip(*(c.to_pylist() for c in b.columns)):
            a = got.setdefault(term, [0, 0])
            a[0] += df
            a[1] += dl
    words = [[w for w in x or [] if w] for x in lists]
    want = {w: [sum(w in x for x in words), 0] for w in {w for x in words for w in x}} | {None: [len(words), sum(map(len, words))]}
    assert got == want and n >= 2
    hits = sorted(((i % 13 or None), i % 3, [1, 4, i % 4 + 5], [1, 2, i]) for i in range(1, 60) if i % 13) + [(None, 2, [7], [3]), (None, 2, [7], [4])]
    want = {}
    for i, dl, no, tf in hits:
        for a, b in zip(no, tf):
            want[i, dl, a] = want.get((i, dl, a), 0) + b
    arrays = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
    b = pa.RecordBatch.from_arrays(arrays, names=["id", "dl", "no", "tf"])
    out = [r for x in R._unlisted(iter([b.slice(0, 20), b.slice(20)])) for r in zip(*(c.to_pylist() for c in x.columns))]
    assert len(out) == len(want) and {r[:3]: r[3] for r in out} == want
