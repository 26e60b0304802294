"""The pipeline's stages against plain Python, on odd rows, copies and clashing columns."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("marlstone.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from marlstone.llm import packing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, rules_kept string, toxicity_score string, ngram_k1 string"


def rows():
    rng = np.random.default_rng(12)
    plain, bad = [f"word{i}" for i in range(400)], [f"vile{chr(97 + i)}{chr(97 + i)}" for i in range(12)]
    out, toxic = [], {}
    for i in range(420):
        w = list(rng.choice(plain, int(rng.integers(60, 90))))
        toxic[i] = int(i % 3 == 0)
        if toxic[i]:
            at = int(rng.integers(0, 40))
            w[at : at + 8] = rng.choice(bad, 8)
        out.append((i, " ".join(w)))
    base = [f"base{i}" for i in range(200)]
    for k in range(70):  # one large group of near copies
        w = list(base)
        for i in rng.choice(200, int(rng.integers(0, 3)), False):
            w[i] = f"other{rng.integers(0, 10**9)}"
        out.append((1000 + k, " ".join(w)))
    out += [(2000 + k, out[1][1]) for k in range(30)]  # exact copies of document 1
    out += [(3000, None), (3001, ""), (3002, "too short"), (3003, "again and again " * 60), (3004, "x" * 5000), (None, " ".join(f"none{i}" for i in range(80))), (None, out[2][1]), (1, out[1][1])]
    return out, toxic


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes(text):
    w = words(text)
    three = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(three)
    return len(w) >= 50 and 100 * len({i + k for i, t in enumerate(three) if n[t] > 1 for k in range(3)}) <= 50 * len(w)


def one_of_each(docs):
    """The ids that stay: a group's smallest, once; null ids only in groups without another."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t.lower()) for _, t in docs)]
    group = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    by = collections.defaultdict(list)
    for (i, _), g in zip(docs, group):
        by[g].append(i)
    return [min((i for i in ids if i is not None), default=None) for ids in by.values()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, toxic = rows()
    spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in docs], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_equal_plain_python(spark, tables):
    from tokenizers import Tokenizer

    docs, toxic = rows()
    at, held = spark.read.parquet(f"{tables}/documents.parquet"), []
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, tables)
        path = f"{tables}/{name}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
        held.append(at)
        if name != "packing":
            assert at.columns == columns
    ids = [sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr) for df in held[:3]]
    kept = [x for x in docs if passes(x[1])]
    assert ids[0] == sorted(kept, key=repr)
    clean = [x for x in kept if not toxic.get(x[0])]
    assert ids[1] == sorted(clean, key=repr)
    assert sorted((i for i, _ in ids[2]), key=repr) == sorted(one_of_each(clean), key=repr)
    tok, want = Tokenizer.from_file(packing.default_vocabulary()), collections.Counter()
    for i, text in ids[2]:
        x = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], np.uint32)
        want.update((i, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for a in range(0, len(x), 2048))
    pieces = held[3].collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    assert corpus_pipeline.run(spark, tables).count() == len(pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
