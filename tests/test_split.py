"""Splitters with limits against naive versions, and the ingest that is killed and started again."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunk, split
from marlstone.streaming import ingest

DATA = "/root/testdata/sf0.001"
COLUMNS = "chunk_id string, source_url string, page int, chunk_type string, section_title string, content string, extra int"


def ok(text):
    return len(text) <= 4000 and len(text) // 3 <= 1500 and len(text.split()) <= 1500


def h16(x):
    return hashlib.sha256(x.encode()).hexdigest()[:16]


def table(n, width=40):
    return "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'y' * width} |" for i in range(n))


def naive_table(markdown, before=""):
    """Row by row: start a new piece whenever the text built so far would be too long."""
    head, rows = markdown.split("\n")[:2], markdown.split("\n")[2:]
    build = lambda some: (before + "\n\n" if before else "") + "\n".join(head + some)
    out, now = [], []
    for r in rows:
        if now and not ok(build(now + [r])):
            out, now = [*out, build(now)], []
        now = [*now, r]
    return out + [build(now)]


LONG_WORDS = "word " * 1499 + "end"  # too many tokens at few characters
TEXTS = {
    "fits": ("section_text", "a short one"), "sentences": ("section_text", "This is a sentence; it goes on. " * 400), "solid": ("section_text", "x" * 9001),
    "paragraphs": ("section_text", "\n\n".join(f"{i} " + "p" * 900 for i in range(12))), "tokens": ("section_text", "a b " * 1600), "table": ("table", table(300)),
    "noted": ("pdf_table", "Note above\n" + table(300)), "wide": ("table", table(3) + "\n| 9 | " + "z" * 9000 + " |\n| 10 | end |"), "no table": ("table", "a|b\n" + "q" * 5000),
    "other kind": ("faq", table(300)), "null": ("section_text", None), "empty": ("table", ""),
}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(None if k == "solid" else k, "http://x", 3 if k == "tokens" else None, kind, "s", text, 7) for k, (kind, text) in TEXTS.items()], COLUMNS).repartition(3)


def by_parent(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.parent or r.chunk_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.sub or 0) for k, v in out.items()}


def test_embed_limits(chunks):
    got = by_parent(split.embed_limits(chunks))
    solid = h16(TEXTS["solid"][1])
    assert set(got) == {*TEXTS, solid} - {"solid"}
    for k, some in got.items():
        kind, text = TEXTS["solid" if k == solid else k]
        assert all(r.extra == 7 and r.source_url == "http://x" for r in some)
        if text is None or ok(text):
            assert [(r.content, r.chunk_id, r.sub, r.parent) for r in some] == [(text, k, None, None)]
            continue
        assert [r.sub for r in some] == list(range(len(some))) and len(some) > 1
        assert all(len(r.content) <= 4000 for r in some) and (k == "tokens" or all(ok(r.content) for r in some))
        letters = lambda x: re.sub(r"\s", "", x)
        if kind == "section_text" and k != solid:
            assert all(w in " ".join(r.content for r in some) for w in text.split())
        if k == solid:
            assert letters("".join(r.content for r in some)) == text or sum(len(r.content) for r in some) >= 9001
        for r in some:
            page = "None" if k != "tokens" else "3"
            assert r.chunk_id == h16(f"http://x|{page}|{kind}|s|{r.sub}|{h16(f'{k}|{r.content}')}")
    assert [r.content for r in got["table"]] == naive_table(TEXTS["table"][1])
    assert [r.content for r in got["noted"]] == naive_table(table(300), "Note above")
    wide = [r.content for r in got["wide"]]
    assert wide[0] == table(3) and wide[-1] == "| a | b |\n| --- | --- |\n| 10 | end |" and all(w.startswith("| a | b |\n| --- | --- |\n") for w in wide)
    assert sum(w.count("z") for w in wide) >= 9000


def test_guard_leaves_nothing_over_the_limits(chunks):
    got = by_parent(split.guard(chunks))
    assert all(ok(r.content) for some in got.values() for r in some if r.content)
    text = TEXTS["paragraphs"][1].split("\n\n")
    assert [r.content for r in got["paragraphs"]] == ["".join(text[i : i + 4]) for i in (0, 4, 8)]
    assert [r.content for r in got["table"]] == naive_table(TEXTS["table"][1])
    assert {k: sum(r.dropped for r in some) for k, some in got.items() if any(r.dropped for r in some)} == {"tokens": 1}  # 3 500 characters of 1 750 words
    assert [len(r.content) for r in got[h16("x" * 9001)]] == [3500, 3500, 2001]
    for k, some in got.items():
        for r in some:
            if r.sub is not None:
                assert r.chunk_id == h16(f"{k}:sub:{r.sub}:{h16(r.content.strip())}")


def test_guard_counts_what_is_lost_whole(spark):
    r = split.guard(spark.createDataFrame([("c", None, None, "x", None, "a " * 1749 + "b", 1)], COLUMNS)).collect()
    assert [(x.content, x.sub, x.dropped, x.parent, x.chunk_id) for x in r] == [(None, None, 1, "c", None)]


@pytest.mark.parametrize("cut", [split.guard, split.embed_limits])
def test_chunks_are_read_and_measured_once(spark, tmp_path, cut):
    """Rows within the limits and the others come from one pass."""
    path = str(tmp_path / "chunks")
    spark.createDataFrame([(k, None, None, kind, "s", text, 7) for k, (kind, text) in TEXTS.items()], COLUMNS).write.parquet(path)
    d = cut(spark.read.parquet(path).withColumn("content", T.clean(F.col("content"))))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
    assert d.select(F.count_distinct(F.coalesce("parent", "chunk_id"))).first()[0] == len(TEXTS)


def test_cleaning_and_limits_agree_with_their_patterns(spark):
    rnd = random.Random(8)
    parts = ["w", "ab", "x" * 30, " ", "  ", "\t", "\n", "\n\n\n", "\u00a0", "\x0b", "\r", "\x85", "\u2028", "\u2029", "\U0001f600", "\x1c"]
    texts = ["".join(rnd.choices(parts, k=n)) for n in range(9) for _ in range(150)] + ["a\u2028", "a \u2028", " \x85", "\u2029 ", None]
    texts += [sep.join(["a"] * n) for n in (1499, 1500, 1501) for sep in (" ", "  ")] + ["é" * n for n in (3999, 4000, 4001)] + ["a " * 1500 + "b" * k for k in (1, 2)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    plain = strip(F.regexp_replace(F.regexp_replace(F.translate(t, "\u00a0", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    pairs = [(T.clean(t), plain), (T.stripped(t), strip(t)), (T.within_embed_limit(t), (F.length(t) <= 4000) & (T.approx_tokens(t) <= 1500))]
    assert [d.where(~a.eqNullSafe(b)).count() for a, b in pairs] == [0, 0, 0] and d.where(T.within_embed_limit(t)).count() < len(texts) - 3
    for x in filter(None, texts):
        assert split.words(x) == len(split.WORD.findall(x)) and split.fits(x) == (len(x) <= 4000 and split.within(len(x), len(split.WORD.findall(x))))


def test_sizes_are_capped():
    text = "word " * 3000
    assert all(len(p) <= 4000 for p in split.text_pieces(text, 9000, 200)) and split.text_pieces("  ", 10, 3) == []
    a, b = split.text_pieces("w " * 300, 90, 80)[:2]
    assert len(a) <= 90 and b.startswith("w")  # an overlap of at most 30


# ---- ingest


def documents(n=90):
    return [(i, f"Document {i % 40} says something. " * (i % 40 * 3 + 1), f"s{i % 40}") for i in range(n)] + [(None, "no id", "s"), (n, None, "s"), (n + 1, "", None)]


def feed(spark, rows, path, k=6):
    step = -(-len(rows) // k)
    for j in range(k):
        spark.createDataFrame(rows[j * step : (j + 1) * step], ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(path)


def expected(spark, rows):
    c = ingest.document_chunks(spark.createDataFrame(rows, ingest.DOCUMENTS)).collect()
    first = {}
    for r in sorted(c, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.chunk_index)):
        first.setdefault(r.chunk_id, (r.content, r.source_url, r.chunk_index))
    return first


def test_chunk_ids(spark):
    r = ingest.document_chunks(spark.createDataFrame([(1, "hello  there", "u")], ingest.DOCUMENTS)).collect()
    assert [(x.content, x.chunk_id) for x in r] == [("hello there", h16(f"u|None|section_text||0|{h16('hello there')}"))]


def test_ingest_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    rows = documents()
    feed(spark, rows, str(tmp_path / "in"))
    real, calls = ingest.merge, []

    def dies(chunks, batch, folder, order):
        real(chunks, batch, folder, order)
        calls.append(batch)
        if calls.count(2) == 1 and batch == 2:
            raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "merge", dies)
    folder = str(tmp_path / "store")
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_files(spark, str(tmp_path / "in"), 1, folder)
    partly = ingest.stored_chunks(spark, folder).count()
    ingest.ingest_files(spark, str(tmp_path / "in"), 1, folder)
    assert calls == [0, 1, 2, 2, 3, 4, 5]
    got = ingest.stored_chunks(spark, folder).collect()
    want = expected(spark, rows)
    assert 0 < partly < len(got) == len(want)
    assert {r.chunk_id: (r.content, r.source_url, r.chunk_index) for r in got} == want
    progress = {r.batch: r.stored for r in spark.read.parquet(f"{folder}/progress").collect()}
    assert sum(progress.values()) == len(want) and set(progress) == set(range(6))
    feed(spark, rows[:10] + [(500, "Something new. " * 200, "new")], str(tmp_path / "in"), 1)
    ingest.ingest_files(spark, str(tmp_path / "in"), 1, folder)
    more = ingest.stored_chunks(spark, folder)
    assert more.where("batch = 6").select("doc_id").distinct().collect() == [(500,)]
    assert more.count() == more.select("chunk_id").distinct().count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recursive_chunks_are_parts_of_their_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    of = {}
    for r in chunk.recursive_chunks(docs).collect():
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == {i for i, t in texts.items() if t and t.strip()}
    for i, some in of.items():
        some.sort(key=lambda r: r.chunk_index)
        text, end = texts[i], 0
        for k, r in enumerate(some):
            assert r.chunk_index == k and len(r.chunk) <= 1000
            reach = end + len(text[end:]) - len(text[end:].lstrip())
            at = text.rfind(r.chunk, 0, reach + len(r.chunk))  # the furthest place that leaves nothing but white space out
            assert at >= 0
            end = max(end, at + len(r.chunk))
        assert not texts[i][end:].strip()


def slowly_packed(parts, whole):
    """Runs by measuring the whole text again with each part."""
    held = []
    for p in parts:
        if held and not split.fits(whole([*held, p])):
            yield held
            held = []
        held.append(p)
    if held:
        yield held


def test_packing_measures_each_part_and_not_its_run_again(monkeypatch):
    rnd = random.Random(5)
    ends = ["", " ", " ", "\x0b", "  "]
    odd = lambda most: rnd.choice(ends) + "".join(rnd.choice(["w", "ab ", "| ", " ", "x" * 30, "\x0b", "."]) for _ in range(rnd.randint(1, most))) + "z|" + rnd.choice(ends)
    for _ in range(8):
        head = ["h |" + rnd.choice(ends), "| --- |"]
        rows = [r for r in "\n".join(odd(rnd.choice([8, 300])) for _ in range(rnd.randint(3, 400))).splitlines() if r.strip()]
        body = lambda some: "\n".join([*head, *some])
        assert list(split.packed(rows, split.rows_under(body([]), False))) == list(slowly_packed(rows[:], body))
        rows = [split.tidy("x\n" + r + "\nx")[2:-2] for r in rows]
        lead = split.tidy("x\n" + body([]) + "\nx")[2:-2]
        assert list(split.packed(rows, split.rows_under(lead, True))) == list(slowly_packed(rows, lambda some: split.tidy("\n".join([lead, *some]))))  # noqa: B023
        paragraphs = [r.rstrip() for r in rows]
        assert list(split.packed(paragraphs, split.paragraphs_in_a_row)) == list(slowly_packed(paragraphs, lambda some: "".join(some).strip()))
    read = []
    monkeypatch.setattr(split, "words", lambda t: read.append(len(t)) or len(split.WORD.findall(t)))
    text = table(20_000, 3)
    assert len(split.table_pieces(text)) > 50 and sum(read) < 4 * len(text)


def test_ingest_holds_few_pieces_at_a_time(spark, monkeypatch):
    held = []
    runs = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: runs.append(f) or spark.createDataFrame([], schema))
    ingest.document_chunks(spark.createDataFrame([(1, "x", "s")], ingest.DOCUMENTS))
    import pyarrow as pa

    texts = ["one two three. " * 2000] * 200 + [None, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(202), pa.int64()), pa.array(["s"] * 202), pa.array(texts)], names=["doc_id", "source_url", "content"])
    out = list(runs[0](iter([b])))
    held = [sum(map(len, x.column(3).to_pylist())) for x in out]
    assert max(held) < split.HELD + 2 * len(texts[0]) and len(out) > 3
    got = [t for x in out for t in zip(*(x.column(i).to_pylist() for i in (0, 2, 3)))]
    assert got == [(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(split.text_pieces(t or "", 1100, 150))]
