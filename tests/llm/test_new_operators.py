"""Source mixing, spelling variants and the schema rewrite against brute force, and on odd rows."""

import collections
import datetime
import glob
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import pytest

pytest.importorskip("marlstone.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from marlstone.llm import queries, schema_rewrite, source_mixing, spelling_variants  # noqa: E402
from marlstone.llm.common import numbered  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, `_s` int, size string, copy_no int"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


# ---- numbering


def test_numbered_equals_a_sort(spark):
    rows = [(i * 7919 % 101, i) for i in range(500)] + [(None, -1), (None, -2)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.asc_nulls_last("a"), F.col("b")], "no", "t").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {(r.a, r.b): r.no for r in got} == {r: i for i, r in enumerate(want)}
    assert numbered(spark.createDataFrame([], "a int"), [F.col("a")], "no", "t").count() == 0


# ---- source mixing


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_mix(rows, share=1.5):
    """Targets by resharing round after round, cuts by sorting."""
    total = collections.Counter()
    for _, text, source in rows:
        total[source] += len(words(text))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = share * sum(total.values()) - sum(2 * total[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        goal = {s: 2.0 * total[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not (over := {s for s in open_ if goal[s] > 2 * total[s]}):
            break
        capped |= over
    taken = []
    for s in order:
        own = sorted((int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16), k) for k, (i, _, x) in enumerate(rows) if x == s)
        times = math.floor(goal[s] / total[s]) if total[s] else 0
        below = 0
        for _, same in itertools.groupby(own, key=lambda x: x[0]):
            same = [k for _, k in same]
            part = sum(len(words(rows[k][1])) for k in same)
            more = below + part / 2 <= goal[s] - times * total[s]
            taken += [(rows[k][0], len(words(rows[k][1])), total[s], round(goal[s], 6), len(words(rows[k][1])) * (times + more)) for k in same]
            below += part
    return taken


MIX = [(i, "w " * (i * i % 37 + 1), "abcdeé"[i % 6]) for i in range(300)] + [(i, "w" * 9 + " x\ty", "a") for i in range(300, 320)] + [
    (None, "a b", None), (None, "c d e", None), (7, "again and again", "b"), (7, "again and again", "b"), (1000, None, "z"), (1001, "", "z"), (1002, " \n\t", None),
    (1003, "long " * 200_000, "𝄞"), (1004, "x" * 300_000 + " y", "𝄞"), (1005, "only one", ""),
]


def as_docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 5) for r in rows], SCHEMA).repartition(3)


def test_mix_equals_plain_version(spark):
    got = source_mixing.mix_report(as_docs(spark, MIX)).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == sorted((str(x[0]), *x[1:]) for x in plain_mix(MIX))
    assert all(r.taken <= 2 * r.size for r in got)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (i * 7919 % 211), f"s{i % 7}") for i in range(5000)]
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in source_mixing.mix_report(as_docs(spark, rows)).collect():
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert all(abs(taken - goal) <= 211 / 2 + 1 for taken, goal in by.values())
    assert sum(g for _, g in by.values()) == pytest.approx(1.5 * sum(by), rel=1e-9)


def test_mix_documents_are_the_reports(spark):
    docs = as_docs(spark, MIX)
    mixed = source_mixing.mix_documents(docs)
    assert mixed.columns == [*docs.columns, "_copy_no"]
    got = collections.Counter()
    for r in mixed.collect():
        got[str(r.doc_id), r.source] += len(words(r.text))
    want = collections.Counter()
    sources = {str(i): s for i, _, s in MIX}
    for r in source_mixing.mix_report(docs).collect():
        want[str(r.doc_id), sources[str(r.doc_id)]] += r.taken
    assert +got == +want


def test_mix_of_nothing(spark):
    assert source_mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = source_mixing.mix_report(as_docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_mix_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES["op11_source_mixing"](spark, DATA)
    want = con.sql(queries.ORACLE_SQL["op11_source_mixing"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_word_counts_at_window_ends():
    import pyarrow as pa

    texts = ["a" * 65535 + " b", "a" * 65536 + "b", " " * 65536 + "b", None, "", "x y", "é " * 70_000]
    assert list(source_mixing.word_counts(pa.array(texts))) == [len(words(t)) for t in texts]
    assert list(source_mixing.word_counts(pa.array(texts).slice(2, 4))) == [1, 0, 0, 2]


# ---- spelling variants


def plain_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and apart(v, w)] for w in n}
    form = {}
    for w, some in near.items():
        if some:
            best = min(some, key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def variants_of(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(3)
    return sorted(map(tuple, spelling_variants.group_variants(docs).collect()), key=str)


def spelling_rows():
    import random

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 12))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "Example", "exAmple", "ÀÉexample", "mississippi", "mississipp", "misissippi"]
    rows = []
    for i in range(250):
        some = [rnd.choice(base[: 4 + i % len(base)]) for _ in range(40)]
        k = rnd.randrange(40)
        w = some[k]
        at = rnd.randrange(len(w))
        some[k] = rnd.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "ÿ" + w[at + 1 :]])
        rows.append((i, rnd.choice([" ", "-", "1"]).join(some)))
    return rows


def test_variants_equal_brute_force(spark):
    chain = "chainwordx " * 400 + "chainword " * 35 + "chainwor " * 3
    rows = [*spelling_rows(), (9002, chain), (None, "nothing nothing without without"), (None, None), (3, ""), (5, "repeated words words repeated"), (5, "repeated words words repeated")]
    want = plain_variants(rows)
    assert sum(x[1] is not None for x in want) > 30 and ("chainwor", "chainword", "chainwordx", 3, 1, 35) in want
    assert variants_of(spark, rows) == want


def test_variants_of_long_words(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(400))
    some = [a, a[:200] + a[201:], a[:100] + "X" + a[101:], a + "z", "x" * 300, "x" * 301, a[:255], a[:256], a[:257], a[:255] + "y", a[:256] + "y"]
    rows = [(i, " ".join(some)) for i in range(1, 4)] + [(i, a + " " + "x" * 300) for i in range(10, 60)]
    assert variants_of(spark, rows) == plain_variants(rows)


def test_variants_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "WINDOW", 50)
    text = "someword anotherword " * 20 + "q" * 200 + " someword"
    assert [w for some in spelling_variants.runs(text) for w in some] == LETTERS.findall(text)
    assert variants_of(spark, [(1, text), (2, text)])


def test_variants_of_nothing(spark):
    assert spelling_variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants_of(spark, [(1, "short words only"), (2, None)]) == []


def test_meeting_checks_strings():
    """Words whose keys collide without sharing a deletion aren't near."""
    out = []
    spelling_variants._meet([(0, 1, "abcdefg", 5), (0, 2, "zzzzzzz", 50), (-1, 3, "yyyyyy", 5)], out)
    assert out == []


def test_long_pairs_are_compared(spark):
    assert spelling_variants.near("abc", "abd") and spelling_variants.near("abc", "ab") and spelling_variants.near("aab", "ab")
    assert not spelling_variants.near("abc", "abc") and not spelling_variants.near("abc", "bac") and not spelling_variants.near("abc", "a") and not spelling_variants.near("abcd", "bcde")


# ---- schema rewrite

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def client_rows(n):
    when = datetime.datetime(2024, 1, 31, 23, 59, 59, 123456)
    out = []
    for i in range(n):
        out.append((i if i % 50 else None, i // 2, None if i % 7 == 3 else "web", None if i % 11 == 5 else when - datetime.timedelta(hours=i), f"n{i}|é", None if i % 5 == 0 else f"e{i}", "", None if i % 13 == 1 else i % 25, "s", None if i % 17 == 2 else (-1) ** i * i * 1.1))
    return out


def plain_files(rows):
    """Per file_no: (version, rows as the final file has them)."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(("" if r[0] is None else str(r[0])).encode()), -1 if r[0] is None else r[0]))
    per, files = 1 + len(rows) // 500, {}
    for r, row in enumerate(rows):
        v = zlib.crc32(f"42:{r // per}".encode()) % 24
        v = 0 if v > 15 else v
        row = list(row)
        if v & 8 and row[9] is not None:
            import numpy as np

            row[9] = float(np.float32(row[9]))
        if v & 4:
            row[7], row[2] = -1, "none"
        files.setdefault(r // per, (v, []))[1].append(row)
    return files


def texts(rows):
    def one(r):
        r = list(r)
        if r[3] is not None:
            r[3] = (r[3] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        if r[9] is not None:
            r[9] = math.floor(1048576 * r[9])
        return "|".join("?" if x is None else str(x) for x in r)

    return [one(r) for r in rows]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_rewrite_equals_plain_version(spark):
    import pyarrow.parquet as pq

    rows = client_rows(1700)
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:1]  # one null id, so that the order is total
    clients = spark.createDataFrame(rows, CLIENTS).withColumn("r", F.lit("clash")).withColumn("version", F.lit(1)).repartition(5)
    got = {r.file_no: r for r in schema_rewrite.drill(clients).collect()}
    want = plain_files(rows)
    assert set(got) == set(want)
    for k, (v, some) in want.items():
        r = got[k]
        names = list(schema_rewrite.COLUMNS)
        if v & 1:
            names[4], names[5] = names[5], names[4]
        if v & 4:
            names = [x for x in names if x not in ("nation_id", "source")]
        if v & 2:
            names = [names[0], *reversed(names[1:])]
        assert (r.version, r.n_rows, r.start_columns, r.columns, r.rewritten) == (v, len(some), ",".join(names), ",".join(schema_rewrite.COLUMNS), v > 0)
        assert r.n_nulls == sum(x is None for row in some for x in row)
        assert r.ids_sha256 == sha(",".join("?" if x[0] is None else str(x[0]) for x in some))
        assert r.rows_sha256 == sha("\n".join(texts(some)))
        s = pq.ParquetFile(r.path.removeprefix("file://")).schema_arrow
        assert [(f.name, str(f.type), f.nullable, f.metadata[b"PARQUET:field_id"]) for f in s] == [(c, t, True, str(i + 1).encode()) for i, (c, t) in enumerate(zip(schema_rewrite.COLUMNS, ["int64", "int64", "string", "timestamp[us]", "string", "string", "string", "int64", "string", "double"]))]
    folder = os.path.dirname(os.path.dirname(got[0].path)).removeprefix("file://")
    assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == sorted(r.path.removeprefix("file://") for r in got.values())


def test_rewrite_of_hot_and_copied_clients(spark):
    rows = [(7, i, "web", None, "n", None, None, 1, "s", float("nan") if i == 3 else 1.5) for i in range(400)] + [(7, 1, "web", None, "n", None, None, 1, "s", 1.5)] * 300 + [(i, 1, None, None, None, None, None, None, None, None) for i in range(100)]
    got = schema_rewrite.drill(spark.createDataFrame(rows, CLIENTS)).collect()
    assert sum(r.n_rows for r in got) == len(rows) and len(got) == 400
    ids = [str(r[0]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))]
    assert [r.ids_sha256 for r in sorted(got, key=lambda r: r.file_no)] == [sha(",".join(ids[i : i + 2])) for i in range(0, len(ids), 2)]


def test_rewrite_leaves_untouched_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    evolved = schema_rewrite.write_drifted(spark.createDataFrame(client_rows(300), CLIENTS), folder)
    before = {p: os.stat(p).st_ino for p in glob.glob(f"{folder}/*/*.parquet")}
    files = schema_rewrite.rewrite(spark, folder, "file_no", evolved, schema_rewrite.DEFAULTS).collect()
    after = {p: os.stat(p).st_ino for p in glob.glob(f"{folder}/*/*.parquet")}
    stay = {r.path.removeprefix("file://") for r in files if not r.rewritten}
    assert stay and {p: before[p] for p in stay} == {p: after[p] for p in stay if p in after} and not set(after) & (set(before) - stay) and len(after) == len(before)
    assert not any(r.rewritten for r in schema_rewrite.rewrite(spark, folder, "file_no", evolved, schema_rewrite.DEFAULTS).collect())


def test_rewrite_refuses_two_files_in_a_directory(spark, tmp_path):
    folder = str(tmp_path / "t")
    evolved = schema_rewrite.write_drifted(spark.createDataFrame(client_rows(3), CLIENTS), folder)
    spark.read.parquet(f"{folder}/file_no=0").write.mode("append").parquet(f"{folder}/file_no=0")
    with pytest.raises(ValueError, match="has 2 files"):
        schema_rewrite.rewrite(spark, folder, "file_no", evolved, schema_rewrite.DEFAULTS)


def test_rewrite_of_nothing(spark):
    assert schema_rewrite.drill(spark.createDataFrame([], CLIENTS)).count() == 0
