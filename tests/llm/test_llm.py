"""Operators of the llm subpackage against brute force, and on empty, null, repeated and odd rows."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("marlstone.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from marlstone.llm import embedding_dedup, ftrl, language_id, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_lattice, suffix_tree, toxicity, warc_fixity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(3000))
ROWS = [
    (0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \n\t ", None, "s", 4), (3, LONG, "en", "s", 1), (4, LONG, "en", "s", 1), (4, LONG, "en", "s", 1),
    (5, LONG + " more", "de", "s", 1), (6, "a b c", "de", None, 5), (7, "A  b\nc", "fr", "s", 6), (8, "é ü ß " * 40, "fr", "s", 9), (9, "x" * 5000, None, "s", 5000),
    (None, "no id here at all", "en", "s", 1), (10, "<|endoftext|> a", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("_id", F.lit(1)).withColumn("y", F.lit("clash")).withColumn("n_words", F.lit("clash"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(11)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")


def tokens(text):
    return (text or "").encode().lower().split()


def test_every_operator_keeps_every_row(docs, labels):
    assert toxicity.score_documents(docs, labels, toxicity.learn_rows()).count() == len(ROWS)
    assert quality_classifier.score_documents(docs, labels, quality_classifier.learn_rows()).count() == len(ROWS)
    got = {r["doc_id"]: r for r in language_id.identify_documents(docs, language_id.learn_rows()).collect()}
    assert len(got) == 12 and all(got[i]["lang_pred"] == "und" for i in (0, 1, 2))


def test_empty_tables(none):
    d, lab = none
    assert toxicity.score_documents(d, lab, toxicity.learn_rows()).count() == 0
    assert quality_classifier.score_documents(d, lab, quality_classifier.learn_rows()).count() == 0
    assert language_id.identify_documents(d, language_id.learn_rows()).count() == 0
    assert quality_rules.score_documents(d, lab).count() == 0
    assert packing.pack_documents(d).count() == 0
    assert suffix_tree.score_documents(d, suffix_tree.learn_rows()).count() == 0
    assert ngram_join.near_duplicates(d).count() == 0


def test_ngram_join_equals_brute_force(docs):
    sets = []
    for _, text, *_ in ROWS:
        w = tokens(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [sum(1 for k, t in enumerate(sets) if k != i and s and t and len(s & t) >= 0.8 * len(s | t)) for i, s in enumerate(sets)]
    got = ngram_join.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(x[0]), n) for x, n in zip(ROWS, links))
    assert {r["class_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 6, 8, 9, 10]


def test_ngram_join_verifies_texts_without_id(spark):
    base, other, third = ([f"{c}{i}" for i in range(100)] for c in "abc")
    near = lambda w: [*w[:-1], "changed"]
    texts = [(1, base), (None, near(base)), (None, near(base)), (None, other), (None, near(other)), (None, third), (None, third), (2, third + base)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in texts]
    links = [sum(1 for k, t in enumerate(sets) if k != i and len(s & t) >= 0.8 * len(s | t)) for i, s in enumerate(sets)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = ngram_join.near_duplicates(d).collect()
    assert links == [2, 2, 2, 1, 1, 1, 1, 0] and sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(i), n) for (i, _), n in zip(texts, links))
    assert sum(r["class_id"] == 1 for r in got) == 3
    kept = sorted((str(r["doc_id"]), r["text"].split()[0]) for r in ngram_join.keep_one(d).collect())
    assert kept == [("1", "a0"), ("2", "c0"), ("None", "b0"), ("None", "c0")]


def test_bayes_bound_keeps_pairs_at_the_threshold():
    need = ngram_join.least_equal(0.8)
    assert all(m <= 0.8 * n for m, n in zip(need, range(16, 129, 16))) and need[-1] > 0.45 * 128


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, plainly."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(three)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, t in enumerate(three) if n[t] > 1 for k in range(3)})


def test_base_quality_features(docs, labels):
    got = collections.defaultdict(list)
    for r in quality_rules.score_documents(docs, labels).collect():
        got[r["doc_id"]].append(r)
    for i, text, *_ in ROWS:
        n, r = quality_counts(text), got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r["kept"] == (not r["base_failed"])
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for rows in got.values() for r in rows)


def test_base_quality_features_of_odd_lines(spark):
    rng = np.random.default_rng(5)
    bits = ["a", "b c", "#", "a|b", "\n", "\n\n", " ", "\t", "ä é", "x\u00a0y", "$5%", "日本"]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(0, 200)))), "en") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality_rules.score_documents(d, none).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality_counts(rows[r["doc_id"]][1])


def test_exact_binomial():
    exact = sum(math.comb(300, i) * 0.01**i * 0.99 ** (300 - i) for i in range(3))
    assert quality_rules.binomial_at_most(2, 300, 0.01) == pytest.approx(exact, rel=1e-9)
    assert quality_rules.binomial_at_most(0, 300, 0.01) == pytest.approx(0.99**300) and quality_rules.binomial_at_most(5, 5, 0.1) == 1.0


def test_proposals_are_nested_and_within_their_allowance():
    rng = np.random.default_rng(0)
    counts = {r: {b: (int(rng.integers(0, 900) * 0.9**b), int(rng.integers(0, 50))) for b in range(quality_rules.BINS)} for r in quality_rules.RULES}
    cuts, gains = quality_rules.propose(counts)
    assert all(x >= y for a, b in zip(cuts, cuts[1:]) for x, y in zip(a, b)) and gains == sorted(gains)
    for step, cut in enumerate(cuts):
        for rule, c in zip(quality_rules.RULES, cut):
            good = sum(g for g, _ in counts[rule].values())
            assert sum(g for b, (g, _) in counts[rule].items() if b >= c) <= quality_rules.EPSILON * (step + 1) / quality_rules.STEPS / 5 * good


def test_certified_steps_stay_within_epsilon():
    gains = [0.1, 0.2, 0.3]
    assert quality_rules.certify(gains, [(0, 5), (0, 5), (0, 5)], 298, 1) is None  # 0.99 ** 298 > 0.05
    assert quality_rules.certify(gains, [(0, 5), (0, 5), (0, 5)], 299, 1) == 2
    assert quality_rules.certify(gains, [(0, 5), (3, 5), (0, 5)], 299, 1) == 0  # the second step fails, the third isn't tried
    assert quality_rules.certify(gains, [(0, 5), (0, 5), (0, 5)], 299, 4) is None
    assert quality_rules.certify([0.1, 0.1, 0.0], [(0, 0)] * 3, 1000, 4) == 0


def test_learned_rules_hold_and_count_copies_once(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(3000):
        lang, good = ("en", "de")[i % 2], int(rng.random() < 0.8)
        w = [f"w{rng.integers(0, 10**6)}" for _ in range(60)]
        if not good:
            w = [x + "#" * int(rng.integers(1, 4)) for x in w]
        rows.append((i, " ".join(w), lang))
        labels.append((i, good))
    rows += [(3000 + i, f"only {i} " + "few labels here " * 4, "fr") for i in range(50)] + [(4000 + i, rows[1][1], "xx") for i in range(900)]
    labels += [(3000 + i, 1) for i in range(50)] + [(4000 + i, 1) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    feats = quality_rules.with_features(d.withColumn("hash", F.xxhash64("text")))
    cutoffs = quality_rules.calibrate(feats, lab, {k: k for k in quality_rules.FEATURES}, "doc_id", "lang", "hash")
    assert set(cutoffs) == {"=en", "=de"}  # too few labels of fr; those of xx are of one text
    got, y = {r["doc_id"]: r for r in quality_rules.score_documents(d, lab).collect()}, dict(labels)
    assert sum(got[i]["kept"] for i in range(3000) if not y[i]) < 10 and all(got[i]["kept"] for i in range(4000, 4900))
    assert sum(not got[i]["kept"] for i in range(3000) if y[i]) <= 0.01 * sum(y[i] for i in range(3000))
    for i, t, lang in rows[:3000]:
        words, chars, symbols, _, repeats = quality_counts(t)
        bins = [math.floor(x * quality_rules.BINS) for x in (symbols / chars, repeats / words, 0, 0, chars / words / 50)]
        assert got[i]["kept"] == (not any(b >= c for b, c in zip(bins, cutoffs["=" + lang])))


def maximal_segments(score):
    """All maximal scoring segments by their definition: the best subarray, then the same left and right of it."""
    found = []

    def split(lo, hi):
        runs = [(sum(score[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        if runs and max(runs)[0] > 0:
            best = max(r[0] for r in runs)
            _, _, a, b = max((r for r in runs if r[0] == best), key=lambda r: r[1])  # the shortest, as ties end early
            found.append((a, b - 1, best))
            split(lo, a), split(b, hi)

    split(0, len(score))
    return sorted(found)


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        hits = sorted({int(i): float(s) for i, s in zip(rng.integers(0, 30, 12), rng.normal(1, 3, 12))}.items())
        score = [-0.7] * 30
        for i, s in hits:
            score[i] = s
        got = toxicity.segments(hits, 0.7)
        want = maximal_segments(score)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity_finds_planted_passages(spark):
    """Fit and scores against a plain version of the same formulas, and held-out accuracy."""
    rng = np.random.default_rng(8)
    plain, bad = [f"word{i}" for i in range(300)], [f"vile{chr(97 + i)}{chr(97 + i)}" for i in range(12)]
    rows, labels = [], []
    for i in range(900):
        w, y = list(rng.choice(plain, 60)), int(i % 3 == 0)
        if y:
            at = int(rng.integers(0, 50))
            w[at : at + 8] = rng.choice(bad, 8)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[0][1])]
    labels += [(902, 1, 0), (902, 1, 1), (903, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab, toxicity.learn_rows())
    assert all(model["scores"][b] > 0 for b in bad)
    got = {(r["doc_id"], r["held_out"]): r for r in toxicity.score_documents(docs, lab, toxicity.learn_rows()).collect()}
    assert len(got) == len(rows)
    y = {i: t for i, _, t in labels[:900]}
    held = [(i, r) for (i, h), r in got.items() if h and i in y]
    assert len(held) > 200 and all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got if i is not None)
    assert all(r["predicted"] == y[i] for i, r in held) and all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    for (i, _), r in got.items():
        text = dict(rows)[i]
        toks = (text or "").split()
        score = [max([model["scores"][f] for f in toxicity.forms(w) if f in model["scores"]], default=-toxicity.GAP) for w in toks]
        x = [model["lam"] * s - math.log(model["k"] * max(len(toks), 1)) for *_, s in maximal_segments(score)]
        x = [e for e in x if e >= -math.log(toxicity.E_MOST)]
        want = 1 / (1 + math.exp(-(model["bias"] + model["slope"] * math.log1p(sum(x)))))
        assert r["score"] == pytest.approx(want) and r["n_passages"] == len(x)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack_documents(docs, group=4).collect()
    want = collections.Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        for a in range(0, len(ids), 2048):
            want[(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(1)
    sizes = sorted(map(int, rng.integers(1, 101, 400)), reverse=True)
    room, out = [], []
    for s in sizes:
        fit = [(r, k) for k, r in enumerate(room) if r >= s]
        k = next(k for r, k in fit if r == min(fit)[0]) if fit else len(room)
        if not fit:
            room.append(100)
        room[k] -= s
        out.append(room[k])
    got = packing.best_fit(sizes, 100)
    assert [100 - o - s for (_, o), s in zip(got, sizes)] == out


def test_suffix_tree_base_scores(docs):
    c = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, text, *_ in ROWS:
        if not held(i):
            c.update([*tokens(text), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in suffix_tree.score_documents(docs, suffix_tree.learn_rows()).collect()}
    for i, text, *_ in ROWS:
        t, r = [*tokens(text), None], got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[x] > 0 for x in t), n, held(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert r["score"] < 0


def suffix_tree_scores(texts, learned):
    """Each text's log10 probability by a plain suffix tree of all contexts, and the lengths of the kept contexts."""
    mu, least, follows = suffix_tree.MU, suffix_tree.CONTEXT, collections.defaultdict(collections.Counter)
    words = collections.Counter(w for t in learned for w in [*t, None])
    n, v = sum(words.values()), len(words)
    for t in learned:
        for i, w in enumerate([*t, None]):
            for k in range(1, i + 1):
                follows[tuple(t[i - k : i])][w] += 1
    kept = {}

    def prob(w, ctx):
        if not ctx:
            return (words[w] + 0.5) / (n + 0.5 * (v + 1))
        below = prob(w, ctx[1:])
        if ctx not in kept:
            return below
        total, explicit, rest = kept[ctx]
        return (explicit.get(w, 0) + (rest + mu) * below) / (total + mu)

    for level in itertools.count(1):
        found = {}
        for ctx, c in follows.items():
            total, explicit = sum(c.values()), {w: m for w, m in c.items() if m >= suffix_tree.SUCCESSOR}
            if len(ctx) != level or total < least or not explicit:
                continue
            rest = total - sum(explicit.values())
            gain = rest * math.log((rest + mu) / (total + mu))
            for w, m in explicit.items():
                below = prob(w, ctx[1:])
                gain += m * math.log((m + (rest + mu) * below) / (total + mu) / below)
            if gain > 0.5 * math.log(n) * len(explicit):
                found[ctx] = (total, explicit, rest)
        if not any(len(ctx) >= level for ctx in follows):
            break
        kept |= found
    return [sum(math.log10(prob(w, tuple(t[:i]))) for i, w in enumerate([*t, None])) for t in texts], {len(c) for c in kept}


@pytest.mark.parametrize(("word", "alone"), [(suffix_tree.WORD, suffix_tree.ALONE), (0.02, 1)])
def test_suffix_tree_equals_brute_force(spark, monkeypatch, word, alone):
    monkeypatch.setattr(suffix_tree, "WORD", word)
    monkeypatch.setattr(suffix_tree, "ALONE", alone)
    rng = np.random.default_rng(7)
    # What follows d depends on words one to four before it, so each level diverges from the one below.
    rows, after = [], {}
    for i in range(600):
        t = [f"n{x}" for x in rng.integers(0, 40, 6)]
        for _ in range(3):
            run = tuple(rng.choice(["a", "b"], 4))
            near = after.setdefault(run, f"{'xy'[run[3] == 'a']}{rng.integers(0, 2)}{len(after) % 5}")
            t += [*run, "d", near if rng.random() < 0.9 else "z"]
        rows.append((i, " ".join(t)))
    rows += [(1000, ""), (1001, None), (1002, "a new word d"), (1003, "d")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want, lengths = suffix_tree_scores([(t or "").split() for _, t in rows], [(t or "").split() for i, t in rows if not held(i)])
    assert max(lengths) > 3
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffix_tree.learn_rows()).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want)


def test_suffix_tree_finds_contexts_beyond_a_level_that_keeps_none(spark):
    """What follows depends on the third word before; two words before it tell nothing that one doesn't."""
    rows = [(i, f"{'ab'[i % 2]} m1 m2 {'XY'[i % 2]}") for i in range(800)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want, lengths = suffix_tree_scores([t.split() for _, t in rows], [t.split() for i, t in rows if not held(i)])
    assert 3 in lengths and 2 not in lengths
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffix_tree.learn_rows()).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want)


def test_suffix_tree_grows_many_levels_in_few_passes(spark, monkeypatch):
    """What follows depends on a word 25 words before; the levels past the third have no tables of their own."""
    names, staged = [], suffix_tree.staged
    monkeypatch.setattr(suffix_tree, "staged", lambda df, name, *a: names.append(name) or staged(df, name, *a))
    rows = [(i, f"{'ab'[i % 2]} {'m ' * 24}{'XY'[i % 2]}") for i in range(700)]
    monkeypatch.setattr(suffix_tree, "BARREN", 40)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want, lengths = suffix_tree_scores([t.split() for _, t in rows], [t.split() for i, t in rows if not held(i)])
    assert max(lengths) > 19
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffix_tree.learn_rows()).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want)
    assert len(names) < 12  # words, pairs and level of three levels, two passes for the others, values, rows


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 12))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.05, 0.15, 0.3)])
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [], 0), (102, [0.0] * 12, 0), (103, [float("nan")] * 12, 0), (104, [None] * 12, 0), (105, rows[0][1], 1), (106, [1.0, 2.0], 0), (None, rows[1][1], 0), (None, rows[1][1], 0), (None, None, 0)]
    # Equal and opposite directions of any size; cosines of 0.9 exactly and of the least bit below.
    rows += [(200, [1e-200, 2e-200, 0.0], 0), (201, [1e200, 2e200, 0.0], 0), (202, [-1e-200, -2e-200, 0.0], 0), (203, [5e-324, 0.0, 0.0], 0)]
    rows += [(300, [9.0, 3.0, 3.0, 1.0], 0), (301, [1.0, 0.0, 0.0, 0.0], 0), (302, [math.nextafter(9.0, 0.0), 3.0, 3.0, 1.0], 0)]
    d = spark.createDataFrame([(i, v, lab, "clash", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, key string, cid int")
    got = embedding_dedup.near_duplicates(d, block=16).collect()
    ok = [(k, i, v) for k, (i, v, _) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = collections.defaultdict(set)
    for (k, _, a), (j, _, b) in itertools.combinations(ok, 2):
        if len(a) == len(b) and embedding_dedup.reaches(np.array(a), np.array(b), embedding_dedup.Fraction(9, 10)):
            links[k].add(j), links[j].add(k)
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        comp = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        want.append((str(i), len(links[k]), str(comp), i is not None and i == comp))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(want)
    at = {i: k for k, (i, *_) in enumerate(rows)}
    assert links[at[200]] == {at[201]} and links[at[300]] >= {at[301]} and at[301] not in links[at[302]]


def test_no_embeddings(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(d).count() == 0


def test_pieces_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_lattice.encode_documents(docs, top=3).collect()}
    for i, text, *_ in ROWS:
        ids = np.frombuffer(bytes(got[i]), np.uint32).tolist()
        assert ids == sp.encode(text or "") and sentencepiece_lattice.decode(ids, sentencepiece_lattice.default_model()) == (text or "")


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(200)] + [(7, "http://x/7", "<p>7</p>"), (None, None, None)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    other = [r for r in rows if r[0] != 20]
    other[30] = (31 if other[30][0] == 31 else other[30][0], other[30][1], "broken")
    b = spark.createDataFrame([*other, (500, "u", "h")], "page_id long, url string, html string")
    got = collections.Counter((r["status"], r["page_id"]) for r in warc_fixity.audit(a, b).collect() if r["status"] != "ok")
    assert got == collections.Counter({("missing", 20): 1, ("corrupt", other[30][0]): 1, ("extra", other[30][0]): 1, ("extra", 500): 1})
    assert {r["status"] for r in warc_fixity.audit(a, a).collect()} == {"ok"}


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    ex = [(np.array([int(y), 2 + int(rng.integers(0, 5))]), np.ones(2), int(y)) for y in rng.integers(0, 2, 200)]
    w = ftrl.train(ex, 8)[:, 0]
    assert w[1] > 0 > w[0]


def test_viterbi_fold_against_every_path(spark):
    pieces = {"a": -3.0, "b": -3.0, "c": -3.0, "ab": -2.5, "bc": -2.0, "abc": -5.5, "ca": -9.0}
    rows = []
    for w in ("abc", "abcab", "cab", "a"):
        spans = [(w[i:j], i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in pieces]
        rows.append((w, [(-pieces[p], i, j, list(pieces).index(p)) for p, i, j in spans]))
    df = spark.createDataFrame(rows, "word string, edges array<struct<rank:double,s:int,e:int,id:int>>")
    got = df.select("word", sentencepiece_lattice.viterbi(F.col("edges"), F.length("word")).alias("path")).collect()

    def best(w):
        return max((pieces[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces), default=0.0 if not w else float("-inf"))

    for r in got:
        names = [list(pieces)[x["id"]] for x in r["path"]]
        assert "".join(names) == r["word"] and abs(sum(pieces[n] for n in names) - best(r["word"])) < 1e-9


def test_atoms_cut_where_no_piece_joins(monkeypatch):
    path = sentencepiece_lattice.default_model()
    pieces = sentencepiece_lattice.vocabulary(path)[0]
    joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    text = "One  two,three\n\tfour—five 日本語 äöü \U0001f600x " * 5
    t = "▁" + text.replace(" ", "▁")
    want = [t[0]]
    for a, b in itertools.pairwise(t):
        if a + b in joined:
            want[-1] += b
        else:
            want.append(b)
    for block in (1, 2, 7, 1_000_000):
        monkeypatch.setattr(sentencepiece_lattice, "BLOCK", block)
        assert sentencepiece_lattice.atoms(text, path) == want
    assert sentencepiece_lattice.atoms("", path) == sentencepiece_lattice.atoms(None, path) == []


def test_pieces_do_not_depend_on_the_frequent_atoms(docs):
    got = [sorted(map(tuple, sentencepiece_lattice.digest_documents(docs, top=top, sample=sample).collect()), key=repr) for top, sample in ((0, 1), (5, 2), (1000, 100))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(ROWS) and all(r[3] for r in got[0])


def test_pieces_of_an_empty_table(spark):
    assert sentencepiece_lattice.digest_documents(spark.createDataFrame([], DOCS)).count() == 0


def near_texts(groups, size, words=200, seed=4):
    """Texts in groups whose members differ from their group's first by up to two words."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(size):
            w = list(base)
            for i in rng.choice(words, int(rng.integers(0, 3)), False):
                w[i] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(w))
    return out


def test_ngram_join_in_blocks_and_with_text_ids(spark):
    texts = [*near_texts(2, 40), *near_texts(1, 1, seed=5)[:1] * 30, None, None, ""]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    links = [sum(1 for k, t in enumerate(sets) if k != i and s and t and len(s & t) >= 0.8 * len(s | t)) for i, s in enumerate(sets)]
    d = spark.createDataFrame([(f"id{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    known = {(r["k1"], r["k2"]): r["n_links"] for r in ngram_join.join(d, block=8)[1].collect()}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(d).collect()}
    assert [got[f"id{i:03}"] for i in range(len(texts))] == links
    rows = ngram_join.keyed(d).collect()
    assert [known.get((r["k1"], r["k2"]), 0) for r in sorted(rows, key=lambda r: r["doc_id"])] == links
    assert max(links) >= 39


def test_comparison_equals_brute_force():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for _ in range(int(rng.integers(1, 40))):
            x = base.copy()
            at = rng.choice(60, int(rng.integers(0, 14)), False)
            x[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
            sets.append(np.unique(x))
    n, plain = len(sets), [set(s.tolist()) for s in sets]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in plain] for a in plain]) & ~np.eye(n, dtype=bool)
    sig, cid, m = np.stack([ngram_join.signature(s) for s in sets]), np.arange(n) * 7, rng.integers(1, 4, n)
    for left, right in ((np.arange(n), np.arange(n)), (np.arange(0, n, 2), np.arange(1, n, 2))):
        same = len(left) == n
        use = np.zeros((n, n), bool)
        use[np.ix_(left, right)] = True
        want = ((near & (use | use.T)) * m[None, :]).sum(1)
        for dense in (8, 10**9):
            ngram_join.DENSE, before = dense, ngram_join.DENSE
            x, y = ngram_join.compare(cid, m, sets, sig, left, right, same, 0.8)
            ngram_join.DENSE = before
            got = np.zeros(n, int)
            got[x[:, 0] // 7] = x[:, 1]
            assert (got == want).all() and len(y) <= n
    low, band = (sig & 255).astype(np.uint8), np.sort(rng.integers(0, 5, n))
    tree = ngram_join.band_forest(low, band, None, 0.8).parent
    assert all(tree[i] == tree[j] for i in range(n) for j in range(i) if near[i, j] and band[i] == band[j])
    assert all(band[i] == band[p] for i, p in enumerate(tree))


def test_forest_goes_out_in_parts():
    import pyarrow as pa

    from marlstone.llm import graph

    rng = np.random.default_rng(1)
    links = rng.integers(0, 300, (400, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"]) for x in np.split(links, 8)]
    trees = []
    for held in (10, 10**6):
        f = ngram_join.Forest(300)
        for b in graph.forest(iter(batches), held):
            f.link(b.column(0).to_numpy(), b.column(1).to_numpy())
        trees.append(f.parent)
    assert (trees[0] == trees[1]).all()


def test_long_atoms_equal_the_library():
    import tracemalloc

    import sentencepiece

    path = sentencepiece_lattice.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(11)
    words = ["=" * 5000, "ab" * 3000, "a" * 4001, "日本" * 500, "".join(rng.choice(list("abcdefgh=-_é"), 6000))]
    words += ["".join(rng.choice(list("etaoins"), int(rng.integers(1, 90)))) for _ in range(300)]
    for w in words:
        assert sentencepiece_lattice.encode_word("▁" + w, path) == sp.encode(w), w[:40]
    tracemalloc.start()
    sentencepiece_lattice.encode_word("=" * 400_000, path)
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    """What the classifiers say of rows that they may not learn from."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = language_id.identify_documents(docs, language_id.learn_rows()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["lang"] for r in got) > 0.97 * len(got)
    lab = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    got = quality_classifier.score_documents(docs, labels, quality_classifier.learn_rows()).join(lab, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["y"] for r in got) > 0.95 * len(got)


def test_language_frequencies_and_scores_equal_a_plain_version(spark):
    texts = ["Der Hund läuft.", "the dog runs", "", None, "123 !?", "Ein Hund und eine Katze " * 40, "a dog and a cat " * 40, "Ab" * 40_000]
    rows = [(i, texts[i % len(texts)], ("de", "en")[i % 2] if i % 7 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n, df = language_id.document_frequencies(d.select("text"))
    plain = collections.Counter()
    for _, t, _ in rows:
        low = (t or "").lower()
        if any(c.isalpha() for c in low):
            plain.update({p for _, places, _ in language_id.ngrams(t) for p in places.tolist()})
    assert n == sum(any(c.isalpha() for c in t or "") for _, t, _ in rows) and {i: int(x) for i, x in enumerate(df) if x} == dict(plain)
    langs, w = language_id.fit(d, language_id.learn_rows())
    assert langs == ["de", "en"]
    for r in language_id.identify_documents(d, language_id.learn_rows()).collect():
        want = language_id.predict(rows[r["doc_id"]][1], langs, w)
        assert (r["lang_pred"], r["held_out"]) == (want[0], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["score"] == pytest.approx(want[1])


def test_quality_scores_equal_a_plain_version(spark, labels):
    rows = [(i, f"good plain words number {i} " * 9 if i % 2 else f"BAD!! $$ {i} ## bad BAD " * 9) for i in range(40)] + [(100, ""), (101, None)]
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, y string, _id string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    w = quality_classifier.fit(d, lab, quality_classifier.learn_rows())
    assert (quality_classifier.fit(d.repartition(3), lab, quality_classifier.learn_rows()) == w).all()
    got = {r["doc_id"]: r for r in quality_classifier.score_documents(d, lab, quality_classifier.learn_rows()).collect()}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        fams, _ = quality_classifier.hashed(data, np.array([0, len(data)]))
        z = float(w[-1]) + sum(quality_classifier.SCALE * float(np.mean(w[f], dtype=np.float64)) for f in fams if len(f))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i]["predicted"] == i % 2 for i in range(40))


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test tables")
def test_ngram_join_finds_every_link_of_the_tables(spark):
    """All pairs of sf0.01's documents by brute force, through an inverted index of their shingles."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets, holders = {}, collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        w = tokens(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for s in sets[r["doc_id"]]:
            holders[s].append(r["doc_id"])
    common = collections.Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    links = collections.Counter()
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links.update((a, b))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(docs).collect()}
    assert sum(links.values()) > 50 and got == {i: links[i] for i in sets}


def test_ngram_join_leaves_only_the_tables_that_its_results_read(spark):
    """Signatures, bands and links go as soon as what reads them is written."""
    from marlstone.llm import common

    d = spark.createDataFrame([(i, f"a b c d e f g {i % 3} {'x ' * (i % 2)}") for i in range(40)], "doc_id long, text string")
    before, setting = set(common._STAGED), spark.conf.get(common.CLEANUP, None)
    rows, known = ngram_join.join(d)
    assert sorted(p.split("marlstone-")[-1].rsplit("-", 1)[0] for p in set(common._STAGED) - before) == ["ngram-final", "ngram-keys", "ngram-part-star", "ngram-star"]
    assert rows.count() == 40 and known.agg({"m": "sum"}).first()[0] == 40
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_suffix_tree_leaves_only_words_and_values(spark):
    """The levels' tables and pairs go once the values are written."""
    from marlstone.llm import common

    d = spark.createDataFrame([(i, f"{'ab'[i % 2]} m1 m2 {'XY'[i % 2]}") for i in range(400)], "doc_id long, text string")
    before = set(common._STAGED)
    tree, counts = suffix_tree.fit(d, suffix_tree.learn_rows())
    assert sorted(p.split("marlstone-")[-1].rsplit("-", 1)[0] for p in set(common._STAGED) - before) == ["lm-values", "lm-words"]
    assert tree.values.count() > 0 and counts.count() == 6
