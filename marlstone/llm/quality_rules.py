"""Quality rules whose cutoffs come with a guarantee.

Base rules are fixed. The further rules compare one ratio of a document with a cutoff; the cutoffs of a stratum (language)
are chosen together, from labelled documents that pass the base rules, equal texts counting once. A third of them, by a
hash, proposes: for STEPS allowances up to EPSILON, each rule's cutoff is the strictest that turns away no more than its
share of the allowance of the good documents, if it turns away a larger share of the bad ones. The proposals are nested,
the most lenient first. The other two thirds decide: a proposal holds while the exact binomial test rejects "its rules
together turn away more than EPSILON of the stratum's good documents" at level DELTA / strata. Testing stops at the first
failure, so a stratum's whole sequence costs one test's level, and Bonferroni covers the strata: with probability
1 - DELTA no stratum loses more than EPSILON of its good documents that pass the base rules. Of the proposals that hold
the one that turns away the most bad less good documents of the first third is used, the most lenient on ties. A stratum
with too few labels to prove anything gets no rule, and so do those beyond the STRATA ones with the most labels.

Defined results: a null, empty or wordless text has no words and fails the base rules; a null language is a stratum of
its own; labels that are null or not 0/1 don't count, several labels of one id or text count by the largest; a null id is
judged and has no label; repeated rows are judged each; very long texts are read whole; without labels only the base
rules hold; an empty table gives no row; extra columns, also those named like a count, pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import spare_name, staged

#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
EPSILON, DELTA = 0.01, 0.05
BINS, STEPS, STRATA = 200, 20, 1000
#: Rule name -> value in [0, 1) from the features; larger is worse. word_length is scaled by 50 characters.
RULES = ("symbols", "repeats", "dup_lines", "capitals", "long_words")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def features(texts) -> dict:
    """Counts for an Arrow string column, by row."""
    import numpy as np

    from marlstone.llm import vectext as V

    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    data, off = V.buffers(texts)
    n = len(off) - 1
    out = {k: np.zeros(n, np.int64) for k in FEATURES}
    for i, j in V.slices(off):
        o = off[i : j + 1]
        h, first = V.word_hashes(data, o)
        out["n_words"][i:j] = np.diff(first)
        for a in range(int(o[0]), int(o[-1]), V.WINDOW):  # sums by row, in windows
            seg = data[a : min(a + V.WINDOW, int(o[-1]))]
            cut = np.clip(o - a, 0, len(seg))
            for k, hit in (("word_chars", ~V.SPACE[seg] & ((seg & 0xC0) != 0x80)), ("n_symbols", symbol[seg]), ("n_capitals", (seg >= 65) & (seg <= 90))):
                total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                out[k][i:j] += np.diff(total[cut])
        s, at = V.windows(h, first, 3)
        if len(s):
            row = np.searchsorted(first, at, "right") - 1
            with np.errstate(over="ignore"):
                key = s + V.mix(row.astype(np.uint64))
            _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
            twice = at[times[inv] > 1]
            word = np.zeros(len(h), bool)
            for k in range(3):
                word[twice + k] = True
            total = np.concatenate([[0], np.cumsum(word)])
            out["n_repeat_words"][i:j] = np.diff(total[first])
        for r in range(i, j):
            lines = data[off[r] : off[r + 1]].tobytes().split(b"\n")
            out["n_lines"][r] = len(lines)
            if len(lines) > 1:
                solid = [x for x in lines if x.split()]
                out["n_dup_lines"][r] = len(solid) - len(set(solid))
    return out


def with_features(docs: DataFrame, text_col: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs and a long column for each of FEATURES (under names, where those clash)."""
    names = names or {k: k for k in FEATURES}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[k], T.LongType()) for k in FEATURES)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = features(b.column(b.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[k]) for k in FEATURES)], names=[*b.schema.names, *(names[k] for k in FEATURES)])

    return docs.mapInArrow(run, schema)


def _col(names: dict[str, str], k: str) -> Column:
    return F.col(f"`{names[k]}`")


def base_failed(names: dict[str, str]) -> Column:
    return (_col(names, "n_words") < MIN_WORDS) | (100 * _col(names, "n_repeat_words") > MAX_REPEAT_PERCENT * _col(names, "n_words"))


def _bins(names: dict[str, str]) -> dict[str, Column]:
    c = {k: _col(names, k) for k in FEATURES}
    ratio = {
        "symbols": c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1)),
        "repeats": c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1)),
        "dup_lines": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "capitals": c["n_capitals"] / F.greatest(c["word_chars"], F.lit(1)),
        "long_words": c["word_chars"] / F.greatest(c["n_words"], F.lit(1)) / 50,
    }
    return {k: F.least(F.floor(ratio[k] * BINS), F.lit(BINS - 1)).cast("int") for k in RULES}


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials at p, exactly summed."""
    if n <= 0 or k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def propose(counts: dict[str, dict[int, tuple[int, int]]], epsilon: float = EPSILON) -> tuple[list[list[int]], list[float]]:
    """The cutoffs (smallest rejected bin of each of RULES, BINS for none) at every step, and the sum of the rules' gains,
    from rule -> bin -> (good, bad) counts."""
    cuts, gains = [[BINS] * len(RULES) for _ in range(STEPS)], [0.0] * STEPS
    for r, rule in enumerate(RULES):
        by_bin = counts.get(rule, {})
        good, bad = (max(1, sum(x[i] for x in by_bin.values())) for i in (0, 1))
        off_good, off_bad, step, best = 0, 0, 0, (0.0, BINS)
        for b in range(BINS - 1, -1, -1):
            g, w = by_bin.get(b, (0, 0))
            off_good, off_bad = off_good + g, off_bad + w
            while step < STEPS and (b == 0 or off_good > epsilon * (step + 1) / STEPS / len(RULES) * good):
                gains[step], cuts[step][r] = gains[step] + best[0], best[1]
                step += 1
            gain = off_bad / bad - off_good / good
            if gain > best[0]:
                best = (gain, b)
    return cuts, gains


def certify(gains: list[float], turned: list[tuple[int, int]], good: int, strata: int, epsilon: float = EPSILON, delta: float = DELTA) -> int | None:
    """The step to use, from the (good, bad) documents that each step turns away beyond the step before, of `good` in all."""
    best, off = (0.0, None), 0
    for step, (g, _) in enumerate(turned):
        off += g
        if off > epsilon * good or binomial_at_most(off, good, epsilon) > delta / strata:
            break
        if gains[step] > best[0] + 1e-12:
            best = (gains[step], step)
    return best[1]


def _stratum(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{col}`").cast("string")), F.lit(""))


def calibrate(feats: DataFrame, labels: DataFrame, names: dict[str, str], id_col: str, stratum_col: str, hash_col: str, epsilon: float = EPSILON, delta: float = DELTA) -> dict[str, list[int]]:
    """stratum -> cutoffs, from all labelled documents that pass the base rules.

    Only counts by stratum and bin or step come to the driver: at most STRATA * rules * BINS rows, whatever the input.
    """
    spark = feats.sparkSession
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_lab_id")).agg(F.max("quality").cast("long").alias("_good"))
    bins = _bins(names)
    rows = feats.where(~base_failed(names)).select(F.col(f"`{id_col}`").alias("_id"), _stratum(stratum_col).alias("_s"), F.col(f"`{hash_col}`").alias("_h"), F.array(*(bins[k] for k in RULES)).alias("_b"))
    rows = rows.join(lab, F.col("_id") == F.col("_lab_id")).groupBy("_s", "_h").agg(F.max("_good").alias("_good"), F.max("_b").alias("_b"))
    rows = staged(rows.withColumn("_first", F.pmod(F.xxhash64("_h", F.lit(5)), F.lit(3)) == 0), "rules-labelled")
    needed = math.log(delta) / math.log1p(-epsilon)  # fewer good documents prove nothing even with none turned away
    by = rows.groupBy("_s").agg(F.sum(F.when(~F.col("_first"), F.col("_good"))).alias("n")).where(F.col("n") >= needed)
    good = {r["_s"]: r["n"] for r in by.orderBy(F.desc("n"), "_s").limit(STRATA).collect()}
    if not good:
        return {}
    one = F.broadcast(spark.createDataFrame([(k,) for k in good], "_s string"))
    tall = rows.where("_first").join(one, "_s").select("_s", "_good", F.posexplode("_b").alias("_r", "_bin"))
    counts: dict[str, dict[str, dict[int, tuple[int, int]]]] = {}
    for r in tall.groupBy("_s", "_r", "_bin").agg(F.sum("_good").alias("g"), F.sum(1 - F.col("_good")).alias("w")).collect():
        counts.setdefault(r["_s"], {}).setdefault(RULES[r["_r"]], {})[r["_bin"]] = (r["g"], r["w"])
    plans = {k: propose(v, epsilon) for k, v in counts.items()}
    if not plans:
        return {}
    table = F.broadcast(spark.createDataFrame([(k, c) for k, (c, _) in plans.items()], "_s string, _cuts array<array<int>>"))
    off = F.transform("_cuts", lambda c: F.exists(F.zip_with(c, F.col("_b"), lambda x, y: y >= x), lambda z: z))
    steps = rows.where(~F.col("_first")).join(table, "_s").select("_s", "_good", F.array_position(off, F.lit(True)).alias("_step")).where("_step > 0")
    turned = {k: [(0, 0)] * STEPS for k in plans}
    for r in steps.groupBy("_s", "_step").agg(F.sum("_good").alias("g"), F.sum(1 - F.col("_good")).alias("w")).collect():
        turned[r["_s"]][r["_step"] - 1] = (r["g"], r["w"])
    chosen = {k: certify(gains, turned[k], good[k], len(good), epsilon, delta) for k, (_, gains) in plans.items()}
    return {k: plans[k][0][step] for k, step in chosen.items() if step is not None}


def judged(feats: DataFrame, names: dict[str, str], stratum_col: str, cutoffs: dict[str, list[int]], verdict_col: str) -> DataFrame:
    """feats with a verdict, true for kept documents. The cutoffs, of STRATA strata at most, are broadcast."""
    if not cutoffs:
        return feats.withColumn(verdict_col, ~base_failed(names))
    key, cut = spare_name(feats, "rules_stratum"), spare_name(feats, "rules_cutoffs")
    table = feats.sparkSession.createDataFrame(list(cutoffs.items()), f"{key} string, {cut} array<int>")
    j = feats.join(F.broadcast(table), _stratum(stratum_col) == F.col(key), "left")
    bins = F.array(*(_bins(names)[k] for k in RULES))
    off = F.coalesce(F.exists(F.zip_with(F.col(cut), bins, lambda x, y: y >= x), lambda z: z), F.lit(False))
    return j.withColumn(verdict_col, ~(base_failed(names) | off)).drop(key, cut)


def score_documents(docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document. The texts are read once: the counts are staged."""
    names = {k: k for k in FEATURES}
    d = docs.select("doc_id", F.col("lang").alias("stratum"), F.xxhash64("text").alias("hash"), "text")
    feats = staged(with_features(d, "text", names).drop("text"), "rules")
    cutoffs = calibrate(feats, labels, names, "doc_id", "stratum", "hash", epsilon, delta)
    return judged(feats, names, "stratum", cutoffs, "kept").select("doc_id", *FEATURES, base_failed(names).alias("base_failed"), "kept")


def keep_documents(docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns. The texts are read once: they are staged with the counts."""
    names = {k: spare_name(docs, f"rules_{k}") for k in FEATURES}
    own = [spare_name(docs, c) for c in ("rules_lang", "rules_hash", "rules_kept")]
    d = docs.withColumn(own[0], F.col("lang")).withColumn(own[1], F.xxhash64("text"))
    feats = staged(with_features(d, "text", names), "rules")
    cutoffs = calibrate(feats, labels, names, "doc_id", own[0], own[1], epsilon, delta)
    return judged(feats, names, own[0], cutoffs, own[2]).where(F.col(own[2])).select(*(F.col(f"`{c}`") for c in docs.columns))
