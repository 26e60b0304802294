"""Metrics, leaderboards, gates and report differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

# What answers say when they are too sure, lack something, or ask back; texts are compared without marks.
TOO_SURE = ("určitě", "zarucene", "garantuji", "bez zdroje", "vždy zdarma", "nikdy neplatíte")
FALLBACK = ("nemohu najít", "nemohu najit", "kontaktujte podporu", "nemám informace", "nemam informace")
UNSUPPORTED = (
    "nemám k dispozici", "nemam k dispozici", "nepodařilo se najít", "nepodarilo se najit", "nemohu ověřit", "nemohu overit", "obraťte se", "obratte se", "kontaktujte",
)
CLARIFY = ("upřesněte", "upresnete", "myslíte", "myslite", "zda jde", "který", "ktery")
PRICE = r"\b\d+[\s.]?\d*\s*(?:kč|kc|czk|eur|€)|\bzdarma\b|\bv ceně\b|\bv cene\b"


def ratio(hit: Column, known: Column | None = None) -> Column:
    """Share of true among the rows whose value is known; null if there is none."""
    return F.round(F.avg(F.when(known, hit.cast("double")) if known is not None else hit.cast("double")), 6)


def precision_at(ranked: DataFrame, relevant: Column, k: int, query: str = "qid") -> DataFrame:
    """Hits among the first k over min(k, returned)."""
    return ranked.where(F.col("rank") <= k).groupBy(query).agg(F.round(F.avg(F.coalesce(relevant, F.lit(False)).cast("double")), 6).alias("precision"))


def leaderboards(df: DataFrame, fields: list[str], metric: str) -> DataFrame:
    """(field, value, n, mean) for each field's values, in one pass by grouping sets."""
    sets = [[F.col(f)] for f in fields]
    out = df.groupingSets(sets, *(F.col(f) for f in fields)).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.grouping_id().alias("g"))
    n = len(fields)
    name = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(fields) for x in ((2**n - 1) ^ (1 << (n - 1 - i)), f))), F.col("g").cast("int"))
    return out.select(name.alias("field"), F.coalesce(*(F.col(f).cast("string") for f in fields)).alias("value"), "n", "mean")


def zero_filled(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return keys.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def gates(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """(kind, name, bound, value, verdict): minimums and maximums; a metric that isn't there is a warning."""
    j = bounds.join(metrics, "name", "left")
    bad = F.when(F.col("kind") == "minimum", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return j.select("kind", "name", "bound", "value", F.when(F.col("value").isNull(), "warning").when(bad, "fail").otherwise("pass").alias("verdict"))


def report_diff(base: DataFrame, cand: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    j = base.select(key, F.col(passed).alias("a")).join(cand.select(key, F.col(passed).alias("b")), key)
    change = F.when(F.col("a") & ~F.col("b"), "new_failure").when(~F.col("a") & F.col("b"), "fixed").when(~F.col("a"), "still_failing").otherwise("passing")
    return j.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, p50, p95 and p99 with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), p.alias("p"))
    return out.select(*by, "n", "mean", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def sessions(events: DataFrame, gap: int, user: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Session numbers by user: a new one after more than gap seconds."""
    w = Window.partitionBy(user).orderBy(ts, order)
    s = F.col(ts).cast("timestamp").cast("double")
    new = F.coalesce((s - F.lag(s).over(w) > gap).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def trailing_count(events: DataFrame, seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))


def last_before(turns: DataFrame, role: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last turn number of that role before each turn."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("last_turn", F.last(F.when(F.col("role") == role, F.col(turn)), ignorenulls=True).over(w))


def regression_deltas(base: DataFrame, cand: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, baseline, candidate, delta, bound, failed) of two tables of (name, value).

    A negative bound is the largest fall allowed, another one the largest rise; a metric that either lacks has no delta
    and doesn't fail.
    """
    j = bounds.join(base.select("name", F.col("value").alias("baseline")), "name", "left").join(cand.select("name", F.col("value").alias("candidate")), "name", "left")
    j = j.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 4))
    bad = F.when(F.col("bound") < 0, F.col("delta") < F.col("bound")).otherwise(F.col("delta") > F.col("bound"))
    return j.select("name", "baseline", "candidate", "delta", "bound", F.coalesce(bad, F.lit(False)).alias("failed"))


def scenario_stats(df: DataFrame, by: str, ts: str, ok: Column, hit: Column, recovered: Column) -> DataFrame:
    """Requests, requests a second, error percentage, hit ratio (unknown excluded) and recovery frequency by scenario;
    no rate for a scenario without duration."""
    at = F.col(ts).cast("timestamp").cast("double")
    out = df.groupBy(by).agg(
        F.count("*").alias("requests"), (F.max(at) - F.min(at)).alias("_span"), ratio(~F.coalesce(ok, F.lit(False))).alias("_bad"),
        ratio(hit, hit.isNotNull()).alias("hit_ratio"), ratio(F.coalesce(recovered, F.lit(False))).alias("recovery_frequency"),
    )
    rate = F.when(F.col("_span") > 0, F.round(F.col("requests") / F.col("_span"), 6))
    return out.select(by, "requests", rate.alias("rps"), F.round(F.col("_bad") * 100, 4).alias("error_rate"), "hit_ratio", "recovery_frequency")


def _said(answer: Column, terms: tuple[str, ...]) -> Column:
    """Whether the folded answer holds one of the terms as they stand (a term with marks never occurs in it)."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(answer, F.lit(t))
    return out


def item_metrics(df: DataFrame) -> DataFrame:
    """df with the metrics of each evaluated answer; a metric that doesn't apply is null.

    df has answer, category, subcategory, sources (array of texts), requires_sources, must (array), must_not (array),
    expected_sources (array), price_texts (array), price (struct amount, currency, period, or null), should_clarify, refuse,
    max_chars, forbid_json, status_code, behaviour, least_grounding and precision.
    """
    has = lambda x, term: F.contains(x, T.fold(term))
    a = F.col("_a")
    any_source, priced = F.size("sources") > 0, a.rlike(PRICE)
    d = df.withColumn("_a", T.fold(F.coalesce("answer", F.lit("")))).withColumn("_s", T.fold(F.array_join("sources", " ")))
    missing = F.filter("must", lambda t: ~has(a, t))
    present = F.filter("must_not", lambda t: has(a, t))
    known = F.size("expected_sources") > 0
    grounding = F.when(any_source | ~F.col("requires_sources"), 0.4).otherwise(0.0) + F.when(known & F.exists("expected_sources", lambda t: has(F.col("_s"), t)), 0.3).when(~known & any_source, 0.2).otherwise(0.0)
    grounding = grounding + F.when(_said(a, ("zdroj", "source")) | any_source, 0.3).otherwise(0.0)
    p = F.col("price")
    part = lambda c: (F.coalesce(c, F.lit("")) == "") | has(a, F.coalesce(c, F.lit("")))
    exact = (F.coalesce(p["amount"], F.lit("")) != "") & part(p["amount"]) & part(p["currency"]) & part(p["period"])
    asks = _said(a, CLARIFY)
    bad_format = (F.col("forbid_json") & F.col("answer").rlike(r"```|[{}]")) | (F.length("answer") > F.col("max_chars"))
    d = d.withColumns({
        "missing": F.array_join(missing, ","), "unexpected": F.array_join(present, ","),
        "hallucination": _said(a, TOO_SURE) | ((F.col("category") == "pricing") & any_source & _said(a, FALLBACK)) | ((F.col("category") == "pricing") & priced & ~any_source),
        "grounding": F.round(F.least(grounding, F.lit(1.0)), 4),
        "price_right": F.when(p.isNotNull(), F.exists("price_texts", lambda t: has(a, t)) | exact),
        "ambiguity_right": F.when(F.col("should_clarify"), asks & ~priced).when(~F.col("should_clarify"), ~asks),
        "refusal_right": F.when(F.col("refuse"), _said(a, UNSUPPORTED) & ~priced),
        "format_right": F.when(F.col("max_chars").isNotNull() | F.col("forbid_json"), ~F.coalesce(bad_format, F.lit(False))),
    })
    return d.withColumn("failure", failure_class()).drop("_a", "_s")


def failure_class() -> Column:
    """The first failure of an answer with its item_metrics, null if there is none."""
    direct, old = F.col("behaviour") == "direct_answer", F.lower(F.col("unexpected")).rlike("archiv|2020|2018")
    is_false = lambda c: F.coalesce(~F.col(c), F.lit(False))
    return (
        F.when(F.col("status_code") >= 500, "api_error").when(is_false("ambiguity_right"), "ambiguity_miss").when(is_false("refusal_right"), "unsupported_answer").when(is_false("format_right"), "format_mismatch")
        .when(direct & ((F.col("requires_sources") & (F.size("sources") == 0)) | (F.col("precision") == 0.0)), "missing_retrieval")
        .when((F.col("unexpected") != "") & old, "stale_pricing").when(F.col("unexpected") != "", "wrong_product_routing")
        .when(is_false("price_right") & (F.col("subcategory") == "pricing"), "stale_pricing").when(is_false("price_right"), "format_mismatch").when(F.col("hallucination"), "hallucination")
        .when(F.col("grounding") < F.col("least_grounding"), "missing_source").when(F.col("missing") != "", "format_mismatch")
    )


def report_summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of item_metrics' rows (with latency_ms); a rate counts the rows that have its metric, null if none."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    passed = F.col("failure").isNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.round(F.avg(passed.cast("double")), 4).alias("pass_rate"), F.round(F.avg("latency_ms"), 1).alias("average_latency_ms"),
        rate("price_right").alias("pricing_accuracy"), rate("hallucination").alias("hallucination_rate"), F.round(1 - F.avg(F.col("refusal_right").cast("double")), 4).alias("unsupported_answer_rate"),
        rate("grounding").alias("avg_grounding"), rate("ambiguity_right").alias("ambiguity_correctness"), rate("format_right").alias("format_rate"), rate("precision").alias("precision_at_3"),
    )
