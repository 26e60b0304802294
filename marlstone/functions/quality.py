"""Noise predicates and scores of short texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAV = r"(?i)\b(menu|home|login|log in|sign in|search|cookie|cookies|accept|close|skip to content|contact us|sitemap)\b"


# Limits, letters and words of the chunk rules.
PENDING = r"(?iu)^(loading|načítání|nactitani|prosím\s*čekejte|please wait)(?:[^\p{L}\p{N}_]|$)"
KNOWN_MARKS = "ÁáČčĎďÉéĚěÍíŇňÓóŘřŠšŤťÚúŮůÝýŽž"
RUN_LETTERS = "A-Za-zÁ-ž"
SCATTERED = r"(?:^|[^\p{L}\p{N}_])(?:[\p{L}\p{N}_]\s+){4,}"
DOTS, MARKS = r"\d{2,}\.\.\d", r"\.{4,}|,{4,}|;{4,}|:{4,}|!{4,}|\?{4,}"
VOCABULARY = (
    "vedení", "poplatek", "cena", "tarifu", "účtu", "správa", "měsíčně", "měsíc", "zřízení", "platba", "karta", "vklad", "výběr", "příchozí", "odchozí", "expresní",
    "vnitrobankovní", "příplatek", "limit", "denní", "měsíční", "roční", "kreditní", "debetní", "mimořádný", "výměna", "blokace", "obnovení", "vydání", "služba", "produkt",
    "účet", "vložení", "výpis", "transakce", "zadání", "změna", "zrušení", "zdarma", "tarif", "sazba", "sazebník", "ceník", "položka", "poplatky", "bankovnictví",
    "internetové", "mobilní", "aplikace", "konto", "osobní", "firemní", "podnikatelské", "hypotéka", "půjčka", "úvěr", "spoření", "investice", "pojištění", "penze", "leasing",
)
NAV_WORDS, CONTENT_WORDS = ("menu", "navigace", "přihlášení", "kontakt", "vyhledávání", "cookies"), ("sazebník", "podmínky", "úrok", "poplatek", "karta", "hypotéka", "úvěr")
SHORT_SCAN, LEAST_OCR = 50, 0.3


def bound(x: Column, made: Callable[[Column], Column]) -> Column:
    """made(x), with x computed once however often made has it."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def _count(x: Column, p: str) -> Column:
    return F.regexp_count(x, F.lit(p))


def _share(x: Column, p: str) -> Column:
    return _count(x, p) / F.greatest(F.length(x), F.lit(1))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def word_list(x: Column) -> Column:
    return F.filter(F.split(x, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def words(x: Column) -> Column:
    return _count(x, r"[^ \t\n\x0b\f\r]+")


def low_information(x: Column) -> Column:
    """Empty, under 20 characters, a notice of loading, or fewer than 10 letters."""
    t = stripped(x)
    return (F.length(t) < 20) | (_count(t, r"\p{L}") < 10) | t.rlike(PENDING)


def navigation(x: Column) -> Column:
    hits, n = _count(x, NAV), words(x)
    return ((n < 10) & (hits >= 2)) | ((n >= 10) & (hits / F.greatest(n, F.lit(1)) > 0.3))


def letter_runs(x: Column) -> Column:
    """Runs of a doubled letter."""
    return _count(x, rf"([{RUN_LETTERS}])\1+")


def corrupted_ocr(x: Column) -> Column:
    """Four scattered letters, digits with two dots between, or a mark four times over."""
    return x.rlike(SCATTERED) | x.rlike(DOTS) | x.rlike(MARKS)


def low_alpha(x: Column) -> Column:
    return (F.length(x) == 0) | (_share(x, r"\p{L}") < 0.40)


def broken_marks(x: Column) -> Column:
    return x.rlike(r"[\x{E000}-\x{F8FF}]") | (_share(x, f"[^\\x00-\\x7f{KNOWN_MARKS}]") > 0.15)


def symbol_noise(x: Column) -> Column:
    return (F.length(x) == 0) | (_share(x, r"[^\p{L}\p{N} \t\n\x0b\f\r]") > 0.20)


def scrambled(x: Column) -> Column:
    """Of five words or more, over 0.35 have one character at most between marks."""
    w = word_list(x)
    one = F.filter(w, lambda t: F.length(F.regexp_replace(t, r"^[.,;:()\[\]{}|!?]+|[.,;:()\[\]{}|!?]+$", "")) <= 1)
    return (F.size(w) >= 5) & (F.size(one) / F.greatest(F.size(w), F.lit(1)) > 0.35)


def garbage(x: Column, runs: int = 3, sure: int = 5) -> Column:
    """Under 10 characters, scrambled, `sure` letter runs, or two of the noise predicates."""
    each = [letter_runs(x) >= runs, corrupted_ocr(x), low_alpha(x), broken_marks(x), symbol_noise(x), scrambled(x)]
    return (F.length(stripped(x)) < 10) | scrambled(x) | (letter_runs(x) >= sure) | (sum(e.cast("int") for e in each) >= 2)


def garbage_chunk(x: Column) -> Column:
    """Low information, navigation, garbage, or over 0.6 digits."""
    return low_information(x) | navigation(x) | garbage(x) | (_share(x, r"\p{N}") > 0.6)


def scored_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """df with score, ocr_noise, reasons and is_garbage of a chunk: 1 - 0.40 (low information) - 0.30 (navigation) - 0.40
    (garbage) - 0.3 * noise, within 0..1. Noise grows with missing letters, letter runs and scrambling.

    Every predicate is a column of its own first, so that the text is searched once for each."""
    x = F.col(text)
    alpha = _share(x, r"\p{L}")
    d = df.withColumns({"_li": low_information(x), "_nav": navigation(x), "_gt": garbage(x), "_runs": letter_runs(x), "_sc": scrambled(x), "_alpha": alpha})
    noise = F.when(F.col("_alpha") < 0.40, 1 - F.col("_alpha") / 0.40).otherwise(F.lit(0.0))
    noise = F.when(F.col("_runs") >= 2, F.least(F.lit(1.0), noise + 0.15 * F.col("_runs"))).otherwise(noise)
    noise = F.when(F.col("_sc"), F.least(F.lit(1.0), noise + 0.30)).otherwise(noise)
    s = 1 - 0.40 * F.col("_li").cast("double") - 0.30 * F.col("_nav").cast("double") - 0.40 * F.col("_gt").cast("double") - 0.3 * F.col("_noise")
    named = [("low_information", F.col("_li")), ("navigation", F.col("_nav")), ("garbage_text", F.col("_gt")), ("repeated_chars", F.col("_runs") >= 2), ("scrambled", F.col("_sc"))]
    why = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda r: r.isNotNull())
    d = d.withColumn("_noise", noise).withColumn("_s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    out = d.withColumns({"score": F.round("_s", 3), "ocr_noise": F.round("_noise", 3), "reasons": F.array_join(why, ","), "is_garbage": (F.col("_s") < 0.35) | F.col("_gt")})
    return out.drop("_li", "_nav", "_gt", "_runs", "_sc", "_alpha", "_noise", "_s")


def vocabulary_share(x: Column, known: tuple[str, ...] = VOCABULARY) -> Column:
    """Share of a text's different words that are known ones."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.size(F.array_intersect(w, F.array(*map(F.lit, known)))) / F.greatest(F.size(w), F.lit(1))


def _present(named: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda r: r.isNotNull())


def ocr_issues(x: Column, engine: Column | None = None) -> tuple[Column, Column]:
    """The two fields of ocr_result."""
    r = ocr_result(x, engine)
    return r["score"], r["issues"]


def ocr_result(x: Column, engine: Column | None = None) -> Column:
    """struct(score, issues) of text from a scan: 1 less 0.35 (short), 0.25 (ten equal characters in a row), 0.20 (few
    blanks), 0.30 (few letters and digits), 0.20 (many single characters) and 0.25 (a low confidence of the engine, if it
    gives one); 0 and empty_output without text. The text is stripped once, and searched once for each rule."""
    single = lambda v: F.filter(v, lambda t: t.rlike(r"^[.,;:()\[\]{}|]*[^.,;:()\[\]{}|][.,;:()\[\]{}|]*\z"))
    rules = [
        ("too_short", lambda t: F.length(t) < SHORT_SCAN, 0.35), ("repeated_single_chars", lambda t: t.rlike(r"(?iu)([^\n\r])\1{9,}"), 0.25),
        ("few_or_no_spaces", lambda t: (F.length(t) > 100) & (_share(t, r"\s") < 0.03), 0.20), ("mostly_non_alphanumeric", lambda t: 1 - _share(t, r"[\p{L}\p{N}]") > 0.55, 0.30),
        ("many_single_character_tokens", lambda t: bound(word_list(t), lambda w: (F.size(w) > 20) & (F.size(single(w)) / F.greatest(F.size(w), F.lit(1)) > 0.35)), 0.20),
    ]
    if engine is not None:
        rules.append(("low_engine_confidence", lambda t: F.coalesce(engine < LEAST_OCR, F.lit(False)), 0.25))

    def result(found: Column) -> Column:
        s = F.lit(1.0)
        for name, _, cost in rules:
            s = s - F.when(found[name], F.lit(cost)).otherwise(F.lit(0.0))
        s = F.round(F.greatest(F.lit(0.0), s), 4)
        issues = _present([*((name, found[name]) for name, _, _ in rules), ("below_min_quality", s < LEAST_OCR)])
        return F.struct(F.when(found["empty"], 0.0).otherwise(s).alias("score"), F.when(found["empty"], F.array(F.lit("empty_output"))).otherwise(issues).alias("issues"))

    facts = lambda t: F.struct((F.length(t) == 0).alias("empty"), *(c(t).alias(name) for name, c, _ in rules))
    return bound(bound(stripped(F.coalesce(x, F.lit(""))), facts), result)


def file_issues(x: Column) -> Column:
    """What is wrong with a file's text, in order."""
    count = lambda low, terms: sum((_count(low, t) for t in terms), F.lit(0))
    only_nav = bound(F.lower(x), lambda low: (count(low, NAV_WORDS) >= 5) & (count(low, CONTENT_WORDS) == 0))
    return bound(meaningful_length(x), lambda m: _present([
        ("empty_file", stripped(x) == ""), ("ocr_garbage_suspected", (F.length(x) > 100) & (ocr_garbage(x, m) > 0.75)), ("boilerplate_or_too_short", m < 200),
        ("nav_only_page", (m < 800) & only_nav),
    ]))


def first_rule(x: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first category any of whose words occurs."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(rules):
        any_ = F.lit(False)
        for t in terms:
            any_ = any_ | F.contains(F.lower(x), F.lit(t))
        out = F.when(any_, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def meaningful_length(x: Column) -> Column:
    """Digits and Latin letters of the text; a null text has none."""
    return F.coalesce(F.length(F.regexp_replace(x, "[^0-9A-Za-z\\u00C0-\\u024F]", "")), F.lit(0))


def ocr_garbage(x: Column, meaningful: Column | None = None) -> Column:
    """Share of other characters in ten-thousandths, halves up (in whole numbers, so exact); 1 for an empty or null text."""
    n = F.length(x).cast("long")
    m = meaningful_length(x) if meaningful is None else meaningful
    half_up = F.floor((F.lit(20000) * (n - m) + n).cast("decimal(38,0)") / (2 * n).cast("decimal(38,0)"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(half_up.cast("double") / 10000)
