"""Column functions on rows of their own."""

from pyspark.sql import functions as F

from marlstone.functions import quality as Q
from marlstone.functions import text as T
from marlstone.operators import price_filter as P


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_and_hyphens(spark):
    assert one(spark, T.clean, " a \t b\n\n\n\nc ", None, "") == ["a b\n\nc", None, ""]
    assert one(spark, T.join_hyphens, "exam-\nple účet-\nní") == ["example účetní"]


def test_tokenizers_differ_on_inner_marks(spark):
    assert one(spark, T.index_tokens, "E-konto, (účet)!") == [["e", "konto", "účet"]]
    assert one(spark, T.query_tokens, "E-konto, (účet)! --") == [["e-konto", "účet"]]


def test_signature_ignores_order_not_counts(spark):
    a, b, c = one(spark, T.signature, "b a a", "a b a!", "a b")
    assert a == b != c


def test_dates_and_years(spark):
    assert one(spark, T.document_date, "valid 1. 2. 2024", "on 31122023", "2022-13-01", "none") == ["2024-02-01", "2023-12-31", None, None]
    assert one(spark, T.document_year, "1999 and 2012 or 2007", "none") == [2012, None]


def test_governed_key_keeps_filler_only_queries(spark):
    assert one(spark, T.governed_key, "What is the Fee?", "what is the") == ["fee", "what is the"]


def test_urls(spark):
    assert one(spark, T.normal_url, "HTTPS://Ex.COM//a//b/?q=1#f") == ["https://ex.com/a/b"]
    assert one(spark, T.display_url, "https://ex.com/a/b/c") == ["ex.com/b/c"]


ROW = {"product_name": "Aktivní účet", "fee_type": "Vedení účtu", "fee_value": "99 Kč", "currency": "CZK", "period": "měsíčně", "conditions": "", "confidence": 0.9}
REASONS = [
    ({}, None), ({"fee_type": "Název položky"}, "header_artifact"), ({"product_name": "Sloupec 2"}, "header_artifact"), ({"fee_type": ""}, "missing_fields"), ({"fee_value": None}, "missing_fields"),
    ({"fee_type": "Výběr 25 Kč"}, "merged_column"), ({"fee_type": "x" * 101}, "merged_column"), ({"product_name": "sloupec 2 dále"}, "merged_column"), ({"product_name": "Aktivní \ue000 účet"}, "broken_unicode"),
    ({"fee_type": "PPoojjiiššttěěnníí"}, "garbage_text"), ({"fee_type": "Odlišné jméno", "product_name": "Neznámý název", "fee_value": "viz tam"}, "missing_pricing_value"), ({"confidence": 0.69}, "low_confidence"), ({"confidence": None}, "low_confidence"),
    ({"product_name": "vedení účtu"}, "orphan_product_context"), ({"fee_value": "viz pobočka"}, "missing_amount"), ({"fee_value": "5 %", "currency": ""}, "missing_currency"),
    ({"fee_type": "Výběr z bankomatu", "period": ""}, "missing_period"), ({"fee_type": "Výběr z bankomatu", "period": None, "fee_value": "Zdarma", "currency": None}, None), ({"period": ""}, None), ({"fee_value": "1 200 EUR 5 %", "currency": " "}, None),
]


def test_price_rows_and_their_files(spark, tmp_path):
    rows = [ROW | change for change, _ in REASONS]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "product_name string, fee_type string, fee_value string, currency string, period string, conditions string, confidence double").coalesce(1)
    assert [r.reason for r in P.with_reason(df).collect()] == [x for _, x in REASONS]
    n = P.write_filtered(df, str(tmp_path))
    lost = [x for _, x in REASONS if x]
    assert n["total_input"] == len(rows) and n["valid_output"] == len(rows) - len(lost) == spark.read.json(f"{tmp_path}/valid").count()
    assert sorted(r.reason for r in spark.read.json(f"{tmp_path}/rejected").collect()) == sorted(lost)
    named = {"garbage_ocr": ("garbage_text", "merged_column"), "header_artifact": ("header_artifact",), "broken_unicode": ("broken_unicode",), "low_confidence": ("low_confidence",)}
    want = {k: sum(x in v for x in lost) for k, v in named.items()}
    assert {k: n[f"filtered_{k}"] for k in want} == want and n["filtered_missing_fields"] == len(lost) - sum(want.values()) and len(n) == 13
    assert n["filtered_other"] == n["filtered_scrambled"] == 0


def test_noise(spark):
    assert one(spark, Q.low_information, "", "12345 67890 12345 67890", "A sentence with enough letters in it.") == [True, True, False]
    assert one(spark, Q.scrambled, "a b c d e", "five words that are fine") == [True, False]
    assert one(spark, Q.letter_runs, "PPoojjii") == [4]


def test_blocked_sections(spark):
    assert one(spark, T.blocked_section, "https://ex.org/Novinky/a", "/kariera/x", "https://blog.ex.org/ucty", "https://ex.org/a/muj-blog", "https://ex.org/?q=blog") == [True, True, False, True, False]


def test_scanned_texts_are_stripped_once(spark):
    d = spark.createDataFrame([("  " + " a" * 30,), ("z" * 12 + " and plain words after it, more than fifty of them",), (" \n",), (None,)], "text string").coalesce(1)
    r = d.select(Q.ocr_result(F.col("text")).alias("r")).select("r.score", "r.issues")
    assert r._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [(x.score, list(x.issues)) for x in r.collect()] == [(0.8, ["many_single_character_tokens"]), (0.75, ["repeated_single_chars"]), (0.0, ["empty_output"]), (0.0, ["empty_output"])]
