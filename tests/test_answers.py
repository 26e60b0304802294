"""Price rows, rules, recovery and sessions on small rows with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from marlstone.operators import pricing, recovery, rules


def test_labels_fold_in_order(spark):
    texts = ["which credit card", "activate my card online", None, "", "CARD fee"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["l"] for r in df.select("i", rules.labels(F.col("t")).alias("l")).collect()}
    assert got[0] == ["cards", "catalog_intent", "credit_card", "credit_card_catalog", "product_overview"]
    assert got[1] == ["online_services"] and got[2] == got[3] == ["general"] and got[4] == ["cards", "pricing"]


def test_merge_recovery_skips_known_keys(spark):
    first = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, key int, rank int")
    second = spark.createDataFrame([("q", 2, 1), ("q", 3, 2), ("q", 3, 3), ("q", 4, 4), ("q", 5, 5), ("r", 9, 1)], "query string, key int, rank int")
    got = sorted(tuple(r) for r in recovery.merge_recovery(first, second).collect())
    assert got == [("q", 1, 1, False), ("q", 2, 2, False), ("q", 3, 3, True), ("q", 4, 4, True), ("r", 9, 1, True)]
    assert recovery.merge_recovery(first.limit(0), second.limit(0)).count() == 0


def test_saved_versions(spark):
    saves = [(1, "s", 0.0, None), (2, "s", 1.0, 1), (3, "s", 2.0, 1), (4, "s", 2.0, 2), (5, "s", 5000.0, 7), (6, None, 0.0, None)]
    df = spark.createDataFrame(saves, "save_id int, session_id string, at double, expected long")
    got = {r["save_id"]: (r["accepted"], r["version"]) for r in recovery.saved_versions(df).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (False, 2), 4: (True, 3), 5: (True, 1), 6: (True, 1)}


def test_fee_slots_prefer_current(spark):
    rows = [(1, "A", "fee", "m", False, 2026, 100, True, 9.0), (2, "a ", "FEE", "m", True, 2020, 10, False, 1.0), (3, "a", "fee", "m", True, 2020, 10, False, 1.0), (4, None, None, None, True, None, 0, False, 0.0)]
    df = spark.createDataFrame(rows, "row_id int, product string, fee string, period string, active boolean, year int, official int, from_table boolean, score double")
    assert sorted(r["row_id"] for r in pricing.fee_slots(df).collect()) == [2, 4]
