"""What is computed once for each distinct row, and price rows by it."""

from pyspark.sql import functions as F

from marlstone.operators import tariffs
from marlstone.operators.once import once


def test_once_computes_each_key_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    slow = F.udf(count, "string").asNondeterministic()
    d = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"))
    got = once(d, ["k"], lambda x: x.select("k", slow("k").alias("v"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where("k IS NULL OR k <> '2'"), "test")
    assert sorted(map(tuple, got.groupBy("k", "v", "n").count().collect()), key=repr) == [("1", "1", 1, 300), ("1", "1", 2, 300), (None, None, 1, 300), (None, None, 2, 300)]
    assert seen.value <= 6


def test_equal_table_rows_are_parsed_once(spark, monkeypatch):
    lines = ["| Název | Cena |", "|---|---|", "| Účet Plus | |", "| Vedení | 99 Kč |", " | :-: | - | ", "text", "| Karta Zlatá |", "| Vedení | 99 Kč | x |"]
    tables = spark.range(500).select(F.col("id").alias("table_id"), F.lit("\r\n".join(lines)).alias("m")).union(spark.createDataFrame([(500, "| a | b |\r|--|--|"), (501, None)], "table_id long, m string"))
    rows, seen = [], tariffs.line_cells

    def counted(d):
        rows.append(d.count())
        return seen(d)

    monkeypatch.setattr(tariffs, "line_cells", counted)
    cells = tariffs.repeated_cells(tables, "m")
    assert rows == [4] and cells.count() == 2000
    got = {(r.row_index, r.product_name, r.fee_type, r.fee_value) for r in tariffs.price_rows(cells).collect()}
    assert got == {(1, "Účet Plus – Vedení", "Vedení", "99 Kč"), (3, "Karta Zlatá – Vedení", "Vedení", "99 Kč")}
    assert tariffs.price_rows(cells).count() == 1000
