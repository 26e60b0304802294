"""Every registered query with a twin against DuckDB on the smallest tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]

    def same(v):  # pandas holds integers with nulls as floats or with its own null, by where they come from
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, numbers.Real) and not isinstance(v, bool) else v

    return sorted(repr(tuple(map(same, r))) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_quality_flags_read_whole_texts(spark, tmp_path):
    long = "plain words here " * 60_000  # 1 020 000 characters
    texts = [long + chr(0xE000), long + "%" * 600_000, long + "9" * 1_600_000, long + "home " * 120_000, long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["quality_flags"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(registry.ORACLE_SQL["quality_flags"]).df())
    flags = got.set_index("doc_id")
    assert flags.broken_marks[0] and flags.symbol_noise[1] and flags.low_alpha[2] and flags.navigation[3] and not flags.loc[4].any()
