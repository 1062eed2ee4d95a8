"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lakeloom import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    absent = lambda x: x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x)
    text = lambda x: "null" if absent(x) else repr(round(float(x), 8)).removesuffix(".0") if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(registry.SQL[name]).df())
