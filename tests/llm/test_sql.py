"""The SQL of the corpus operators gives the rows of their queries, nulls, repeats and empty texts included."""

import os

import duckdb
import pytest

from lakeloom.llm import queries
from tests.test_queries import FOLDER, TABLES, rows


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(queries.SQL[name]).df())


def test_mixing_of_many_sources(spark, tmp_path):
    made = [(k, "w " * (k * 7919 % 90), f"s{k * k % 23:02d}") for k in range(700)] + [(900, None, None), (901, "", "s01"), (902, "a b c", None)]
    spark.createDataFrame(made, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["op8_mixing"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(queries.SQL["op8_mixing"]).df())
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) < 0.01 * got["size"].sum()
