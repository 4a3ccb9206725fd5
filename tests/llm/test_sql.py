"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    df = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
