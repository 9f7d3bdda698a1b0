"""Queries of the operators that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from tidemill.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name, size):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{size}/{t}.parquet'")
    df = queries.queries()[name](spark, f"{DATA}/{size}")
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]}) t").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want)
    kinds = {r[0]: r[1] for r in con.execute(f"describe {queries.oracle_sql()[name]}").fetchall()}
    assert {c: {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}[k] for c, k in df.dtypes} == kinds
