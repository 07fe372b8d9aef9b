"""Whole queries that have a SQL form, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tapeflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = QUERIES[name](spark, SF)
    sql = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in sql.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(sql.fetchall())
