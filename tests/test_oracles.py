"""Every query with a SQL counterpart against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tapeflow.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or hasattr(v, "item") and str(getattr(v, "dtype", "")) == "bool":
        return str(bool(v))
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-5, abs_tol=2e-6)
    except (TypeError, ValueError):
        return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    sql = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = [tuple(r[i] for i in order) for r in sql.fetchall()]
    key = lambda r: tuple(norm(v) for v in r)
    found.sort(key=key)
    expected.sort(key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)
