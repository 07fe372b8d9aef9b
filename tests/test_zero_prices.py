"""Queries against their SQL on a tape whose prices are 0 at times, as those of sf0.1 are; the smaller tables have no such price."""

import datetime as dt
import random

import duckdb
import pytest

from tapeflow.plans import registry
from tapeflow.streaming.jobs import window_state

from .test_oracles import close, norm


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Two symbols of 450 rows; prices of 0 alone, at the start and several in a row."""
    random.seed(3)
    folder, start = tmp_path_factory.mktemp("zeros"), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=61 * i), i % 7, "ab"[i % 2], 0.0 if i in (1, 40, 44, 46, 48, 301) else round(random.uniform(1, 90), 2), "{}") for i in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["c5_forward_return", "f8_triadic_state", "m2_direction_features", "m2_direction_head"])
def test_equals_sql(spark, zeros, name):
    folder, con = zeros
    df = registry.QUERIES[name](spark, folder)
    found = [tuple(r) for r in df.collect()]
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(norm(v) for v in r)
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_window_state_equals_the_fold(spark, zeros):
    tapes = {}
    for r in registry.QUERIES["f8_triadic_state"](spark, zeros[0]).join(spark.read.parquet(f"{zeros[0]}/events.parquet").selectExpr("event_id AS seq", "value"), "seq").orderBy("seq").collect():
        prices, states = tapes.setdefault(r["symbol"], ([], []))
        prices.append(r["value"])
        states.append(r["tri"])
    for prices, states in tapes.values():
        assert [window_state(prices[: i + 1]) for i in range(200)] == states[:200]
