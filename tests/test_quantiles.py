import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeflow.operators.quantiles import median, quantiles

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p51": 0.51, "p90": 0.9, "p100": 1.0}


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_equal_to_sql(spark, accuracy):
    rng = random.Random(1)
    rows = [("big", rng.lognormvariate(0, 40)) for _ in range(20_000)] + [("ties", float(rng.randrange(4))) for _ in range(5_000)]
    rows += [("same", 1.5)] * 3000 + [(None, float(i)) for i in range(7)] + [("one", -2.0), ("none", None), ("wide", -1e308), ("wide", 1e308), ("wide", 0.0)]
    rows += [(f"g{i % 50}", None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r["k"]: r for r in quantiles(df, ["k"], "v", SHARES, accuracy).collect()}
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["k", "v"])  # noqa: F841
    want = duckdb.sql(f"SELECT k, {', '.join(f'quantile_cont(v, {q}) AS {n}' for n, q in SHARES.items())} FROM frame WHERE v IS NOT NULL GROUP BY k").fetchall()
    assert len(found) == len(want) and "none" not in found
    for k, *values in want:
        assert all(math.isclose(found[k][n], v, rel_tol=1e-12) for n, v in zip(SHARES, values)), k


def test_infinities_and_no_keys(spark):
    df = spark.createDataFrame([(x,) for x in (-math.inf, 1.0, 2.0, math.inf, math.nan)], "v double")
    r = quantiles(df, [], "v", {"a": 0.0, "b": 0.25, "c": 0.75, "d": 1.0}).first()
    assert (r["a"], r["b"], r["c"]) == (-math.inf, 1.0, math.inf) and math.isnan(r["d"])
    assert quantiles(df.limit(0), ["v"], "v", {"a": 0.5}).collect() == []


def test_rows_that_a_task_orders_are_few(spark):
    """Of a group of 200,000 different values, some hundreds are put in order."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plan = median(df, ["k"], "v")
    assert plan.first()["median"] == sorted(i * 7919 % 200_003 for i in range(200_000))[99_999] / 2 + sorted(i * 7919 % 200_003 for i in range(200_000))[100_000] / 2
    text = plan._jdf.queryExecution().toString()
    assert "percentile(" not in text and "Window" in text
