import random

import numpy as np
import pytest

from tapeflow.operators import cells, joins, logs
from tapeflow.operators.windows import running
from tapeflow.plans import join_plans
from pyspark.sql import functions as F


def test_grids_of_many_symbols(spark, monkeypatch):
    rows = [(f"s{k:02d}", t, float(k * t % 7 + t**3)) for k in range(53) for t in range(1, 7) if (k, t) != (52, 3)]
    monkeypatch.setattr(join_plans, "_daily", lambda spark, sf_dir: spark.createDataFrame(rows, "symbol string, ts long, close double"))
    means = {r["symbol"]: (r["n"], round(r["mean_close"], 9)) for r in join_plans.d6(spark, "").collect()}
    own = {s: [v for x, t, v in rows if x == s and t != 3] for s in {r[0] for r in rows}}
    assert means == {s: (5, round(sum(v) / 5, 9)) for s, v in own.items()}
    pairs = join_plans.d7(spark, "").collect()
    assert len(pairs) == 53 * 52 * 2 and {(r["lag"], r["n"]) for r in pairs} == {(1, 4), (2, 3)}


@pytest.fixture
def merging(spark):
    """Many shuffle partitions, which adaptive plans merge as they like."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sums_over_ranges(merging):
    rng = random.Random(5)
    rows = [(rng.randrange(300) / 7, rng.randrange(5)) for _ in range(2000)] + [(1.0, 3)] * 700 + [(None, 9)]
    df = merging.createDataFrame(rows, "v double, n int")
    found = running(df, "v", {"upto": F.col("n"), "rows": F.lit(1)})
    assert found.columns == ["v", "n", "upto", "rows"]
    for r in found.distinct().collect():
        own = [n for v, n in rows if v is not None and r["v"] is not None and v <= r["v"]]
        assert (r["upto"], r["rows"]) == ((9, 1) if r["v"] is None else (sum(own) + 9, len(own) + 1))


def test_ks_distance(merging):
    rng = random.Random(6)
    a, b = [rng.gauss(0, 1) for _ in range(900)] + [2.0] * 500, [round(rng.gauss(0.3, 1), 1) for _ in range(700)]
    frame = lambda x: merging.createDataFrame([(v,) for v in x], "v double")
    share = lambda x, v: sum(u <= v for u in x) / len(x)
    want = max(abs(share(a, v) - share(b, v)) for v in {*a, *b})
    assert abs(logs.ks_distance(frame(a), frame([*b, None]), "v").first()["ks"] - want) < 1e-12
    assert logs.ks_distance(frame(a), frame([]), "v").first()["ks"] is None


def test_lags_are_numbered_alike_in_all_branches(merging):
    rows = [(s, t, float((t * k) % 13)) for t in range(400) for s, k in (("a", 3), ("b", 5), ("c", 7))]
    pairs = joins.lagged_correlations(merging.createDataFrame(rows, "symbol string, ts long, v double"), "v", [1, 2], targets=["a", "b"], sources=["b", "c"]).collect()
    assert sorted((r["target"], r["source"], r["lag"], r["n"]) for r in pairs) == [(t, s, k, 400 - k) for t, s in (("a", "b"), ("a", "c"), ("b", "c")) for k in (1, 2)]
    v = {s: [x for q, _, x in rows if q == s] for s in "abc"}
    x, y = v["a"][2:], v["b"][:-2]
    mx, my = sum(x) / 398, sum(y) / 398
    want = sum((p - mx) * (q - my) for p, q in zip(x, y)) / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
    assert abs(next(r["score"] for r in pairs if (r["target"], r["source"], r["lag"]) == ("a", "b", 2)) - want) < 1e-9


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_equals_all_pairs(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 3)) * (20 if clustered else 0)
    x = np.round(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 3)), 2)
    x[100:160] = x[100]  # ties
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(3001, None, 1.0, 1.0)], "id long, a double, b double, c double")
    queries = [*range(0, 3000, 37), 105, 120]
    found = joins.nearest(df.where(F.col("id").isin([*queries, 3001])), df, ["a", "b", "c"], 4, block=100).collect()
    want = []
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(3000), d)) if j != i][:4]
        want += [(i, int(j), r, round(float(d[j]), 9)) for r, j in enumerate(order, 1)]
    assert sorted((r["left_id"], r["right_id"], r["rank"], round(r["distance"], 9)) for r in found) == sorted(want)


def test_nearest_meets_few_cells(spark):
    """Of all pairs of queries and cells, those that aren't ruled out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))[rng.integers(0, 40, 4000)] * 50 + rng.normal(size=(4000, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    made = cells.Cells(rows, block=100)
    assert len(made.pivots) == 80 and made.counts.all() and made.counts.sum() == 4000
    queries = rows.where("id % 40 = 0").withColumn("kth", F.lit(3.0))
    routes = made.routed(queries, lambda far, f: made.least(far) <= f["kth"].to_numpy()[:, None])
    assert routes.count() < 0.15 * 100 * 40
    assert joins.nearest(spark.createDataFrame([], "id long, a double"), spark.createDataFrame([], "id long, a double"), ["a"], 2).collect() == []
    assert joins.nearest(spark.createDataFrame([(1, 0.0)], "id long, a double"), spark.createDataFrame([(1, 0.0), (2, 5.0)], "id long, a double"), ["a"], 3).count() == 1


@pytest.mark.parametrize("clustered, most", [(True, 0.25), (False, 0.75)])
def test_recurrence_equals_all_pairs(spark, clustered, most):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    if clustered:
        x = rng.normal(size=(15, 16))[rng.integers(0, 15, 1500)] * 4 + x * 0.5
    x[10] = 0
    ids = rng.permutation(5000)[:1500]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec long, e array<double>")
    found = {r["id"]: (r["n_earlier"], r["links"]) for r in joins.recurrence(rows, "e", 0.6, "vec", block=100).collect()}
    u = cells.unit(x)
    s = u @ u.T
    for k, i in enumerate(ids):
        at = [j for j in range(1500) if ids[j] < i and s[k, j] > 0.6]
        assert found[int(i)] == (len(at), [int(ids[j]) for j in sorted(at, key=lambda j: (-s[k, j], ids[j]))[:3]])
    lines = cells.earlier_alike(rows.select(F.col("vec").alias("id"), F.col("e").alias("x")), 0.6, block=100)
    assert lines.agg(F.sum("products")).first()[0] < most * 1500 * 1500


def test_recurrence_meets_few_large_cells_where_angles_rule_out_little(spark):
    """Copies of rows grow with the cells that a row meets; equal vectors count as others do, and go by their ids."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x[1::2] = x[::2]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    lines = cells.earlier_alike(rows, 0.4, block=20).persist()
    assert lines.where("products > 0").count() <= 4000 * 4 * cells.FEW_BLOCKS
    s = cells.unit(x) @ cells.unit(x).T
    got = {r["id"]: r["n"] for r in lines.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert [got.get(i, 0) for i in range(4000)] == [int((s[i, :i] > 0.4).sum()) for i in range(4000)]
    assert {r["id"]: r["other"] for r in lines.where("other >= 0 AND score > 0.999999").collect()} == {i: i - 1 for i in range(1, 4000, 2)}
    lines.unpersist()


def test_dyadic_cover(spark):
    rng = random.Random(7)
    spans = [(a, a + rng.randrange(0, 3 ** rng.randrange(1, 9))) for a in [rng.randrange(-4000, 4000) for _ in range(200)]] + [(5, 4), (-(2**40), 2**40), (0, 0)]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("c", joins.dyadic_cover(F.col("a"), F.col("b")))
    for r in df.collect():
        parts = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in r["c"])
        assert len(parts) <= 2 * max(1, (r["b"] - r["a"] + 1).bit_length())
        edges = [r["a"], *[e for _, e in parts]]
        assert [s for s, _ in parts] == edges[:-1] and edges[-1] == max(r["a"], r["b"] + 1)


def test_windows_of_any_length(spark):
    """One window of 54 years among short ones, at buckets of a minute."""
    rng = random.Random(8)
    second = [rng.randrange(0, 54 * 365 * 86400) for _ in range(400)] + [0, 60, 119, 120]
    spans = [(0, 54 * 365 * 86400), *[(s := rng.randrange(0, 10**9), s + rng.randrange(0, 10 ** rng.randrange(1, 9))) for _ in range(40)], (60, 120), (61, 61), (9, 8)]
    windows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "w int, a long, b long").select("w", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    events = spark.createDataFrame([(i, s) for i, s in enumerate(second)], "e int, s long").select("e", F.timestamp_seconds("s").alias("ts"))
    found = joins.in_windows(windows, events, 60)
    assert found.columns == ["w", "start", "end", "e", "ts"]
    assert sorted((r["w"], r["e"]) for r in found.collect()) == [(i, k) for i, (a, b) in enumerate(spans) for k, s in enumerate(second) if a <= s <= b]
    assert joins.in_windows(windows.limit(0), events, 60).collect() == []
