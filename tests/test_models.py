"""Queries that SQL cannot express, against plain numpy and loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import models as m
from tapeflow.operators import windows as w
from tapeflow.operators.spectral import spectral_features
from tapeflow.operators.tracking import track
from tapeflow.plans import registry
from tapeflow.plans.fixtures import steps

SF = "/root/testdata/sf0.001"


def frame(spark, columns):
    rows = steps(spark, SF).select("symbol", "ts", "seq", *columns).orderBy("symbol", "ts", "seq").collect()
    return rows, {c: np.array([r[c] if r[c] is not None else np.nan for r in rows], float) for c in columns}


def test_spectral_features(spark):
    df = steps(spark, SF).withColumn("r", w.returns(log=True)).select("symbol", "ts", "seq", "r")
    rows = df.orderBy("symbol", "ts", "seq").collect()
    found = {r["seq"]: r for r in spectral_features(df, "r", 8, 32).collect()}

    def one(x):
        x = np.array(x) / max(np.median(np.abs(np.array(x) - np.median(x))), 1e-9)
        power = [abs(sum(v * complex(math.cos(2 * math.pi * f * i / len(x)), -math.sin(2 * math.pi * f * i / len(x))) for i, v in enumerate(x))) ** 2 for f in range(len(x) // 2 + 1)]
        return sum(v * v for v in x) / len(x), abs(sum(x)) / sum(abs(v) for v in x), max(power) / sum(power)

    checked = 0
    for s in {r["symbol"] for r in rows}:
        own = [(r["seq"], r["r"]) for r in rows if r["symbol"] == s and r["r"] is not None]
        for i in range(31, len(own), 17):
            r = found[own[i][0]]
            a, b = one([v for _, v in own[i - 7 : i + 1]]), one([v for _, v in own[i - 31 : i + 1]])
            assert np.allclose([r["e1"], r["c1"], r["s1"], r["e2"], r["c2"], r["s2"]], [*a, *b], rtol=1e-6)
            assert np.allclose([r["delta_e"], r["delta_c"], r["delta_s"]], np.abs(np.array(a) - b), rtol=1e-5, atol=1e-9)
            checked += 1
        assert own[30][0] not in found
    assert checked > 20


def test_component_tracking(spark):
    rng = random.Random(3)
    cells = {(t, b) for t in range(30) for b in range(12) if rng.random() < 0.5}
    df = spark.createDataFrame([("A", t, b) for t, b in cells], "symbol string, slice long, bin int")
    found = {r["ts"]: (r["alive"], r["born"], r["ended"], r["lasted"]) for r in track(df, "slice", "bin").collect()}
    active, name = {}, 0  # name -> (born at, bins)
    for t in range(30):
        bins, runs = sorted(b for s, b in cells if s == t), []
        for b in bins:
            if runs and runs[-1][-1] == b - 1:
                runs[-1].append(b)
            else:
                runs.append([b])
        now, born = {}, 0
        for run in runs:
            share = {c: len(set(run) & set(x)) for c, (_, x) in active.items() if set(run) & set(x)}
            if share:
                now[max(share, key=share.get)] = (active[max(share, key=share.get)][0], run)
            else:
                now[name], name, born = (t, run), name + 1, born + 1
        gone = [active[c][0] for c in active if c not in now]
        assert found[t] == (len(now), born, len(gone), sum(t - x for x in gone))
        active = now


def test_huber_errors(spark):
    found = {r["seq"]: r["ell_hat"] for r in registry.QUERIES["m4_huber_errors"](spark, SF).collect()}
    rows, v = frame(spark, ["ell", "p_bad", "exposure", "ret"])
    keep = ~np.isnan(v["ret"])
    x = np.stack([(v[c][keep] - v[c][keep].mean()) / v[c][keep].std() for c in ("ell", "p_bad", "exposure")] + [np.ones(keep.sum())], 1)
    y = v["ret"][keep]
    solve = lambda s: np.linalg.solve((x * s[:, None]).T @ x + np.eye(4), (x * s[:, None]).T @ y)
    c = solve(np.ones(len(y)))
    for _ in range(5):
        e = np.abs(y - x @ c)
        c = solve(np.where(e <= 0.3, 1.0, 0.3 / np.maximum(e, 1e-300)))
    e = np.abs(y - x @ c)
    want = np.exp(-math.log(2) * e / max(np.median(e), 1e-9))
    assert len(found) == len(y)
    assert np.allclose([found[r["seq"]] for r, k in zip(rows, keep) if k], want, atol=2e-6)


def test_principal_axes(spark):
    found = sorted((r["axis"], r["explained"]) for r in registry.QUERIES["m8_principal_axes"](spark, SF).collect())
    _, v = frame(spark, ["ell", "p_bad", "exposure", "price"])
    z = np.stack([(x - x.mean()) / x.std() for x in v.values()], 1)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose([x for _, x in found], (values / values.sum())[:2], atol=2e-6)


@pytest.mark.parametrize("soft", [False, True])
def test_softmax_heads(spark, soft):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    p = 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.3)))
    share = p if soft else (rng.random(400) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(1 - s), float(s), int(s)) for (a, b), s in zip(x, share)], "x0 double, x1 double, p0 double, p1 double, label int")
    model = m.softmax_head(df, ["x0", "x1"], {"a": "p0", "b": "p1"} if soft else None, None if soft else "label", rounds=200)
    rows = model.coefficientMatrix.toArray()
    got = [*(rows[1] - rows[0]), model.interceptVector[1] - model.interceptVector[0]]
    design, c = np.column_stack([x, np.ones(400)]), np.zeros(3)
    for _ in range(50):  # Newton's steps on the same likelihood
        q = 1 / (1 + np.exp(-design @ c))
        c += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design, design.T @ (share - q))
    assert np.allclose(got, c, atol=2e-3)


def test_direction_head_to_the_last_digits(spark):
    """Weights as those of many plain steps, also from rows dealt in another way."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 101, (3000, 2)) / 100
    label = np.where(rng.random(3000) < 0.3 + 0.3 * x[:, 0], 1, np.where(rng.random(3000) < x[:, 1], 2, 0))
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, label)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, label int")
    got = m.newton_head(df, ["x0", "x1"], "label", 1, [0, 2])
    design, w = np.column_stack([x, np.ones(3000)]), np.zeros((2, 3))
    y = np.stack([label == 0, label == 2]).astype(float)
    for _ in range(30):
        e = np.exp(w @ design.T)
        p = e / (1 + e.sum(0))
        h = np.block([[(design * (p[a] * ((a == b) - p[b]))[:, None]).T @ design for b in (0, 1)] for a in (0, 1)])
        w += np.linalg.solve(h, ((y - p) @ design).ravel()).reshape(2, 3)
    assert np.allclose([got[0], got[2]], w, rtol=1e-10, atol=1e-12)
    again = m.newton_head(df.orderBy(F.xxhash64("x0", "x1")).repartition(7), ["x0", "x1"], "label", 1, [0, 2])
    assert np.allclose([again[0], again[2]], w, rtol=1e-10, atol=1e-12)


def test_head_queries_name_every_class(spark):
    scored = registry.QUERIES["m2_direction_head"](spark, SF).collect()
    assert sorted(r["label"] for r in scored) == [0, 1, 2] and all(0 <= r["accuracy"] <= 1 for r in scored)
    weights = registry.QUERIES["m3_soft_label_head"](spark, SF)
    assert weights.select("cls", "feature").distinct().count() == weights.count() == weights.where(F.abs("weight") >= 0).count()


def test_label_weights(spark):
    """Three rounds equal plain numpy on the same pairs; few rows, unsure rows and vectors that don't learn change nothing."""
    rng = np.random.default_rng(8)
    columns = [c for own in m.HEADS.values() for c in own]
    values = rng.random((260, len(columns)))
    values[::9, 7] = np.nan
    labels = ["T"] * 120 + ["H"] * 100 + ["R"] * 30 + [None] * 10
    target = [None if i % 50 == 3 else float(t) for i, t in enumerate(rng.integers(-3, 4, 260) / 300)]
    sure = [0.1 if i % 13 == 0 else 0.9 for i in range(260)]
    schema = "label string, key long, target double, sure double, " + ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame([(g, i, t, s, *map(float, v)) for i, (g, t, s, v) in enumerate(zip(labels, target, sure, values))], schema)
    learn = ("score", "size", "mny")
    found = m.label_weights(df, "label", "key", "target", "sure", 0.5, learn, 3, 40, 0.5, 0.002, 0.01, 0.01)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["pos"]):
        got.setdefault((r["label"], r["vector"]), []).append(r["weight"])
    x = values.copy()
    x[:, :6] = (x[:, :6] - x[:, :6].mean(0)) / x[:, :6].std(0)
    at = 6
    for head in list(m.HEADS)[1:]:
        own = x[:, at : at + len(m.HEADS[head])]
        share = own / own.sum(1, keepdims=True)
        share[np.isnan(share).any(1)] = 1 / own.shape[1]
        x[:, at : at + own.shape[1]] = np.log(share)
        at += own.shape[1]
    order = lambda i, r: (int(hashlib.md5(f"{i}/7/{r}".encode()).hexdigest()[:12], 16), i)
    for g in ("T", "H", "R"):
        w = m.start_weights(g)
        rows = [i for i in range(260) if labels[i] == g and target[i] is not None and sure[i] >= 0.5]
        for r in range(3 if len(rows) >= 40 else 0):
            own = sorted(rows, key=lambda i: order(i, r))[:40]
            pairs = [(a, b) for a, b in zip(own[::2], own[1::2]) if target[a] != target[b]]
            full = np.concatenate([w[h] for h in m.HEADS])
            slope = np.mean([-y / (1 + math.exp(y * (d @ full))) * d for a, b in pairs for y, d in [(np.sign(target[a] - target[b]), x[a] - x[b])]], axis=0) / 40
            at = 0
            for h, names in m.HEADS.items():
                own_slope, at = slope[at : at + len(names)], at + len(names)
                if h in learn:
                    p = w[h] / w[h].sum()
                    level = np.log(p) + 1
                    own_slope = own_slope + 0.02 * (w[h] - m.start_weights(g)[h]) + 0.01 * (level - (p * level).sum()) / w[h].sum()
                    norm = np.linalg.norm(own_slope)
                    step = np.clip(w[h] - 0.5 * own_slope * min(1, 0.002 / norm), 0, 1)
                    w[h] = step / step.sum()
        for h in m.HEADS:
            assert np.allclose(got[g, h], w[h], atol=1e-12)
            assert (h in learn and g != "R") == (not np.allclose(got[g, h], m.start_weights(g)[h], atol=1e-9))
    assert len(got) == 15


def test_shuffles_are_bijections(spark):
    """Every place once for each key, and no order is left."""
    from tapeflow.operators.gates import shuffled

    for n in (1, 2, 7, 500):
        df = spark.range(n).withColumn("key", F.explode(F.array(*[F.lit(x).cast("bigint") for x in range(1, 9)])))
        found = df.withColumn("j", shuffled(F.col("id"), F.lit(n).cast("bigint"), F.col("key"))).collect()
        for key in range(1, 9):
            own = sorted((r["id"], r["j"]) for r in found if r["key"] == key)
            assert sorted(j for _, j in own) == list(range(n))
            if n == 500:
                assert abs(np.corrcoef(np.array(own).T)[0, 1]) < 0.2 and sum(i == j for i, j in own) < 10


@pytest.mark.parametrize("n, end, nearest", [(1, 0, False), (7, 0, False), (7, 1, True), (4, 3, False)])
def test_sliding_quantiles(spark, n, end, nearest):
    from tapeflow.operators.spectral import sliding

    rng = random.Random(9)
    rows = [(s, i, i, None if rng.random() < 0.2 else rng.randrange(20) / 4) for s in "ab" for i in range(60)]
    found = {(r["symbol"], r["seq"]): r["q"] for r in sliding(spark.createDataFrame(rows, "symbol string, ts long, seq long, v double"), "v", n, 0.3, "q", end, nearest, least=2).collect()}
    for s in "ab":
        own = [v for q, _, _, v in rows if q == s]
        for i in range(60):
            seen = sorted(v for v in own[max(0, i - end - n + 1) : max(0, i - end + 1)] if v is not None)
            at = 0.3 * (len(seen) - 1)
            want = None if len(seen) < 2 else seen[math.floor(at + 0.5)] if nearest else float(np.quantile(seen, 0.3))
            assert (found[s, i] is None) == (want is None) and (want is None or abs(found[s, i] - want) < 1e-12)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_quotient_features_of_each_window(spark, batch):
    """Every row against its own window, in batches of any size; unknown and non-positive prices among them."""
    from tapeflow.operators.features import FEATURES, quotient_features

    rng = np.random.default_rng(12)
    prices = {s: np.exp(np.cumsum(rng.normal(0, 0.1, 90))) for s in ("a", "b")}
    prices["b"][[20, 21, 50]] = [np.nan, -1.0, 0.0]
    rows = [(s, i, i, None if np.isnan(p) else float(p), "more") for s in prices for i, p in enumerate(prices[s])] + [("short", 0, 0, 1.0, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r["symbol"], r["seq"]): r for r in quotient_features(spark.createDataFrame(rows, "symbol string, ts long, seq long, price double, x string").repartition(3), 5, 16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 181 and found["a", 3]["x"] == "more" and [found["short", 0][f] for f in FEATURES] == [0.0] * 6
    e, w1, w2 = 1e-6, 5, 16
    for s, own in prices.items():
        p = np.log(np.where(np.isnan(own), np.nan, np.maximum(own, e)))
        raw = np.append(np.nan, np.diff(p))
        r, c = np.nan_to_num(raw), np.nan_to_num(raw - 2 * np.append(np.nan, raw[:-1]) + np.append([np.nan] * 2, raw[:-2]))
        rx = np.nan_to_num(raw * np.append(np.nan, raw[:-1]))
        for t in range(90):
            got = [found[s, t][f] for f in FEATURES]
            if t < w2:
                assert got == [0.0] * 6
                continue
            x, ps = r[t - w2 + 1 : t + 1], p[t - w2 + 1 : t + 1]
            v, d2 = x.var(), c[t - w2 + 3 : t + 1]
            fall = max((ps[i] - ps[j] for i in range(w2) for j in range(i, w2) if not np.isnan(ps[i] - ps[j])), default=np.nan)
            m = x.mean()
            s01 = rx[t - w2 + 2 : t + 1].sum() - m * (x[:-1].sum() + x[1:].sum()) + (w2 - 1) * m * m
            scale = math.sqrt(((x[:-1] - m) ** 2).sum() * ((x[1:] - m) ** 2).sum())
            want = [math.sqrt(v + e) / (x.max() - x.min() + e), math.log1p(math.sqrt(d2.var() + e)), fall / (abs(ps[-1] - ps[0]) + e), np.abs(x).sum() / (math.sqrt((x * x).sum()) + e), max(-1, min(1, s01 / scale)) if scale > 0 else 0, math.sqrt(r[t - w1 + 1 : t + 1].var() + e) / (math.sqrt(v + e) + e)]
            for f, a, b in zip(FEATURES, got, want):
                assert (a is None and np.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7), (s, t, f)


def test_places_are_those_of_shuffled(spark):
    from tapeflow.operators.gates import places, shuffled

    for n in (1, 2, 7, 100, 2_000_000_011):
        i = np.unique(np.linspace(0, n - 1, 40).astype(np.int64))
        df = spark.createDataFrame([(int(x), key) for x in i for key in (1, 5)], "id long, key long")
        found = {(r["id"], r["key"]): r["j"] for r in df.withColumn("j", shuffled(F.col("id"), F.lit(n).cast("bigint"), F.col("key"))).collect()}
        for key in (1, 5):
            assert places(i, np.full(len(i), n, np.int64), key).tolist() == [found[int(x), key] for x in i]
