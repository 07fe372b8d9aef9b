import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.llm import cover_tree
from tapeflow.llm.cover_tree import Search, Tree, top_k


def brute(rows, asks, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in whole:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "CANDIDATES", block)
    monkeypatch.setattr(cover_tree, "QUERIES", max(4, block // 8))
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + 0.1 * rng.normal(size=5)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 340)] + [(400, None), (410, [1.0, None, 2.0, 0.0, 0.0]), (420, [math.nan] * 5), (430, [math.inf] * 5), (None, rows[0][1]), (440, [1.0, 2.0]), (450, [0.5, -1.0]), rows[10]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    found = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, 7).collect())
    assert found == brute(rows, lambda i: i % 10 == 0, 7)


def searched(q, q_ids, x, x_ids, k, floor=None):
    return Search(Tree(q, q_ids, 16, True), Tree(x, x_ids), k, floor)


def best(x, queries, k):
    scores = (x[queries] @ x.T).astype(float)
    scores[np.arange(len(queries)), queries] = -np.inf
    return {int(q): sorted(zip(-s, range(len(x))))[:k] for q, s in zip(queries, scores)}


def found_by(search):
    out = {}
    for q, i, s in zip(*search.results()):
        out.setdefault(int(q), []).append((-float(s), int(i)))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("kind", ["groups", "copies", "uniform", "chain"])
def test_search_is_exact(kind):
    rng = np.random.default_rng(1)
    n, d = 1200, 12
    if kind == "groups":
        x = np.concatenate([rng.normal(scale=20, size=(n // 4, d)) + 1000 * c for c in np.eye(d)[:4]])
    elif kind == "copies":  # equal and near copies of a few vectors among others that lie apart
        x = rng.normal(scale=300, size=(n, d))
        x[100:600], x[600:1000] = x[7], x[8] + rng.normal(scale=2, size=(400, d))
    elif kind == "chain":
        x = np.eye(d)[0] * 2.0 ** (-np.arange(n) / 40)[:, None] * 1e6
    else:
        x = rng.normal(scale=300, size=(n, d))
    x = np.floor(x).astype(np.int64)
    queries = np.arange(0, n, 9)
    search = searched(x[queries], queries, x, np.arange(n), 7)
    want = best(x, queries, 7)
    assert found_by(search) == want
    if kind in ("groups", "copies"):
        assert search.pairs < search.whole / 2
    # k-th scores known beforehand change no result and save work.
    floor = np.array([-want[int(q)][-1][0] for q in search.a.ids])
    again = Search(search.a, search.b, 7, floor)
    assert found_by(again) == want and again.pairs <= search.pairs


def test_tree_holds_every_row_within_its_radii():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(scale=50, size=(300, 3)), rng.normal(size=(200, 3))]).astype(np.int64)
    for gather in (False, True):
        tree = Tree(x, np.arange(len(x)), 8, gather)
        assert sorted(tree.ids.tolist()) == list(range(len(x)))
        rows_of = lambda i: list(range(tree.low[i], tree.high[i])) if tree.kids[i] == tree.kids_end[i] else [r for j in range(tree.kids[i], tree.kids_end[i]) for r in rows_of(j)]
        for i in range(len(tree.center)):
            assert (np.sqrt(((tree.x[rows_of(i)] - tree.x[tree.center[i]]) ** 2).sum(1)) <= tree.radius[i] + 1e-6).all()


def test_large_integers_are_exact():
    x = np.array([[2**28 + i, 1] for i in range(50)], np.int64)
    found = searched(x[:1], np.array([0]), x, np.arange(50), 2)
    assert found.scores[0].tolist() == [2**28 * (2**28 + 49) + 1, 2**28 * (2**28 + 48) + 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 10 == 0).count() == 0
