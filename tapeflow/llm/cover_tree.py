"""Exact top-k by inner product with a dual-tree search over cover trees.

Rows are dealt into blocks by the nearest of a sample of pivots, large cells being split by hash, so a block holds what
lies together.  A block of candidates and a block of queries is indexed once, by a cover tree: a node's points lie within
its covering radius of its centre, which is one of them, and its children's radii are half of it at most.

Pairs of blocks are judged by their roots, and pairs of nodes inside of two blocks likewise: a pair goes if the largest
inner product that the two covering radii allow falls short of the worst k-th score of the query group.  Each query block
meets the block nearest to it first; the k-th scores found there go with its queries to all other blocks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a candidate block and of a query block, and pivots at most.
CANDIDATES, QUERIES, MOST_PIVOTS = 4096, 2048, 2048
#: Points that a leaf of a candidate tree, and of a query tree, holds at most if they aren't equal.
_LEAF, _GROUP = 8, 64
#: Nodes of a candidate tree that are opened at a time, those of the largest bounds first.
_OPEN = 64
#: Parts that pairs of blocks are dealt to when they are judged.
_SALTS = 32
#: Rows up to this number are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 10_000
#: Share that bounds are raised by, more than the rounding of distances can take away.
_SLACK = 1e-6


class Tree:
    """A cover tree in arrays: nodes have a centre (a row of x), a radius, children kids[i]:kids_end[i], and, if a leaf,
    the rows low[i]:high[i] of x, in the order of their ids; equal[i] if all these are the same vector.  A node's first child
    has its centre.

    group: leaves' size; with gather, children of one point each are put together to leaves of that size, whose radius is
    measured anew (for queries, which are judged one by one inside of a leaf).
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, group: int = _LEAF, gather: bool = False):
        by_id = np.argsort(ids, kind="stable")
        x, ids = x[by_id], ids[by_id]
        f = x.astype(float)
        order: list[np.ndarray] = []
        center, radius, low, high, kids, kids_end, equal = [], [], [], [], [], [], []

        def node(c: int, r: float) -> int:
            center.append(c), radius.append(r), low.append(0), high.append(0), kids.append(0), kids_end.append(0), equal.append(False)
            return len(center) - 1

        placed = 0

        def fill(i: int, points: np.ndarray) -> None:
            nonlocal placed
            low[i], high[i], equal[i] = placed, placed + len(points), bool((x[points] == x[points[0]]).all())
            placed += len(points)
            order.append(points)

        todo = []
        if len(x):
            far = np.sqrt(((f - f[0]) ** 2).sum(1))
            todo.append((node(0, float(far.max())), np.arange(len(x)), far))
        while todo:  # no recursion: trees of points at shrinking distances are deep
            i, own, far = todo.pop()
            c, r = center[i], radius[i]
            if len(own) <= group or r == 0:
                fill(i, own)
                continue
            parts, left, near = [], own, far
            sub = f[own]
            norms = (sub**2).sum(1)
            at = c
            while len(left):
                inside = near <= r / 2
                parts.append((at, left[inside], near[inside]))
                left, sub, norms = left[~inside], sub[~inside], norms[~inside]
                if len(left):
                    at = left[0]
                    near = np.sqrt(np.maximum(norms + norms[0] - 2 * (sub @ sub[0]), 0))
                    near[0] = 0.0
            if gather:
                lone = [p[0] for p in parts if len(p[1]) == 1]
                parts = [p for p in parts if len(p[1]) > 1]
                for j in range(0, len(lone), group):
                    some = np.array(lone[j : j + group])
                    parts.append((some[0], some, np.sqrt(((f[some] - f[some[0]]) ** 2).sum(1))))
            kids[i] = len(center)
            for at, points, distance in parts:
                todo.append((node(at, float(distance.max())), points, distance))
            kids_end[i] = len(center)
        rows = np.concatenate(order) if order else np.zeros(0, np.int64)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        self.x, self.ids = x[rows], ids[rows]
        self.center, self.radius = place[np.array(center, np.int64)], np.array(radius)
        self.low, self.high, self.kids, self.kids_end = (np.array(v, np.int64) for v in (low, high, kids, kids_end))
        self.equal = np.array(equal, bool)

    @property
    def root(self) -> tuple[np.ndarray, float]:
        return self.x[self.center[0]].astype(float), float(self.radius[0])


def bound(dot, length_a, radius_a, length_b, radius_b):
    """The largest inner product of points within two balls: dot of the centres, the centres' lengths, the radii."""
    most = dot + length_a * radius_b + length_b * radius_a + radius_a * radius_b
    return most + _SLACK * (1 + np.abs(most) + length_a * length_b)


class Search:
    """Top k of every query of a tree among the candidates of another, by score, then id.

    A query's own id is no candidate of its.  floor: scores below which a query needs no results, as k others reach it.
    pairs counts the inner products computed, centres' among them; whole is their number without pruning.
    """

    def __init__(self, queries: Tree, candidates: Tree, k: int, floor: np.ndarray | None = None):
        self.a, self.b, self.k = queries, candidates, k
        top = max(np.abs(queries.x).max(initial=0), np.abs(candidates.x).max(initial=0))
        self.fast = float(top) ** 2 * max(1, queries.x.shape[1]) < 2**52
        self.q, self.c = (queries.x.astype(float), candidates.x.astype(float)) if self.fast else (queries.x, candidates.x)
        self.length_a, self.length_b = (np.sqrt((t.x.astype(float) ** 2).sum(1)) for t in (queries, candidates))
        n = len(queries.x)
        #: Score of a pair that is out of question.
        self.dead = -1e300 if self.fast else np.iinfo(np.int64).min
        self.scores = np.full((n, k), self.dead)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.worst = np.full(n, -np.inf) if floor is None else floor.astype(float).copy()
        self.pairs, self.whole = 0, n * len(candidates.x)
        if n and len(candidates.x) and k > 0:
            self._walk()

    def _walk(self) -> None:
        """Pairs of nodes from the roots on; the queries of a leaf then search together."""
        a, b = self.a, self.b
        center = a.x[a.center].astype(float)
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            i, nodes = todo.pop()
            own = self._rows(i)
            dots = b.x[b.center[nodes]].astype(float) @ center[i]
            self.pairs += len(nodes)
            most = bound(dots, self.length_a[a.center[i]], a.radius[i], self.length_b[b.center[nodes]], b.radius[nodes])
            nodes = nodes[most >= self.worst[own].min()]
            if not len(nodes):
                continue
            if a.kids[i] == a.kids_end[i]:
                self._leaf(own, nodes)
                continue
            wide = (b.radius[nodes] > a.radius[i]) & (b.kids_end[nodes] > b.kids[nodes])
            if wide.any():
                nodes = np.concatenate([nodes[~wide], _ranges(b.kids[nodes[wide]], b.kids_end[nodes[wide]])])
            todo += [(j, nodes) for j in range(a.kids[i], a.kids_end[i])]

    def _rows(self, i: int) -> np.ndarray:
        """The queries under a node."""
        found, todo = [], [i]
        while todo:
            j = todo.pop()
            if self.a.kids[j] == self.a.kids_end[j]:
                found.append(np.arange(self.a.low[j], self.a.high[j]))
            todo += range(self.a.kids[j], self.a.kids_end[j])
        return np.concatenate(found)

    def _leaf(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Some queries against candidate nodes: centres' scores, then the inside of nodes for those queries whose bounds
        still allow it."""
        b, length = self.b, self.length_a[rows]
        score = self._compare(rows, b.center[nodes])
        opens = 1
        while len(nodes):
            most = bound(score.astype(float), length[:, None], 0.0, self.length_b[b.center[nodes]][None, :], b.radius[nodes][None, :])
            may = most >= self.worst[rows][:, None]
            inside = (b.kids_end[nodes] > b.kids[nodes]) | (b.high[nodes] - b.low[nodes] > 1)
            live = np.nonzero(may.any(0) & inside)[0]
            if not len(live):
                return
            order = live[np.argsort(-np.where(may[:, live], most[:, live], -np.inf).max(0), kind="stable")]
            now, later = order[:opens], order[opens:]
            opens = min(2 * opens, _OPEN)  # few at first: what they hold sets the limit for the others
            kids, scores = [], []
            for i in now:
                node, asks = nodes[i], np.nonzero(may[:, i])[0]
                if b.kids_end[node] == b.kids[node]:  # its centre is one of its points and has its score already
                    points = np.arange(b.low[node], b.high[node])
                    if b.equal[node]:  # of equal scores the least ids count, one of which may be the query's own
                        points = points[: self.k + 1]
                    self._compare(rows[asks], points[points != b.center[node]])
                    continue
                own = np.arange(b.kids[node], b.kids_end[node])
                new = np.full((len(rows), len(own)), self.dead)
                new[asks, 0] = score[asks, i]  # the first child has the node's centre
                new[asks, 1:] = self._compare(rows[asks], b.center[own[1:]])
                kids.append(own)
                scores.append(new)
            nodes, score = np.concatenate([nodes[later], *kids]), np.concatenate([np.where(may[:, later], score[:, later], self.dead), *scores], axis=1)

    def _compare(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Scores of rows with columns; those that reach the k best are taken over."""
        self.pairs += len(rows) * len(columns)
        score = self.q[rows] @ self.c[columns].T
        if not len(columns):
            return score
        ids = self.b.ids[columns]
        live = (score >= self.worst[rows][:, None]) & (ids[None, :] != self.a.ids[rows][:, None])
        for r in np.nonzero(live.any(1))[0]:
            row, hit = rows[r], np.nonzero(live[r])[0]
            if len(hit) > 4 * self.k:
                hit = hit[score[r, hit] >= np.partition(score[r, hit], -self.k)[-self.k]]
            s, i = np.concatenate([self.scores[row], score[r, hit]]), np.concatenate([self.ids[row], ids[hit]])
            order = np.lexsort((i, -s if self.fast else ~s))[: self.k]  # ~s: no overflow at the least integer
            self.scores[row], self.ids[row] = s[order], i[order]
            if self.ids[row, -1] != np.iinfo(np.int64).max:
                self.worst[row] = max(self.worst[row], float(s[order[-1]]))
        return score

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, candidate ids, scores."""
        real = self.ids != np.iinfo(np.int64).max
        return np.repeat(self.a.ids, self.k)[real.ravel()], self.ids[real], self.scores[real].astype(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low[i]:high[i], one after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def dealt(whole: DataFrame, n: int, most: int) -> DataFrame:
    """whole (id, v, dim) with cell and part: the cell of the nearest of some pivots, cells of over `most` rows in parts.

    Pivots are the rows of the least key hashes, one for each `most` rows, MOST_PIVOTS at most.
    """
    count = min(MOST_PIVOTS, -(-n // most) or 1)
    pivots: dict[int, np.ndarray] = {}
    if count > 1:
        for r in whole.select("v", "dim").orderBy(F.xxhash64("id"), "id").limit(count).collect():
            pivots.setdefault(r["dim"], []).append(r["v"])
    held = whole.sparkSession.sparkContext.broadcast({d: np.array(v, float) for d, v in pivots.items()})

    def cells(batches):
        for batch in batches:
            dims, values = batch.column("dim").to_numpy(), batch.column("v")
            cell = np.zeros(len(dims), np.int64)
            for d, p in held.value.items():
                at = np.nonzero(dims == d)[0]
                if d > 0 and len(at):
                    x = values.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d).astype(float)
                    cell[at] = np.argmin((p**2).sum(1)[None, :] - 2 * (x @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    found = whole.mapInArrow(cells, "id long, v array<long>, dim int, cell long")
    sizes = stored(found.groupBy("dim", "cell").agg(F.count("*").alias("size")), "top-k-cells")
    few = sizes.count() <= MOST_BROADCAST
    parts = F.ceil(F.col("size") / F.lit(most))
    return found.join(F.broadcast(sizes) if few else sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("size")


def indexed(blocks: DataFrame, group: int, gather: bool, label: str) -> DataFrame:
    """One row for each block: dim, cell, part, its ids, centre, radius and length of the root, and its tree."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.v.to_numpy()).astype(np.int64).reshape(len(rows), -1)
        if np.abs(x).max(initial=0) < 2**31:
            x = x.astype(np.int32)
        tree = Tree(x, rows.id.to_numpy(), group, gather)
        center, radius = tree.root
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "ids": [tree.ids], "center": [center], "radius": [radius], "length": [float(np.sqrt(center @ center))], "tree": [pickle.dumps(tree)]})

    return stored(blocks.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell long, part long, ids array<long>, center array<double>, radius double, length double, tree binary"), label)


def searched(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, floors: DataFrame | None) -> DataFrame:
    """query_id, vec_id, score of the pairs of blocks (q_cell, q_part, c_cell, c_part of dim), each pair one group."""
    keys = ["dim", "q_cell", "q_part", "c_cell", "c_part"]
    of = lambda df, x: df.select("dim", F.col("cell").alias(f"{x}_cell"), F.col("part").alias(f"{x}_part"), "tree")
    left = pairs.select(*keys).join(of(queries, "q"), ["dim", "q_cell", "q_part"]).withColumn("floor", F.lit(None).cast("array<struct<id:long,worst:double>>"))
    if floors is not None:
        left = left.drop("floor").join(floors, ["dim", "q_cell", "q_part"], "left")
    right = pairs.select(*[F.col(c).alias(c) for c in keys]).join(of(candidates, "c"), ["dim", "c_cell", "c_part"])
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "tree")])  # columns of its own, told apart from left's

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(left) or not len(right):
            return empty
        a, b = pickle.loads(left.tree.iloc[0]), pickle.loads(right.tree.iloc[0])
        known = {f["id"]: f["worst"] for f in left.floor.iloc[0]} if left.floor.iloc[0] is not None else {}
        found = Search(a, b, k, np.array([known.get(i, -np.inf) for i in a.ids.tolist()]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found.results(), strict=True)))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller id.

    queries: a condition on vectors.  Components are floor(scale * x).  Rows whose key or vector is null, or that hold a
    null or non-finite component, take no part; vectors of different lengths aren't compared; a query's own id is none of
    its results; a repeated row is one row.
    """
    x = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    usable = vectors.where(F.col(key).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False)))
    whole = usable.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"), F.size(x).alias("dim"), queries.alias("asks"))
    whole = stored(whole.distinct(), "top-k-vectors")
    n, n_queries = whole.agg(F.count("*"), F.count_if("asks")).first()
    candidates = indexed(dealt(whole.select("id", "v", "dim"), n, CANDIDATES), _LEAF, False, "top-k-candidates")
    asking = indexed(dealt(whole.where("asks").select("id", "v", "dim"), n_queries, QUERIES), _GROUP, True, "top-k-queries")

    def judged(df: DataFrame, x: str, salt) -> DataFrame:
        return df.select("dim", *[F.col(c).alias(f"{x}_{c}") for c in ("cell", "part", "center", "radius", "length")], salt.alias("salt"), *(["worst"] if x == "q" and "worst" in df.columns else []))

    def met(asking: DataFrame) -> DataFrame:
        """All pairs of blocks of one length with the dot product of their roots, dealt by salt."""
        one = judged(asking, "q", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        two = judged(candidates, "c", F.pmod(F.xxhash64("cell", "part"), F.lit(_SALTS)).cast("int"))
        dot = F.aggregate(F.zip_with("q_center", "c_center", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
        return one.join(two, ["dim", "salt"]).withColumn("dot", dot)

    block = ("dim", "q_cell", "q_part")
    nearest = met(asking).groupBy(*block).agg(F.max_by(F.struct("c_cell", "c_part"), F.struct(F.col("dot") / F.greatest("c_length", F.lit(1e-9)), -F.col("c_cell"), -F.col("c_part"))).alias("home"))
    nearest = stored(nearest.select(*block, "home.c_cell", "home.c_part"), "top-k-homes")
    first = stored(searched(nearest, asking, candidates, k, None), "top-k-first")
    # The k-th scores found at home; a query with fewer results has none yet, and its block is judged by no bound.
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    of_query = asking.select(F.explode("ids").alias("query_id"), "dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part"))
    worst = F.coalesce("worst", F.lit(float("-inf")))
    floors = of_query.join(kth, "query_id", "left").groupBy(*block).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), worst.alias("worst"))).alias("floor"), F.min(worst).alias("worst"))
    floors = stored(floors, "top-k-floors")
    judging = asking.join(floors.select("dim", F.col("q_cell").alias("cell"), F.col("q_part").alias("part"), "worst"), ["dim", "cell", "part"])
    most = F.col("dot") + F.col("q_length") * F.col("c_radius") + F.col("c_length") * F.col("q_radius") + F.col("q_radius") * F.col("c_radius")
    most = most + F.lit(_SLACK) * (F.lit(1.0) + F.abs(most) + F.col("q_length") * F.col("c_length"))
    rest = met(judging).where(most >= F.col("worst")).select(*block, "c_cell", "c_part").join(nearest, [*block, "c_cell", "c_part"], "left_anti")
    rest = stored(rest, "top-k-pairs")
    found = first.unionByName(searched(rest, asking, candidates, k, floors.drop("worst")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
