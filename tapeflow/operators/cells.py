"""Exact joins by distance: rows are dealt to the cells of pivots, and a row meets only the cells that its bound can't rule out.

A cell is known by its pivot, its rows and the distance of its farthest row, its radius; by the triangle inequality no
row of it is nearer than the distance to the pivot less the radius.  Pivots are a bounded number of rows, and they and a row of
figures for each cell are all that reaches the driver.  Cells are cut into parts, so none has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most pivots; cells grow beyond that.
MOST_PIVOTS = 1024
#: Cells hold at least half this share of all rows where angles rule out little.
FEW_BLOCKS = 24
#: Rounding that bounds allow for, relative and absolute: of lengths, and of angles, which a cosine near 1 gives to fewer digits.
SLACK, ANGLE_SLACK = 1e-9, 1e-7


def stacked(vectors: pd.Series, d: int) -> np.ndarray:
    return np.concatenate(vectors.to_list()).astype(float, copy=False).reshape(len(vectors), d) if len(vectors) else np.empty((0, d))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class Cells:
    """The cells of a frame with columns id and x (arrays of one length, without nulls): pivots, and rows and radius of each."""

    def __init__(self, rows: DataFrame, angles: bool = False, block: int = 2000):
        """angles: distances are angles between vectors, not lengths of their differences.  block: rows that a cell aims at."""
        self.angles, self.block, self.slack = angles, block, ANGLE_SLACK if angles else SLACK
        self.n = rows.count()
        most = min(MOST_PIVOTS, max(1, 2 * self.n // block))  # twice as many as needed, as two may fall into one cluster
        few = rows.orderBy(F.xxhash64("id"), "id").limit(8 * most).select("x").collect()
        self.few = np.array([r["x"] for r in few], float)
        self.pivots = self._spread(self.few, most)
        self.kind = dict(rows.dtypes)["id"]
        self.counts, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        if self.n:
            for r in self.place(rows).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
                self.counts[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
        #: Parts of every cell, so that the largest has few times a block in each.
        self.parts = max(1, -(-int(self.counts.max(initial=0)) // (4 * block)))

    def _spread(self, few: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of a few rows, drawn one by one with chances as the squared distance to those drawn so far."""
        rng, self.pivots, near, chosen = np.random.default_rng(0), few, np.full(len(few), np.inf), []
        while len(chosen) < min(most, len(few)) and (near > 0).any():
            chosen.append(0 if not chosen else int(rng.choice(len(few), p=near**2 / (near**2).sum())))
            self.pivots = few[chosen[-1:]]
            near = np.minimum(near, self.distances(few)[:, 0])
            near[chosen] = 0
        return few[chosen]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From rows to pivots."""
        if self.angles:
            return np.arccos(np.clip(unit(x) @ unit(self.pivots).T, -1.0, 1.0))
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.pivots], 1)

    def least(self, far: np.ndarray) -> np.ndarray:
        """What rows at these distances from the pivots are apart from each cell's rows at least."""
        return np.maximum(far - self.radius - self.slack * (far + self.radius + 1), 0.0)

    def share(self, reach: float) -> float:
        """Of all rows, the share in cells that a row meets which has to meet what is as near as `reach`, by the rows that pivots are drawn from."""
        return float((((self.least(self.distances(self.few)) <= reach) * self.counts).sum(1) / self.n).mean())

    def place(self, rows: DataFrame) -> DataFrame:
        """id, x, cell, far: each row's nearest pivot and the distance to it."""
        cells = self

        def run(frames):
            for f in frames:
                if len(f):
                    far = cells.distances(stacked(f["x"], cells.pivots.shape[1]))
                    yield f[["id", "x"]].assign(cell=far.argmin(1).astype(np.int32), far=far.min(1))

        return rows.mapInPandas(run, f"id {self.kind}, x array<double>, cell int, far double")

    def routed(self, queries: DataFrame, choose: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
        """queries, once for each cell that choose(distances to pivots, rows) -> mask names."""
        cells, names = self, queries.columns

        def run(frames):
            for f in frames:
                if len(f):
                    mask = choose(cells.distances(stacked(f["x"], cells.pivots.shape[1])), f) & (cells.counts > 0)
                    yield f.assign(cells=[np.nonzero(m)[0].astype(np.int32) for m in mask])

        schema = ", ".join(f"{n} {k}" for n, k in queries.dtypes)
        return queries.mapInPandas(run, f"{schema}, cells array<int>").select(*names, F.explode("cells").alias("cell"))

    def met(self, routes: DataFrame, rows: DataFrame, search: Callable, schema: str, part: Column | None = None, parts_of: Column | None = None) -> DataFrame:
        """search(queries, rows) -> frame, over every part of every cell and the queries that are routed there.

        part: the part of a row of `rows`, by default by a hash of its id; parts_of: an array of the parts that a query meets.
        A part's rows come first and are held; the queries stream past them, however many there are.
        """
        every = F.sequence(F.lit(0), F.lit(self.parts - 1))
        asks = routes.select("cell", F.explode(every if parts_of is None else parts_of).alias("part"), F.lit(1).alias("side"), "id", "x")
        own = self.place(rows).withColumn("part", (F.pmod(F.xxhash64("id"), F.lit(self.parts)) if part is None else part).cast("int"))
        both = own.select("cell", "part", F.lit(0).alias("side"), "id", "x").unionByName(asks)

        def run(frames):
            at, held, ready = None, [], None
            for f in frames:
                cell, portion = f["cell"].to_numpy(), f["part"].to_numpy()
                cuts = np.nonzero((np.diff(cell) != 0) | (np.diff(portion) != 0))[0] + 1
                for start, end in zip([0, *cuts], [*cuts, len(f)]):
                    if start == end:
                        continue
                    if (cell[start], portion[start]) != at:
                        at, held, ready = (cell[start], portion[start]), [], None
                    run = f.iloc[start:end]
                    n = int((run["side"] == 0).sum())
                    if n:
                        held.append(run.iloc[:n])
                    if n < len(run) and held:
                        ready = pd.concat(held, ignore_index=True) if ready is None else ready
                        yield search(run.iloc[n:], ready)

        return both.repartition("cell", "part").sortWithinPartitions("cell", "part", "side").mapInPandas(run, schema)


def nearest_rows(left: DataFrame, right: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """left_id, right_id, distance, rank: the k nearest rows of right for each row of left; both have id and x.

    A row of left meets the nearest cells that hold k others, which bounds its k-th distance; then those other
    cells that have something within it.  A row is no neighbour of its own; equal distances go to the least id.
    """
    cells = Cells(right, block=block)
    kind = cells.kind
    if not cells.n:
        return left.sparkSession.createDataFrame([], f"left_id {kind}, right_id {kind}, distance double, rank int")
    d = cells.pivots.shape[1]

    def home(far: np.ndarray, f: pd.DataFrame) -> np.ndarray:
        order = np.argsort(np.where(cells.counts > 0, far, np.inf), axis=1, kind="stable")
        before = np.cumsum(cells.counts[order], 1) - cells.counts[order]
        mask = np.zeros(far.shape, bool)
        np.put_along_axis(mask, order, before < k + 1, 1)
        return mask

    def others(far: np.ndarray, f: pd.DataFrame) -> np.ndarray:
        return ~home(far, f) & (cells.least(far) <= f["kth"].to_numpy(float)[:, None])

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("id")
        p, q, own, ids = stacked(x["x"], d), stacked(y["x"], d), x["id"].to_numpy(), y["id"].to_numpy()
        picks, far = [], []
        for i in range(len(p)):
            e = np.sqrt(((q - p[i]) ** 2).sum(1))
            e[ids == own[i]] = np.inf
            near = np.arange(len(e))
            if len(e) > k + 1:  # all ties of the last one
                near = np.nonzero(e <= e[np.argpartition(e, k)[: k + 1]].max())[0]
            at = near[np.argsort(e[near], kind="stable")][:k]
            at = at[np.isfinite(e[at])]
            picks.append(at)
            far.append(e[at])
        return pd.DataFrame({"left_id": np.repeat(own, [len(a) for a in picks]), "right_id": ids[np.concatenate(picks)], "distance": np.concatenate(far)})

    schema = f"left_id {kind}, right_id {kind}, distance double"
    order = Window.partitionBy("left_id").orderBy("distance", "right_id")
    first = cells.met(cells.routed(left, home), right, best, schema)
    kth = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("left_id").alias("id"), F.col("distance").alias("kth"))
    # fewer than k rows in all: there is no bound
    bound = left.join(kth, "id", "left").select("id", "x", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    found = first.unionByName(cells.met(cells.routed(bound, others), right, best, schema))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def earlier_alike(rows: DataFrame, least: float, top: int = 3, block: int = 2000) -> DataFrame:
    """id, n, other, score, products: for each row (id long, x), earlier ids whose cosine with it exceeds `least`.

    One line for each part that a row has met: how many there are in n, and lines of 0 with the top of them in other and score
    (others have -1, -2).  products: inner products that the line stands for.  A row meets the cells whose nearest angle is
    small enough, of these only the parts whose ids begin before its own; vectors of zeros meet none if least isn't negative.
    """
    from tapeflow.operators.windows import range_block

    if least >= 0:  # a vector of zeros has a cosine of 0 with all
        rows = rows.where(F.exists("x", lambda v: v != 0))
    reach = float(np.arccos(np.clip(least, -1.0, 1.0))) + ANGLE_SLACK
    cells = Cells(rows, angles=True, block=block)
    schema = "id long, n long, other long, score double, products long"
    if not cells.n:
        return rows.sparkSession.createDataFrame([], schema)
    if cells.n // FEW_BLOCKS > block and cells.share(reach) > 0.5:  # where cells rule out little, few large ones spare copies of rows
        cells = Cells(rows, angles=True, block=cells.n // FEW_BLOCKS)
    parts = cells.parts * 2  # ids are cut finer, as a row meets half of them on average
    era = range_block(rows, "id", parts) if parts > 1 else F.lit(0)
    d = cells.pivots.shape[1]

    rough = (d + 8) * 2.0**-22  # what products of single floats are off by at most
    last: dict = {}

    def alike(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if last.get("y") is not y:
            u = unit(stacked(y["x"], d))
            last.update(y=y, u=u, single=u.astype(np.float32).T, ids=y["id"].to_numpy())
        u, single, j = last["u"], last["single"], last["ids"]
        out, step = [], max(1, 2**22 // len(j))
        for start in range(0, len(x), step):
            few = x.iloc[start : start + step]
            i, q = few["id"].to_numpy(), unit(stacked(few["x"], d))
            r, c = np.nonzero(q.astype(np.float32) @ single > np.float32(least - rough))
            s = (q @ u.T)[r, c] if 16 * len(r) > len(i) * len(j) else np.einsum("ij,ij->i", q[r], u[c])
            ok = (s > least) & (j[c] < i[r])
            r, c, s = r[ok], c[ok], s[ok]
            n = np.bincount(r, minlength=len(i))
            out.append(pd.DataFrame({"id": i, "n": n, "other": -1, "score": -2.0, "products": len(j)}))
            order = np.lexsort((j[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            best = np.arange(len(r)) - (np.cumsum(n) - n)[r] < top
            out.append(pd.DataFrame({"id": i[r[best]], "n": 0, "other": j[c[best]], "score": s[best], "products": 0}))
        return pd.concat(out)

    routes = cells.routed(rows.withColumn("era", era.cast("int")), lambda far, f: cells.least(far) <= reach)
    return cells.met(routes, rows, alike, schema, era, F.sequence(F.lit(0), F.col("era")))
