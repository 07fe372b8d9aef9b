"""The feature tape: six features of trailing log returns, found for whole stretches of a tape at once.

Rows stream through by symbol and time in Arrow batches; a task keeps the prices of one window of a tape from batch to batch.
Every frame is made of the end of one block of rows and the start of the next: what grows from a block's start and what
grows from its end make up all sums, extremes and drops of the frames, so a row costs the same however long its windows are, and
no sum runs over more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("vol_ratio", "curvature", "drawdown", "burstiness", "acorr_1", "var_ratio")


class Frames:
    """The trailing n values that end at each place of an array, from the n-th place on."""

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n
        self.start = np.arange(size - n + 1)
        self.end = self.start + n - 1
        self.whole = self.start % n == 0  # the frame is a block
        self.pad = -size % n

    def _blocks(self, x: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate([x, np.full(self.pad, fill)]).reshape(-1, self.n)

    def grown(self, x: np.ndarray, f: np.ufunc, fill: float) -> tuple[np.ndarray, np.ndarray]:
        """f over each block from its start to each place, and from each place to its end."""
        b = self._blocks(x, fill)
        return f.accumulate(b, axis=1).ravel(), f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()

    def over(self, x: np.ndarray, f: np.ufunc, fill: float) -> np.ndarray:
        up, down = self.grown(x, f, fill)
        return np.where(self.whole, up[self.end], f(down[self.start], up[self.end]))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return self.over(x, np.add, 0.0)

    def falls(self, x: np.ndarray) -> np.ndarray:
        """The largest drop from a value of the frame to a later one; unknown values (NaN) take no part."""
        high_up, high_down = self.grown(x, np.fmax, np.nan)
        low_up, low_down = self.grown(x, np.fmin, np.nan)
        b = self._blocks(x, np.nan)
        fall_up = np.fmax.accumulate(high_up.reshape(b.shape) - b, axis=1).ravel()
        fall_down = np.fmax.accumulate((b - low_down.reshape(b.shape))[:, ::-1], axis=1)[:, ::-1].ravel()
        i, j = self.start, self.end
        across = np.fmax(np.fmax(fall_down[i], fall_up[j]), high_down[i] - low_up[j])
        return np.where(self.whole, fall_up[j], across)


def features_of(price: np.ndarray, w1: int, w2: int, eps: float) -> np.ndarray:
    """(rows x 6) of the rows from number w2 on, of a stretch of prices (NaN: unknown); w1 <= w2."""
    known = np.nan_to_num
    p = np.log(np.where(price > eps, price, np.where(np.isnan(price), np.nan, eps)))
    r = np.diff(p, prepend=np.nan)
    before, twice = np.append(np.nan, r[:-1]), np.append([np.nan, np.nan], r[:-2])
    rx, c, r = known(r * before), known(r - 2 * before + twice), known(r)
    frames, short, first = Frames(len(p), w2), Frames(len(p), w1), slice(0, len(p) - w2 + 1)
    total, total1, tx, tc = frames.sums(r), short.sums(r)[w2 - w1 :], frames.sums(rx), frames.sums(c)
    squares, squares1, bends, steps = frames.sums(r * r), short.sums(r * r)[w2 - w1 :], frames.sums(c * c), frames.sums(np.abs(r))
    high, low, fall = frames.over(r, np.maximum, -np.inf), frames.over(r, np.minimum, np.inf), frames.falls(p)
    last = slice(w2 - 1, None)
    r0, rx0, p0, c0, c1 = r[first], rx[first], p[first], c[first], c[1 : len(p) - w2 + 2]
    spread = lambda t, q, n: np.maximum(q / n - (t / n) * (t / n), 0.0)
    mean, n = total / w2, w2 - 1
    var, var1 = spread(total, squares, w2), spread(total1, squares1, w1)
    bend = spread(tc - c0 - c1, bends - c0 * c0 - c1 * c1, w2 - 2)
    early, late = total - r[last], total - r0
    s01 = tx - rx0 - mean * (early + late) + n * mean * mean
    s00 = squares - r[last] * r[last] - 2 * mean * early + n * mean * mean
    s11 = squares - r0 * r0 - 2 * mean * late + n * mean * mean
    scale = np.sqrt(np.maximum(s00 * s11, 0.0))
    found = np.stack([
        np.sqrt(var + eps) / (high - low + eps),
        np.log1p(np.sqrt(bend + eps)),
        fall / (np.abs(p[last] - p0) + eps),
        steps / (np.sqrt(squares) + eps),
        np.where(scale > 0, np.clip(s01 / np.where(scale > 0, scale, 1.0), -1.0, 1.0), 0.0),
        np.sqrt(var1 + eps) / (np.sqrt(var + eps) + eps),
    ], 1)
    return found[1:]  # the first frame lacks its first return


def by_stretches(df: DataFrame, column: str, keep: int, make: Callable[[np.ndarray, int], np.ndarray], names: list[str]) -> DataFrame:
    """df with columns of doubles: make(values, rows before them) -> an array of as many rows as are new.

    values: the column (NaN for null) over some rows of a symbol in order of time, with up to `keep` rows before them.
    """
    import pyarrow as pa

    def run(batches):
        at, tail, seen = None, np.zeros(0), 0
        for batch in batches:
            symbols = batch.column("symbol")
            coded = symbols.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = batch.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(code))[0] + 1).tolist(), len(x)]
            made = []
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                symbol = symbols[first].as_py()
                if symbol != at or not seen:
                    at, tail, seen = symbol, np.zeros(0), 0
                values = np.concatenate([tail, x[first:last]])
                made.append(make(values, len(tail)))
                tail, seen = values[len(values) - min(len(values), keep) :], seen + last - first
            if made:
                found = np.concatenate(made)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, i], from_pandas=True) for i in range(len(names))]], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{n} double" for n in names])
    return df.repartition("symbol").sortWithinPartitions("symbol", "ts", "seq").mapInArrow(run, schema)


def quotient_features(df: DataFrame, w1: int = 64, w2: int = 256, eps: float = 1e-6, price: str = "price") -> DataFrame:
    """Adds vol_ratio, curvature, drawdown, burstiness, acorr_1, var_ratio of the last w2 log returns; zeros before.

    An unknown price has no return and takes no part in a drop; drawdown is null where a window begins or ends with one.
    """

    def make(values: np.ndarray, before: int) -> np.ndarray:
        out = np.zeros((len(values) - before, len(FEATURES)))
        if len(values) > w2:
            found = features_of(values, w1, w2, eps)
            n = min(len(found), len(out))
            out[len(out) - n :] = found[len(found) - n :]
        return out

    # two rows more than a frame, for the returns before its first
    return by_stretches(df.withColumn(price, F.col(price).cast("double")) if dict(df.dtypes)[price] != "double" else df, price, w2 + 2, make, list(FEATURES))
