"""Energy, cancellation and spectral share of trailing returns, and adaptive score scales."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold
from .windows import tape, trailing


#: Windows that are transformed at a time.
BLOCK = 4096


def _window_features(x: np.ndarray) -> np.ndarray:
    """Energy, cancellation and spectral share of each row's window."""
    middle = np.median(x, axis=1, keepdims=True)
    x = x / np.maximum(np.median(np.abs(x - middle), axis=1, keepdims=True), 1e-9)
    total = np.abs(x).sum(1)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    return np.stack([(x**2).mean(1), np.where(total > 1e-9, np.abs(x.sum(1)) / np.maximum(total, 1e-9), 0.0), power.max(1) / np.maximum(power.sum(1), 1e-9)], 1)


def spectral_features(df: DataFrame, returns: str, w1: int = 64, w2: int = 256) -> DataFrame:
    """e1, c1, s1, e2, c2, s2 over both windows and their absolute differences; rows before a full window are left out.

    Rows stream through by symbol and time; a task keeps the last returns of a tape, so no row carries its window with it.
    """
    import pyarrow as pa

    most = max(w1, w2)
    names = [f"{k}{i}" for i in (1, 2) for k in "ecs"] + [f"delta_{k}" for k in "ecs"]
    held = df.where(F.col(returns).isNotNull())

    def features(x: np.ndarray) -> np.ndarray:
        """Of the rows from the most-th on."""
        one, two = (_window_features(np.lib.stride_tricks.sliding_window_view(x, n)[most - n :]) for n in (w1, w2))
        return np.hstack([one, two, np.abs(one - two)])

    def run(batches):
        at, tail = None, np.zeros(0)
        for batch in batches:
            symbols = np.array(batch.column("symbol").to_pylist(), object)
            x = batch.column(returns).cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(symbols[1:] != symbols[:-1])[0] + 1).tolist(), len(x)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if symbols[first] != at:
                    at, tail = symbols[first], np.zeros(0)
                for start in range(first, last, BLOCK):
                    end = min(last, start + BLOCK)
                    known = np.concatenate([tail, x[start:end]])
                    tail = known[-(most - 1) :] if most > 1 else known[:0]
                    if len(known) >= most:
                        made = features(known)
                        rows = batch.slice(end - len(made), len(made))
                        yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c) for c in made.T]], names=[*rows.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields] + [f"{n} double" for n in names])
    return held.repartition("symbol").sortWithinPartitions("symbol", "ts", "seq").mapInArrow(run, schema)


def sliding(df: DataFrame, column: str, n: int, share: float, out: str, end: int = 0, nearest: bool = False, least: int = 1) -> DataFrame:
    """Adds the quantile of a column's known values among the n rows that end `end` rows before each; null for fewer than `least`.

    Interpolated, or of the nearest rank.  A value is put into a sorted list and taken out of it, so a row's cost doesn't follow
    from sorting its window.
    """

    def step(state, row):
        rows, order, due = state  # due: rows that aren't in the window yet
        due.append(row[column])
        if end == 0:
            _enter(rows, order, due.popleft(), n)
        found = None
        if len(order) >= least:
            at = share * (len(order) - 1)
            low = math.floor(at + 0.5) if nearest else math.floor(at)
            found = order[low] if nearest or low == at else order[low] + (order[low + 1] - order[low]) * (at - low)
        if end and len(due) == end:
            _enter(rows, order, due.popleft(), n)
        return state, (found,)

    return fold(df, lambda: (deque(), [], deque()), step, f"{out} double")


def _enter(rows: deque, order: list, value, n: int) -> None:
    """Takes a value into the last n rows and their sorted known values, and the oldest out."""
    rows.append(value)
    if value is not None:
        insort(order, value)
    if len(rows) > n:
        gone = rows.popleft()
        if gone is not None:
            del order[bisect_left(order, gone)]


def adaptive_threshold(df: DataFrame, score: str, out: str, rate: float, history: int, least: int, default: float) -> DataFrame:
    """The (1 - rate) quantile, nearest rank, of the `history` scores before the row; default until `least` are there."""
    return sliding(df, score, history, 1 - rate, out, end=1, nearest=True, least=least).withColumn(out, F.coalesce(out, F.lit(float(default))))


def standardised_score(df: DataFrame, score: str, history: int, shrink: int, floor: float = 1e-3) -> DataFrame:
    """z of a score by its symbol's trailing mean and deviation, blended with those of all symbols while it is young."""
    f = trailing(history, -1)
    pooled = df.agg(F.avg(score).alias("_pm"), F.stddev_pop(score).alias("_ps"))
    own = df.withColumns({"_n": F.count(score).over(f), "_m": F.avg(score).over(f), "_s": F.stddev_pop(score).over(f)}).crossJoin(F.broadcast(pooled))
    k = F.least(F.lit(1.0), F.col("_n") / shrink)
    blend = lambda a, b: k * F.coalesce(a, b) + (1 - k) * F.col(b)
    mean, std = blend("_m", "_pm"), F.greatest(blend("_s", "_ps"), F.lit(floor))
    return own.withColumn("z", (F.col(score) - mean) / std).drop("_n", "_m", "_s", "_pm", "_ps")


def goal_probability(df: DataFrame, cash: str, goal: float, window: int = 200) -> DataFrame:
    """Adds goal_prob and shortfall of reaching `goal` by the tape's end, from trailing steps of a cash column."""
    from tapeflow.functions.scalar import norm_cdf

    w = tape()
    steps = df.withColumn("_d", F.coalesce(F.col(cash) - F.lag(cash).over(w), F.lit(0.0)))
    ends = df.groupBy("symbol").agg(F.count("*").alias("_n"))
    f = trailing(window)
    held = steps.withColumns({"_mu": F.avg("_d").over(f), "_sd": F.stddev_pop("_d").over(f), "_i": F.row_number().over(w)}).join(ends, "symbol")
    left = F.col("_n") - F.col("_i")
    mean, std = F.col(cash) + F.col("_mu") * left, F.col("_sd") * F.sqrt(left)
    prob = F.when(std > 0, 1 - norm_cdf((goal - mean) / std)).otherwise((mean >= goal).cast("double"))
    return held.withColumns({"goal_prob": prob, "shortfall": F.greatest(F.lit(0.0), goal - mean)}).drop("_d", "_n", "_mu", "_sd", "_i")
