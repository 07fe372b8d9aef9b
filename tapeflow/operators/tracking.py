"""Tracking of components over time slices, live legitimacy modes, and contract checks across targets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .windows import tape, trailing


def slice_runs(df: DataFrame, slice_column: str, bin_column: str) -> DataFrame:
    """symbol, ts (the slice), runs: first and last bin of every run of neighbouring bins that occur in the slice."""
    bins = df.select("symbol", F.col(slice_column).alias("ts"), F.col(bin_column).alias("bin")).distinct()
    w = Window.partitionBy("symbol", "ts").orderBy("bin")
    runs = bins.withColumn("_g", F.col("bin") - F.row_number().over(w)).groupBy("symbol", "ts", "_g").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    return runs.groupBy("symbol", "ts").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")).withColumn("seq", F.lit(0).cast("long"))


def track(df: DataFrame, slice_column: str, bin_column: str) -> DataFrame:
    """For every slice: components alive, born and ended, and the slices that the ended ones lasted in all.

    A run goes on with the component of the slice before that it shares the most bins with; slices without rows are none.
    """

    def step(active, row):
        now, used = {}, set()
        fresh = max(active, default=-1) + 1 if active else 0
        born = 0
        for r in row["runs"]:
            shared = lambda c: min(r["last"], active[c][1][1]) - max(r["first"], active[c][1][0]) + 1  # noqa: B023, E731
            best = max((c for c in active if shared(c) > 0), key=shared, default=None)
            if best is None:
                best, born = fresh, born + 1
                fresh += 1
                now[best] = (row["ts"], (r["first"], r["last"]))
            else:
                now[best] = (active[best][0], (r["first"], r["last"]))
            used.add(best)
        gone = [active[c][0] for c in active if c not in used]
        return now, (len(now), born, len(gone), sum(row["ts"] - t for t in gone))

    return fold(slice_runs(df, slice_column, bin_column), dict, step, "alive int,born int,ended int,lasted long")


def live_legitimacy(mode: str, value: float = 1.0, ramp: int = 100, scale: float = 1.0, column: str = "ret", window: int = 200) -> Column:
    """Legitimacy of a live tape: 'constant', 'schedule' (rises over `ramp` rows), 'vol' (falls with trailing deviation) or
    'spread' (falls with the distance of a feature from its trailing mean)."""
    at = F.row_number().over(tape())
    if mode == "constant":
        return F.lit(value)
    if mode == "schedule":
        return F.least(F.lit(value), at * F.lit(value / ramp))
    f = trailing(window)
    if mode == "vol":
        return F.coalesce(F.exp(-F.stddev_pop(column).over(f) / scale), F.lit(value))
    return F.coalesce(1 / (1 + F.pow((F.col(column) - F.avg(column).over(f)) / scale, F.lit(2.0))), F.lit(value))


def contract_problems(tables: dict[str, DataFrame], required: dict[str, list[str]], least_rows: int, gates: DataFrame) -> DataFrame:
    """target, problem: missing columns, too few rows, no gate entry, or a latest gate entry that isn't open."""
    spark = gates.sparkSession
    missing = [(t, f"missing {c}") for t, cols in required.items() for c in cols if t not in tables or c not in tables[t].columns]
    found = spark.createDataFrame(missing, "target string, problem string")
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("target"), "n") for t, df in tables.items()]
    if sizes:
        few = functools.reduce(DataFrame.unionByName, sizes)
        found = found.unionByName(few.where(F.col("n") < least_rows).select("target", F.concat(F.lit("rows "), F.col("n").cast("string")).alias("problem")))
    last = gates.groupBy("target").agg(F.max_by("open", "ts").alias("open"))
    names = spark.createDataFrame([(t,) for t in tables], "target string")
    state = names.join(last, "target", "left").where(~F.coalesce("open", F.lit(False)))
    return found.unionByName(state.select("target", F.when(F.col("open").isNull(), "no gate entry").otherwise("gate closed").alias("problem")))
