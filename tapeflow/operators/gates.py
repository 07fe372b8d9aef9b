"""Readiness gates, near misses, coverage, entropy and transition tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import latest, tape


def block_decimation(df: DataFrame, k: int, how: str = "last", x: str = "exposure", ret: str = "ret") -> DataFrame:
    """One row for each full block of k rows: the last or mean x, and the compounded return."""
    w = tape()
    n = F.row_number().over(w) - 1
    blocks = df.withColumn("_n", n).withColumn("block", F.floor(F.col("_n") / k))
    pick = F.max_by(x, "_n") if how == "last" else F.avg(x)
    found = blocks.groupBy("symbol", "block").agg(pick.alias("x"), F.product(1 + F.coalesce(ret, F.lit(0.0))).alias("_p"), F.count("*").alias("_k"))
    return found.where(F.col("_k") == k).select("symbol", "block", "x", (F.col("_p") - 1).alias("ret"))


def shuffled(i: Column, n: Column, key: Column, rounds: int = 12) -> Column:
    """A place from 0 to n - 1 for each row number i from 0 to n - 1, another for every one: a bijection that the key chooses.

    Each round pairs numbers by reflection and swaps a pair, or doesn't, by a bit of its greater number; so numbers are
    dealt anew without any sort.  n up to 2^31.
    """
    prime, factor = F.lit(2147483647), F.lit(48271)
    mix = lambda v: (F.pmod(v, prime) * factor) % prime

    def swap(x: Column, r: Column) -> Column:
        salt = mix(key * 7919 + r * 104729 + 1)
        other = F.pmod(salt - x, n)
        bit = F.floor(mix(mix(F.greatest(x, other) + salt) + salt) / 32768) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), i.cast("bigint"), swap)


def places(i: np.ndarray, n: np.ndarray, key: int, rounds: int = 12) -> np.ndarray:
    """`shuffled` over whole arrays of bigints."""
    prime, x = 2147483647, i.copy()
    mix = lambda v: v % prime * 48271 % prime
    for r in range(rounds):
        salt = mix(key * 7919 + r * 104729 + 1)
        other = (salt - x) % n
        swapped = mix(mix(np.maximum(x, other) + salt) + salt) >> 15 & 1
        x = np.where(swapped == 1, other, x)
    return x


def permutation_null(df: DataFrame, x: str, ret: str, replicates: int = 20, kappa: float = 0.001) -> DataFrame:
    """symbol, rho, null_median, delta: edge over cost against that of returns dealt anew in each replicate.

    A replicate takes a row's return from the row that `shuffled` names (by its form for arrays, as lambdas aren't compiled), by an equi-join on row numbers; costs are the same in
    all replicates.  Rows are dealt by their numbers first, so the replicates of one symbol are many tasks' work.
    """
    w = tape()
    base = df.withColumns({"_x0": F.lag(x).over(w), "_x": F.col(x), "_r": F.coalesce(ret, F.lit(0.0))}).where("_x0 IS NOT NULL").withColumn("_i", F.row_number().over(w).cast("bigint") - 1).select("symbol", "_i", "_x0", "_x", "_r")
    cost = F.sum(kappa * F.abs(F.col("_x") - F.col("_x0"))) + 1e-12
    whole = base.groupBy("symbol").agg(F.count("*").alias("_n"), cost.alias("_cost"), (F.sum(F.col("_x0") * F.col("_r")) / cost).alias("rho"))

    def replicated(batches):
        import pyarrow as pa

        for batch in batches:
            i, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_n"))
            for rep in range(1, replicates + 1):
                yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.array(np.full(len(i), rep, np.int64)), pa.array(places(i, n, rep)), batch.column("_x0")], names=["symbol", "rep", "_j", "_x0"])

    rows = base.select("symbol", "_i", "_x0").repartition("symbol", "_i").join(whole.select("symbol", "_n"), "symbol").select("symbol", "_i", "_n", F.col("_x0").cast("double"))
    rows = rows.mapInArrow(replicated, "symbol string, rep long, _j long, _x0 double")
    dealt = base.select("symbol", F.col("_i").alias("_j"), "_r").hint("shuffle_hash")
    null = rows.join(dealt, ["symbol", "_j"]).groupBy("symbol", "rep").agg(F.sum(F.col("_x0") * F.col("_r")).alias("_edge"))
    null = null.join(whole.select("symbol", "_cost"), "symbol").groupBy("symbol").agg(F.percentile(F.col("_edge") / F.col("_cost"), F.lit(0.5)).alias("null_median"))  # one value for each replicate
    return whole.select("symbol", "rho").join(null, "symbol").withColumn("delta", F.col("rho") - F.col("null_median"))


def readiness(df: DataFrame, window: int = 8, required: int = 6, ready: str = "ready", reason: str = "reason", target: str = "target") -> DataFrame:
    """open, why, ready_count, window_size over the last `window` rows of each target."""
    last = latest(df, target, n=window)
    at = F.struct("ts", "seq")
    found = last.groupBy(target).agg(F.count_if(F.col(ready)).alias("ready_count"), F.count("*").alias("window_size"), F.max_by(reason, F.when(F.col(reason) != "", at)).alias("_why"))
    text = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"), F.lit(f"/{required}"))
    why = F.when(F.col("window_size") < required, text("waiting ", "window_size")).when(F.col("ready_count") < required, F.coalesce("_why", text("not_ready ", "ready_count"))).otherwise("ready")
    return found.select(target, (F.col("ready_count") >= required).alias("open"), why.alias("why"), "ready_count", "window_size")


def last_allowed(df: DataFrame, allowed: Column, value: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return df.where(allowed).groupBy("symbol").agg(F.max_by(F.struct(*order, value), F.struct(*order)).alias("r")).select("symbol", "r.*")


def near_misses(df: DataFrame, window_s: int, stride_s: int, min_points: int, at_s: str = "ts_s") -> DataFrame:
    """symbol, t0, cls, rank: sliding windows from each symbol's first row, both ends in, in up to three classes.

    Columns a7, a8, a9 (levels), precheck, opened, horizon (flags, null if unknown).
    """
    span = df.groupBy("symbol").agg(F.min(at_s).alias("_lo"), F.max(at_s).alias("_hi"))
    rows = df.join(span, "symbol").withColumn("_d", F.col(at_s) - F.col("_lo"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_d") - window_s) / stride_s)).cast("long")
    last = F.least(F.floor(F.col("_d") / stride_s), F.floor((F.col("_hi") - F.col("_lo") - window_s) / stride_s)).cast("long")
    spread = rows.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    found = spread.groupBy("symbol", "k").agg(F.count("*").alias("n"), F.avg("a7").alias("a7"), F.avg("a8").alias("a8"), F.avg("a9").alias("a9"), rate("precheck").alias("pre"), rate("opened").alias("open"), rate("horizon").alias("hor")).where(F.col("n") >= min_points)
    a8, hor = F.coalesce("a8", F.lit(0.0)), F.coalesce("hor", F.lit(0.0))
    classes = F.array(
        F.when((F.col("a7") >= 0.4) & (a8 < 1), F.struct(F.lit("boundary_ready_near_miss").alias("cls"), (F.col("a7") * (1 - a8)).alias("rank"))),
        F.when((F.col("pre") > 0.2) & (hor < 1), F.struct(F.lit("m8_precheck_missing_horizon").alias("cls"), (F.col("pre") * (1 - hor)).alias("rank"))),
        F.when((F.col("open") > 0.2) & (F.col("a9") < 1), F.struct(F.lit("witness_blocked").alias("cls"), (F.col("open") * (1 - F.col("a9"))).alias("rank"))),
    )
    return found.select("symbol", (F.col("k") * stride_s).alias("t0"), "n", F.explode(F.filter(classes, lambda c: c.isNotNull())).alias("c")).select("symbol", "t0", "n", "c.cls", "c.rank")


def coverage(df: DataFrame, cells: list[str], n_cells: int, snapshot: str = "ts") -> DataFrame:
    """Share of the grid's cells present in each snapshot, then mean, least and most by day."""
    each = df.groupBy("symbol", snapshot).agg((F.countDistinct(*cells) / n_cells).alias("share"))
    return each.groupBy("symbol", F.to_date(snapshot).alias("day")).agg(F.avg("share").alias("mean"), F.min("share").alias("least"), F.max("share").alias("most"), F.count("*").alias("snapshots"))


def entropy(df: DataFrame, symbol: str, *keys: str, log: str = "log2") -> DataFrame:
    """Bits a symbol, for each key."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*keys, symbol).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(w)
    f = F.log2 if log == "log2" else F.log
    found = counts.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * f("_p"))).alias("bits"), F.sum("n").alias("n"))
    return found


def context_entropy(df: DataFrame, symbol: str, context: list[str], *keys: str) -> DataFrame:
    """Bits a symbol given its context columns."""
    counts = df.groupBy(*keys, *context, symbol).agg(F.count("*").alias("n"))
    within = F.sum("n").over(Window.partitionBy(*keys, *context))
    bits = counts.withColumn("_b", -F.col("n") * F.log2(F.col("n") / within))
    return bits.groupBy(*keys).agg((F.sum("_b") / F.sum("n")).alias("bits"), F.sum("n").alias("n"))


def normalised_entropy(df: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Entropy of positive weights over the log of their number; 0 for one or none."""
    w = Window.partitionBy(*keys)
    p = df.where(F.col(weight) > 0).withColumn("_p", F.col(weight) / F.sum(weight).over(w))
    return p.groupBy(*keys).agg(F.when(F.count("*") > 1, -F.sum(F.col("_p") * F.log("_p")) / F.log(F.count("*"))).otherwise(0.0).alias("entropy"), F.count("*").alias("n"))


def transition_table(df: DataFrame, bucket: str, label: str, value: str, least: int = 12) -> DataFrame:
    """bucket, label, n, p, mean of the next value, for buckets of at least `least` rows."""
    w = tape()
    d = df.withColumn("_next", F.lead(value).over(w)).where("_next IS NOT NULL")
    found = d.groupBy(bucket, label).agg(F.count("*").alias("n"), F.avg("_next").alias("mean_next"))
    total = F.sum("n").over(Window.partitionBy(bucket))
    return found.withColumn("_t", total).where(F.col("_t") >= least).select(bucket, label, "n", (F.col("n") / F.col("_t")).alias("p"), "mean_next")


def block_reuse(df: DataFrame, content: Column, position: str) -> DataFrame:
    """same (as before at this position), reuse (seen before anywhere in the symbol's tape) or new, by fingerprint."""
    w = Window.partitionBy("symbol", position).orderBy("ts", "seq")
    marked = df.withColumn("_f", F.xxhash64(content)).withColumn("_before", F.lag("_f").over(w))
    first = marked.groupBy("symbol", "_f").agg(F.min(F.struct("ts", "seq")).alias("_first"))
    found = marked.join(first, ["symbol", "_f"])
    label = F.when(F.col("_f") == F.col("_before"), "same").when(F.struct("ts", "seq") > F.col("_first"), "reuse").otherwise("new")
    return found.withColumn("label", label).drop("_f", "_before", "_first")


def contiguous_windows(df: DataFrame, gap: Column, pad: Column) -> DataFrame:
    """start, end, n of runs of rows no further apart than gap, padded on both sides."""
    w = tape()
    broken = (F.col("ts") - F.lag("ts").over(w) > gap).cast("int")
    runs = df.withColumn("_b", F.coalesce(broken, F.lit(1))).withColumn("_g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "_g").agg((F.min("ts") - pad).alias("start"), (F.max("ts") + pad).alias("end"), F.count("*").alias("n")).drop("_g")
