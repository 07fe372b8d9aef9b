"""Analytics of decision logs: one row for each step of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions import binning
from tapeflow.operators.quantiles import quantiles
from tapeflow.operators.windows import first_exit, islands, running, tape  # noqa: F401


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def ratio(over: Column, under: Column) -> Column:
    """over / under, null for 0 under."""
    return F.when(under != 0, over / under)


def segments(df: DataFrame, value: str) -> DataFrame:
    """symbol, island, value, start, end, n of every run of equal values."""
    return islands(df, value).groupBy("symbol", "island").agg(F.first(value).alias(value), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def longest_runs(df: DataFrame, condition: Column, *keys: str, out: str = "longest") -> DataFrame:
    """The longest run of true for each key within a symbol; 0 if there is none.  Runs end where a key changes."""
    w = Window.partitionBy("symbol", *keys).orderBy("ts", "seq")
    flag = df.withColumn("_f", F.coalesce(condition, F.lit(False)).cast("int"))
    flag = flag.withColumn("_g", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flag.groupBy("symbol", *keys, "_g").agg(F.sum("_f").alias("_n"))
    return runs.groupBy("symbol", *keys).agg(F.max("_n").alias(out))


def bad_days(df: DataFrame, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.1) -> DataFrame:
    """One row for each symbol and day: span, first and last price and pnl, day return, bad rates, longest bad run, score."""
    days = df.withColumn("day", F.to_date("ts"))
    at = F.struct("ts", "seq")
    found = days.groupBy("symbol", "day").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("t").alias("bars"), F.min_by("price", at).alias("price_start"), F.max_by("price", at).alias("price_end"), F.min_by("pnl", at).alias("pnl_start"), F.max_by("pnl", at).alias("pnl_end"),
        F.avg("p_bad").alias("mean_p_bad"), F.max("p_bad").alias("max_p_bad"), share(F.col("bad_flag")).alias("bad_rate"),
    )
    runs = longest_runs(days, F.col("bad_flag"), "day", out="bad_run")
    score = alpha * F.coalesce("mean_p_bad", F.lit(0.0)) + beta * F.coalesce("max_p_bad", F.lit(0.0)) + gamma * F.col("bad_run")
    return found.join(runs, ["symbol", "day"]).withColumns({"ret_day": ratio(F.col("pnl_end") - F.col("pnl_start"), F.col("pnl_start")), "bad_score": score})


def posture(hold: str = "hold", ban: str = "ban") -> Column:
    """BAN over HOLD over ACT, as -1, 0, 1."""
    return F.when(F.col(ban) > 0, -1).when(F.col(hold) > 0, 0).otherwise(1)


def posture_segments(df: DataFrame, value: str = "posture", ret: str = "pnl_step") -> DataFrame:
    """Runs of one posture with sums and means of returns, cumulated over all and over runs of the same posture."""
    runs = islands(df, value).groupBy("symbol", "island").agg(F.first(value).alias(value), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.sum(ret).alias("ret_sum"), F.avg(ret).alias("ret_mean"))
    upto = lambda *k: Window.partitionBy("symbol", *k).orderBy("island").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("cum_all", F.sum("ret_sum").over(upto())).withColumn("cum_posture", F.sum("ret_sum").over(upto(value)))


def gate_metrics(df: DataFrame, direction: str = "action", ell: str = "ell") -> DataFrame:
    """For each symbol: hold and act share, flip rate, run lengths, quantiles of ell, mean exposure."""
    w = tape()
    marked = df.withColumns({"_act": (F.col(direction) != 0).cast("int"), "_flip": (F.col(direction) != F.lag(direction).over(w)).cast("int")})
    whole = marked.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.avg(1 - F.col("_act")).alias("hold_pct"), F.avg("_act").alias("act_pct"), F.avg("_flip").alias("flip_rate"), F.avg(ell).alias("ell_mean"),
        F.avg(F.abs("exposure")).alias("exposure_mean"),
    )
    # runs of one length are counted together: their lengths are few, however long the tape is
    lengths = segments(marked, "_act").groupBy("symbol", "_act", "n").agg(F.count("*").alias("times"))
    of = {"act": F.when(F.col("_act") == 1, F.col("n")), "hold": F.when(F.col("_act") == 0, F.col("n"))}
    runs = lengths.groupBy("symbol").agg(*[
        x for k, n in of.items() for x in (
            (F.try_divide(F.sum(n * F.col("times")), F.sum(F.when(n.isNotNull(), F.col("times"))))).alias(f"{k}_runs_mean"),
            F.percentile(n, F.lit(0.5), F.col("times")).alias(f"{k}_runs_median"),
        )
    ])
    spread = quantiles(df, ["symbol"], ell, {"ell_p10": 0.1, "ell_p50": 0.5, "ell_p90": 0.9})
    return whole.join(runs, "symbol").join(spread, "symbol", "left")


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """Share acceptable, precision and recall of acting, acting rows, share held."""
    ok, act = F.col("acceptable"), F.col("action") != 0
    return df.groupBy(*keys).agg(
        share(ok).alias("acceptable_pct"), ratio(F.count_if(ok & act), F.count_if(act)).alias("precision"), ratio(F.count_if(ok & act), F.count_if(ok)).alias("recall"), F.count_if(act).alias("act_bars"), F.avg("hold").alias("hold_pct")
    )


def pnl_audit(df: DataFrame, start_equity: float = 1.0) -> DataFrame:
    w = tape()
    eq = df.withColumn("_e", F.col("pnl") + start_equity)
    eq = eq.withColumns({"_r": F.coalesce(F.try_divide(F.col("_e"), F.lag("_e").over(w)) - 1, F.lit(0.0)), "_dd": F.col("_e") - F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    found = eq.groupBy("symbol").agg(
        F.max_by("pnl", F.struct("ts", "seq")).alias("pnl_net"), F.min("_dd").alias("max_dd"), F.sum(F.abs("fill")).alias("turnover"), F.count_if(F.col("fill") != 0).alias("trades"), F.sum(F.coalesce("fee", F.lit(0.0))).alias("fees"),
        F.sum(F.abs("slippage")).alias("impact"), F.avg("_r").alias("mean_ret"), F.stddev_samp("_r").alias("std_ret"),
    )
    return found.withColumns({"pnl_gross": F.col("pnl_net") + F.col("fees"), "edge_per_turnover": ratio(F.col("pnl_net"), F.col("turnover"))})


def return_splits(df: DataFrame) -> DataFrame:
    ahead = df.withColumn("_f", F.try_divide(F.lead("price").over(tape()), F.col("price")) - 1)
    part = lambda c: F.avg(F.when(c, F.col("_f")))
    act = F.col("action") != 0
    return ahead.groupBy("symbol").agg(F.avg("_f").alias("ret_all"), part(act).alias("ret_engaged"), part(~act).alias("ret_flat"), part(F.col("bad_flag")).alias("ret_bad"), part(~F.col("bad_flag")).alias("ret_good"))


def engagement(df: DataFrame, bins: int = 20) -> DataFrame:
    """Share of acting rows by actionability bin, for acceptable and other rows."""
    at = df.withColumn("bin", binning.cut(F.col("actionability"), 0.0, 1.0, bins)).where("bin IS NOT NULL")
    return at.groupBy("acceptable", "bin").agg(share(F.col("action") != 0).alias("engagement"), F.count("*").alias("n")).withColumn("bin_center", binning.center(F.col("bin"), 0.0, 1.0, bins))


def error_rates(df: DataFrame, bins: int = 20) -> DataFrame:
    act, ok = F.col("action") != 0, F.col("acceptable")
    at = df.withColumn("bin", binning.cut(F.col("actionability"), 0.0, 1.0, bins)).where("bin IS NOT NULL")
    return at.groupBy("bin").agg(share(act & ~ok).alias("fp_rate"), share(~act & ok).alias("fn_rate"))


def binned_surface(df: DataFrame, x: Column, y: Column, value: Column, x_limits: tuple[float, float], y_limits: tuple[float, float], bins: int = 20) -> DataFrame:
    """Mean of value and rows in each cell of a grid; rows outside of the limits are left out."""
    cell = df.select(binning.histogram(x, *x_limits, bins).alias("x_bin"), binning.histogram(y, *y_limits, bins).alias("y_bin"), value.cast("double").alias("v"))
    return cell.where("x_bin IS NOT NULL AND y_bin IS NOT NULL AND v IS NOT NULL").groupBy("x_bin", "y_bin").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def vector_field(df: DataFrame, x: str, y: str, x_limits, y_limits, bins: int = 10) -> DataFrame:
    """Mean step in x and y, and share acceptable, for each cell."""
    w = tape()
    d = df.withColumns({"_dx": F.lead(x).over(w) - F.col(x), "_dy": F.lead(y).over(w) - F.col(y), "x_bin": binning.histogram(F.col(x), *x_limits, bins), "y_bin": binning.histogram(F.col(y), *y_limits, bins)})
    d = d.where("_dx IS NOT NULL AND _dy IS NOT NULL AND x_bin IS NOT NULL AND y_bin IS NOT NULL")
    return d.groupBy("x_bin", "y_bin").agg(F.avg("_dx").alias("dx"), F.avg("_dy").alias("dy"), share(F.col("acceptable")).alias("acceptable"), F.count("*").alias("n"))


def decile_stats(df: DataFrame, by: str, value: str, bins: int = 10) -> DataFrame:
    """Mean, std, count, standard error and mean/std of value in quantile bins of `by`."""
    at = binning.with_quantile_bin(df.where(F.col(by).isNotNull() & F.col(value).isNotNull()), by, bins)
    found = at.groupBy("bin").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"), share(F.col(value) > 0).alias("hit_rate"))
    return found.withColumns({"stderr": F.col("std") / F.sqrt("n"), "sharpe": ratio(F.col("mean"), F.col("std"))})


def occupancy(df: DataFrame, bins: int = 10) -> DataFrame:
    """state, n, rho (share of rows), pi (share acting) over acceptable x actionability bin."""
    at = df.withColumn("state", F.col("acceptable").cast("int") * bins + binning.digitize(F.col("actionability"), 0.0, 1.0, bins)).where("state IS NOT NULL")
    found = at.groupBy("state").agg(F.count("*").alias("n"), share(F.col("action") != 0).alias("pi"))
    return found.crossJoin(F.broadcast(found.agg(F.sum("n").alias("all")))).select("state", "n", "pi", (F.col("n") / F.col("all")).alias("rho"))


def policy_distance(a: DataFrame, b: DataFrame, bins: int = 10) -> DataFrame:
    """One row: occupancy-weighted JS, L1 and L2 distances of two logs' acting probabilities."""
    one, two = (occupancy(x, bins).select("state", F.col("pi").alias(f"p{i}"), F.col("rho").alias(f"r{i}")) for i, x in ((1, a), (2, b)))
    both = one.join(two, "state", "full").na.fill(0.0)
    p, q, weight = F.col("p1"), F.col("p2"), (F.col("r1") + F.col("r2")) / 2
    clip = lambda x: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), x))
    kl = lambda x, y: clip(x) * F.log(clip(x) / clip(y)) + (1 - clip(x)) * F.log((1 - clip(x)) / (1 - clip(y)))
    m = (p + q) / 2
    return both.agg(F.sum(weight * (kl(p, m) + kl(q, m)) / 2).alias("js"), F.sum(weight * F.abs(p - q)).alias("l1"), F.sqrt(F.sum(weight * (p - q) * (p - q))).alias("l2"))


def transition_kernel(df: DataFrame, state: str) -> DataFrame:
    """s0, s1, p: shares of the next state given the state."""
    pairs = df.select(F.col(state).alias("s0"), F.lead(state).over(tape()).alias("s1")).where("s1 IS NOT NULL").groupBy("s0", "s1").agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("s0")))


def ks_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the largest gap between two empirical distributions of a column; null if one of them is empty.

    Counts of equal values come first, then a prefix scan over ranges of values: no task sorts more than a range.
    """
    side = lambda df, x, y: df.select(F.col(column).alias("v"), F.lit(x).alias("a"), F.lit(y).alias("b")).where("v IS NOT NULL")
    counts = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running(counts, "v", {"x": F.col("a"), "y": F.col("b")})
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return run.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.try_divide(F.col("x"), F.col("na")) - F.try_divide(F.col("y"), F.col("nb")))).alias("ks"))


def edge_density(df: DataFrame, x: str = "exposure", m: str = "m", kappa: float = 0.001, eps: float = 1e-12, *keys: str) -> DataFrame:
    """rho, edge and cost sums, support and activity: sum x[t-1] * dm over sum kappa * m * abs(dx)."""
    w = tape(*keys)
    d = df.withColumns({"_x": F.lag(x).over(w), "_m": F.lag(m).over(w)}).where("_m IS NOT NULL")
    found = d.groupBy("symbol", *keys).agg(F.sum(F.col("_x") * (F.col(m) - F.col("_m"))).alias("sum_edge"), F.sum(kappa * F.col(m) * F.abs(F.col(x) - F.col("_x"))).alias("sum_cost"), F.sum(m).cast("long").alias("n_support"), F.count("*").alias("steps"))
    return found.withColumns({"rho": F.col("sum_edge") / (F.col("sum_cost") + eps), "activity": F.col("n_support") / F.col("steps")}).drop("steps")


def robustness(density: DataFrame, least_rho: float = 1.0, least_support: int = 10, spread: float = 0.25, eps: float = 1e-12) -> DataFrame:
    """Verdict on edge_density rows: support, threshold, and the threshold at costs spread up and down (costs scale)."""
    at = lambda f: F.col("sum_edge") / (F.col("sum_cost") * f + eps)
    reason = F.when(F.col("n_support") < least_support, "sparse_support").when(F.col("rho") < least_rho, "below_thresh").when((at(1 + spread) < least_rho) | (at(1 - spread) < least_rho), "cost_sensitivity").otherwise("ok")
    return density.withColumn("reason", reason).withColumn("phase", F.when(F.col("rho") < least_rho, "false").when(reason == "ok", "stable").otherwise("unstable"))
