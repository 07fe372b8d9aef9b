"""The nested tower record of a step, its invariants, and the density gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tower(df: DataFrame, run_id: str, least_age: int = 3) -> DataFrame:
    """symbol, ts, t, run_id, P5, P7, P8, M8, P9 of decision rows with action, hold, ban, state_age, abstain, ready, ledger, horizon, fixed."""
    posture = F.when(F.col("ban") > 0, "BAN").when(F.col("hold") > 0, "HOLD").otherwise("ACT")
    stable = F.col("state_age") >= least_age
    parts = {"boundary_stable": ~F.col("abstain") & stable, "phase8_ready": F.coalesce("ready", F.lit(False)), "actuator_mode_fixed": F.col("fixed"), "ledger_ready": F.col("ledger"), "horizon_certified": F.coalesce("horizon", F.lit(False))}
    components = F.struct(*[v.alias(k) for k, v in parts.items()])
    checked = [k for k in parts if k != "horizon_certified"]
    pre = F.lit(True)
    for k in checked:
        pre = pre & parts[k]
    reason = F.lit("open")
    for k in ["horizon_certified", *reversed(checked)]:
        reason = F.when(~parts[k], f"missing_{k}").otherwise(reason)
    a9 = F.when(posture == "ACT", 1.0).when(posture == "HOLD", 0.5).otherwise(0.0)
    return df.select(
        "symbol", "ts", "seq", "t", F.lit(run_id).alias("run_id"), F.col("action"),
        F.struct(posture.alias("posture"), F.col("state_age"), stable.alias("stable"), F.least(F.lit(1.0), F.col("state_age") / least_age).alias("A5")).alias("P5"),
        F.struct(F.struct(F.col("abstain")).alias("boundary_gate")).alias("P7"), F.struct(F.col("ready").alias("open")).alias("P8"),
        F.struct(pre.alias("precheck"), (pre & parts["horizon_certified"]).alias("open"), components.alias("components"), reason.alias("reason")).alias("M8"),
        F.struct(F.when(posture != "ACT", posture).alias("refusal"), a9.alias("A9")).alias("P9"),
    )


def violations(df: DataFrame, closed: str = "gate_closed", active: str = "active", justified: str = "justified") -> DataFrame:
    """One row for each broken rule of a tower record: I1, I2, I3 (twice), I5, I6."""
    is_open, act, shut = F.col("M8.open"), F.col(active), F.col(closed)
    rules = [
        ("I1", is_open & ~F.col("M8.precheck"), "open without precheck"), ("I2", is_open & ~F.col("M8.components.horizon_certified"), "open without certified horizon"), ("I3", shut & is_open, "open while the exposure gate is closed"),
        ("I3", shut & act, "action while the exposure gate is closed"), ("I6", F.col("P9.refusal").isin("HOLD", "BAN") & act, "action against a refusal"), ("I5", act & ~F.col(justified), "action without justification"),
    ]
    made = F.array(*[F.when(c, F.struct(F.lit(k).alias("rule"), F.lit(d).alias("detail"))) for k, c, d in rules])
    return df.select("symbol", "ts", "seq", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("v")).select("symbol", "ts", "seq", "v.*")


def density_gate(history: DataFrame, window: int = 3, required: int = 2, least_rows: int = 120, least_bin: int = 10, least_bins: int = 2, most_flips: int = 1, least_balance: float = 0.2, least_effect: float = 0.0005) -> DataFrame:
    """target, open, reasons from rows (target, iteration, ont, bin, count, median): bins must persist over the last
    evaluations without sign flips, be balanced, and differ."""
    w = Window.partitionBy("target").orderBy(F.desc("iteration"))
    recent = history.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= window)
    by_bin = Window.partitionBy("target", "ont", "bin").orderBy("iteration")
    s = F.when((F.col("count") >= least_bin) & (F.col("median") != 0), F.signum("median"))
    before = F.last(s, ignorenulls=True).over(by_bin.rowsBetween(Window.unboundedPreceding, -1))
    bins = recent.withColumn("_f", F.coalesce((s != before).cast("int"), F.lit(0))).groupBy("target", "ont", "bin").agg(
        F.count_if(F.col("count") >= least_bin).alias("hits"), F.sum("_f").alias("flips"), F.max_by("count", "iteration").alias("n"), F.max_by("median", "iteration").alias("median")
    )
    good = (F.col("hits") >= required) & (F.col("flips") <= most_flips) & (F.col("n") >= least_bin)
    pick = lambda c: F.when(good, F.col(c))
    onts = bins.groupBy("target", "ont").agg(F.sum("n").alias("rows"), F.count_if(good).alias("bins"), F.min(pick("n")).alias("lo"), F.max(pick("n")).alias("hi"), (F.max(pick("median")) - F.min(pick("median"))).alias("effect"))
    say = lambda text: F.concat(F.col("ont"), F.lit(text))
    reason = F.when(F.col("rows") < least_rows, say(" rows")).when(F.col("bins") < least_bins, say(" bins")).when(F.col("lo") / F.col("hi") < least_balance, say(" balance")).when(F.col("effect") < least_effect, say(" effect"))
    return onts.withColumn("r", reason).groupBy("target").agg((F.count_if(F.col("r").isNotNull()) == 0).alias("open"), F.array_join(F.array_sort(F.array_compact(F.collect_list("r"))), ",").alias("reasons"))
