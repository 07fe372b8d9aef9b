"""Queries of decision-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import logs
from tapeflow.operators import windows as w
from tapeflow.operators.quantiles import matched, quantiles

from .fixtures import steps, table
from .registry import query
from .window_plans import RUNS

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


def _cut(x: str, bins: int) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 1 THEN CAST(greatest(ceil({x} / (1.0 / {bins}) - 1e-12) - 1, 0) AS INT) END"


def _hist(x: str, lo: float, hi: float, bins: int) -> str:
    return f"CASE WHEN {x} BETWEEN {lo} AND {hi} THEN CAST(least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins} + 1e-12), {bins - 1}) AS INT) END"


@query(
    "e4_bad_days",
    f"""|d AS (SELECT *, CAST(ts AS DATE) AS day FROM steps),
    g AS (SELECT *, sum(CASE WHEN bad_flag THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, day ORDER BY ts, seq) AS g FROM d),
    r AS (SELECT symbol, day, max(n) AS bad_run FROM (SELECT symbol, day, g, sum(CAST(bad_flag AS INT)) AS n FROM g GROUP BY ALL) GROUP BY 1, 2),
    a AS (SELECT symbol, day, min(ts) AS start_ts, max(ts) AS end_ts, count(t) AS bars, arg_min(price, (ts, seq)) AS price_start, arg_max(price, (ts, seq)) AS price_end, arg_min(pnl, (ts, seq)) AS pnl_start, arg_max(pnl, (ts, seq)) AS pnl_end,
        avg(p_bad) AS mean_p_bad, max(p_bad) AS max_p_bad, avg(CAST(bad_flag AS INT)) AS bad_rate FROM d GROUP BY 1, 2)
    SELECT a.*, CAST(bad_run AS BIGINT) AS bad_run, (pnl_end - pnl_start) / nullif(pnl_start, 0) AS ret_day, mean_p_bad + 0.5 * max_p_bad + 0.1 * bad_run AS bad_score FROM a JOIN r USING (symbol, day)""",
    "price_start price_end pnl_start pnl_end mean_p_bad max_p_bad bad_rate bad_score",
)
def e4(spark, sf_dir):
    return logs.bad_days(steps(spark, sf_dir))


_POSTURE = "CASE WHEN ban > 0 THEN -1 WHEN hold > 0 THEN 0 ELSE 1 END"
_STEPPED = f"|p AS (SELECT *, {_POSTURE} AS posture, coalesce(pnl - lag(pnl) {_W}, 0) AS pnl_step FROM steps)"


def _stepped(spark, sf_dir):
    return steps(spark, sf_dir).withColumns({"posture": logs.posture(), "pnl_step": F.coalesce(F.col("pnl") - F.lag("pnl").over(w.tape()), F.lit(0.0))})


@query("e5_returns_by_posture", _STEPPED + " SELECT posture, avg(pnl_step) AS mean, stddev_samp(pnl_step) AS std, sum(pnl_step) AS total, count(*) AS n FROM p GROUP BY 1", "mean std total")
def e5(spark, sf_dir):
    return _stepped(spark, sf_dir).groupBy("posture").agg(F.avg("pnl_step").alias("mean"), F.stddev_samp("pnl_step").alias("std"), F.sum("pnl_step").alias("total"), F.count("*").alias("n"))


@query(
    "e6_posture_segments",
    _STEPPED.replace("coalesce(pnl - lag(pnl)", "CAST(round(1e6 * coalesce(pnl - lag(pnl)").replace(", 0) AS pnl_step", ", 0)) AS BIGINT) AS pnl_step") + f""", c AS (SELECT *, CASE WHEN posture IS DISTINCT FROM lag(posture) {_W} OR t = 0 THEN 1 ELSE 0 END AS ch FROM p), i AS (SELECT *, CAST(sum(ch) {_W} AS BIGINT) AS island FROM c),
    s AS (SELECT symbol, island, first(posture) AS posture, min(t) AS start, max(t) AS "end", count(*) AS n, CAST(sum(pnl_step) AS BIGINT) AS ret_sum, avg(pnl_step) AS ret_mean FROM i GROUP BY 1, 2)
    SELECT *, CAST(sum(ret_sum) OVER (PARTITION BY symbol ORDER BY island) AS BIGINT) AS cum_all, CAST(sum(ret_sum) OVER (PARTITION BY symbol, posture ORDER BY island) AS BIGINT) AS cum_posture FROM s""",
    "ret_mean",
)
def e6(spark, sf_dir):
    """Steps in whole millionths, so that sums are exact in any order."""
    return logs.posture_segments(_stepped(spark, sf_dir).withColumn("pnl_step", F.round(F.col("pnl_step") * 1e6).cast("long")))


@query(
    "e7_size_bin_stats",
    """SELECT l_returnflag AS ontology, CAST(floor(l_quantity / 10) AS INT) AS size_bin, count(l_discount) AS n, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr,
    avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std FROM lineitem GROUP BY 1, 2""",
    "median iqr mean std",
)
def e7(spark, sf_dir):
    cell = ["ontology", "size_bin"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ontology"), F.floor(F.col("l_quantity") / 10).cast("int").alias("size_bin"), "l_discount", "l_extendedprice")
    whole = li.groupBy(*cell).agg(F.count("l_discount").alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    q = quantiles(li, cell, "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(*cell, "median", (F.col("q3") - F.col("q1")).alias("iqr"))
    return matched(whole, q, cell, "left")


@query("e8_exposure_control", "SELECT symbol AS log, count(*) AS rows, sum(abs(exposure)) AS exposure, arg_min(slippage, seq) AS slip_first, avg(slippage) AS slip_mean, avg(slippage) <= 0.0003 AS allowed FROM steps GROUP BY 1", "exposure slip_first slip_mean")
def e8(spark, sf_dir):
    return steps(spark, sf_dir).groupBy(F.col("symbol").alias("log")).agg(
        F.count("*").alias("rows"), F.sum(F.abs("exposure")).alias("exposure"), F.min_by("slippage", "seq").alias("slip_first"), F.avg("slippage").alias("slip_mean"), (F.avg("slippage") <= 0.0003).alias("allowed")
    )


@query(
    "e9_gate_metrics",
    f"""|a AS (SELECT *, CASE WHEN action <> 0 THEN 1 ELSE 0 END AS act, CASE WHEN lag(action) {_W} IS NULL THEN NULL WHEN action <> lag(action) {_W} THEN 1 ELSE 0 END AS flip FROM steps),
    c AS (SELECT *, CASE WHEN act IS DISTINCT FROM lag(act) {_W} OR t = 0 THEN 1 ELSE 0 END AS ch FROM a), i AS (SELECT *, sum(ch) {_W} AS island FROM c),
    s AS (SELECT symbol, island, first(act) AS act, count(*) AS n FROM i GROUP BY 1, 2),
    r AS (SELECT symbol, avg(CASE WHEN act = 1 THEN n END) AS act_runs_mean, quantile_cont(CASE WHEN act = 1 THEN n END, 0.5) AS act_runs_median, avg(CASE WHEN act = 0 THEN n END) AS hold_runs_mean, quantile_cont(CASE WHEN act = 0 THEN n END, 0.5) AS hold_runs_median FROM s GROUP BY 1)
    SELECT symbol, count(*) AS rows, avg(1 - act) AS hold_pct, avg(act) AS act_pct, avg(flip) AS flip_rate, avg(ell) AS ell_mean, quantile_cont(ell, 0.1) AS ell_p10, quantile_cont(ell, 0.5) AS ell_p50, quantile_cont(ell, 0.9) AS ell_p90,
    avg(abs(exposure)) AS exposure_mean, any_value(act_runs_mean) AS act_runs_mean, any_value(act_runs_median) AS act_runs_median, any_value(hold_runs_mean) AS hold_runs_mean, any_value(hold_runs_median) AS hold_runs_median FROM a JOIN r USING (symbol) GROUP BY 1""",
    "hold_pct act_pct flip_rate ell_mean ell_p10 ell_p50 ell_p90 exposure_mean act_runs_mean act_runs_median hold_runs_mean hold_runs_median",
)
def e9(spark, sf_dir):
    return logs.gate_metrics(steps(spark, sf_dir))


@query(
    "e10_act_confusion",
    """SELECT symbol, avg(CAST(acceptable AS INT)) AS acceptable_pct, count_if(acceptable AND action <> 0) / nullif(count_if(action <> 0), 0) AS precision, count_if(acceptable AND action <> 0) / nullif(count_if(acceptable), 0) AS recall,
    CAST(count_if(action <> 0) AS BIGINT) AS act_bars, avg(hold) AS hold_pct FROM steps GROUP BY 1""",
    "acceptable_pct precision recall hold_pct",
)
def e10(spark, sf_dir):
    return logs.confusion(steps(spark, sf_dir), "symbol")


@query(
    "e11_pnl_audit",
    f"""|q AS (SELECT *, pnl + 1 AS e FROM steps), r AS (SELECT *, coalesce(e / nullif(lag(e) {_W}, 0) - 1, 0) AS r, e - max(e) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS dd FROM q),
    a AS (SELECT symbol, arg_max(pnl, (ts, seq)) AS pnl_net, min(dd) AS max_dd, sum(abs(fill)) AS turnover, CAST(count_if(fill <> 0) AS BIGINT) AS trades, sum(fee) AS fees, sum(abs(slippage)) AS impact, avg(r) AS mean_ret, stddev_samp(r) AS std_ret FROM r GROUP BY 1)
    SELECT *, pnl_net + fees AS pnl_gross, pnl_net / nullif(turnover, 0) AS edge_per_turnover FROM a""",
    "pnl_net max_dd turnover fees impact mean_ret std_ret pnl_gross edge_per_turnover",
)
def e11(spark, sf_dir):
    return logs.pnl_audit(steps(spark, sf_dir))


@query(
    "e12_return_splits",
    f"""|f AS (SELECT *, lead(price) {_W} / nullif(price, 0) - 1 AS f FROM steps) SELECT symbol, avg(f) AS ret_all, avg(f) FILTER (action <> 0) AS ret_engaged, avg(f) FILTER (action = 0) AS ret_flat, avg(f) FILTER (bad_flag) AS ret_bad, avg(f) FILTER (NOT bad_flag) AS ret_good FROM f GROUP BY 1""",
    "ret_all ret_engaged ret_flat ret_bad ret_good",
)
def e12(spark, sf_dir):
    return logs.return_splits(steps(spark, sf_dir))


@query("e13_engagement_bins", f'SELECT acceptable, {_cut("actionability", 20)} AS bin, avg(CAST(action <> 0 AS INT)) AS engagement, count(*) AS n, (any_value({_cut("actionability", 20)}) + 0.5) * 0.05 AS bin_center FROM steps WHERE actionability IS NOT NULL GROUP BY 1, 2', "engagement bin_center")
def e13(spark, sf_dir):
    return logs.engagement(steps(spark, sf_dir))


@query("e14_error_rates", f"SELECT {_cut('actionability', 20)} AS bin, avg(CAST(action <> 0 AND NOT acceptable AS INT)) AS fp_rate, avg(CAST(action = 0 AND acceptable AS INT)) AS fn_rate FROM steps WHERE actionability IS NOT NULL GROUP BY 1", "fp_rate fn_rate")
def e14(spark, sf_dir):
    return logs.error_rates(steps(spark, sf_dir))


@query(
    "e15_missed_reasons",
    RUNS + f""", k AS (SELECT *, coalesce(sum(flip) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), 0) / greatest(1, least(t, 19)) AS fr, t - max(CASE WHEN action <> 0 THEN t END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS since,
        sum(CASE WHEN acceptable THEN 0 ELSE 1 END) {_W} AS g FROM runs),
    a AS (SELECT *, sum(CAST(acceptable AS INT)) OVER (PARTITION BY symbol, g ORDER BY ts, seq) AS acc_run FROM k)
    SELECT {_cut('actionability', 10)} AS bin, CAST(count_if(actionability < 0.5) AS BIGINT) AS low_actionability, CAST(count_if(least(CAST(run - 2 AS DOUBLE), 0.6 - fr) <= 0.1) AS BIGINT) AS near_boundary,
    CAST(count_if(coalesce(since <= 3, false)) AS BIGINT) AS cooldown, CAST(count_if(acc_run < 3) AS BIGINT) AS weak_persistence, count(*) AS n FROM a WHERE action = 0 AND acceptable AND actionability IS NOT NULL GROUP BY 1""",
)
def e15(spark, sf_dir):
    from tapeflow.functions import binning

    df = w.legitimacy_margin(steps(spark, sf_dir), 2, 0.6, window=20).drop("run", "flip_rate")
    df = w.since_last(df, F.col("action") != 0, "since")
    df = w.run_length(df.withColumn("ok", F.col("acceptable").cast("int")), "ok", "acc_run")
    df = df.where("action = 0 AND acceptable AND actionability IS NOT NULL").withColumn("bin", binning.cut(F.col("actionability"), 0.0, 1.0, 10))
    return df.groupBy("bin").agg(
        F.count_if(F.col("actionability") < 0.5).alias("low_actionability"), F.count_if(F.col("margin") <= 0.1).alias("near_boundary"), F.count_if(F.coalesce(F.col("since") <= 3, F.lit(False))).alias("cooldown"),
        F.count_if(F.col("acc_run") < 3).alias("weak_persistence"), F.count("*").alias("n"),
    )


def _surface(value: str, where: str = "true", source: str = "steps") -> str:
    return f"SELECT x_bin, y_bin, avg(v) AS mean, count(*) AS n FROM (SELECT {_hist('ell', 0.0, 1.0, 10)} AS x_bin, {_hist('actionability', 0.0, 1.0, 10)} AS y_bin, {value} AS v FROM {source} WHERE {where}) WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2"


def _binned(df, value):
    return logs.binned_surface(df, F.col("ell"), F.col("actionability"), value, (0.0, 1.0), (0.0, 1.0), 10)


@query("e16_acceptable_density", _surface("CAST(acceptable AS INT)"), "mean")
def e16_density(spark, sf_dir):
    return _binned(steps(spark, sf_dir), F.col("acceptable").cast("int"))


@query("e16_run_surface", RUNS + " " + _surface("run", source="runs"), "mean")
def e16_run(spark, sf_dir):
    return _binned(w.run_length(steps(spark, sf_dir)), F.col("run"))


@query("e16_exit_surface", "|x AS (SELECT *, min(CASE WHEN NOT acceptable THEN t END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t AS exit_in FROM steps) " + _surface("exit_in", source="x"), "mean")
def e16_exit(spark, sf_dir):
    return _binned(w.first_exit(steps(spark, sf_dir)), F.col("exit_in"))


@query("e16_direction_surface", _surface("CAST(acceptable AS INT)", "action <> 0"), "mean")
def e16_direction(spark, sf_dir):
    return _binned(steps(spark, sf_dir).where("action <> 0"), F.col("acceptable").cast("int"))


@query("e16_curvature_surface", f"|x AS (SELECT *, abs(lead(p_bad) {_W} - 2 * p_bad + lag(p_bad) {_W}) AS c FROM steps) " + _surface("c", source="x"), "mean")
def e16_curvature(spark, sf_dir):
    return _binned(w.second_difference(steps(spark, sf_dir), "p_bad"), F.abs("curvature"))


@query(
    "e16_action_entropy",
    f"""|c AS (SELECT {_hist('ell', 0.0, 1.0, 10)} AS x_bin, action, count(*) AS n FROM steps GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY x_bin) AS p FROM c)
    SELECT x_bin, -sum(p * log2(p)) AS entropy, CAST(sum(n) AS BIGINT) AS n FROM p WHERE x_bin IS NOT NULL GROUP BY 1""",
    "entropy",
)
def e16_entropy(spark, sf_dir):
    from pyspark.sql import Window

    from tapeflow.functions import binning

    df = steps(spark, sf_dir).groupBy(binning.histogram(F.col("ell"), 0.0, 1.0, 10).alias("x_bin"), "action").agg(F.count("*").alias("n")).where("x_bin IS NOT NULL")
    df = df.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("x_bin")))
    return df.groupBy("x_bin").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum("n").alias("n"))


@query(
    "e17_vector_field",
    f"""|h AS (SELECT * REPLACE (CAST(round(ell * 100) AS BIGINT) AS ell, CAST(round(actionability * 100) AS BIGINT) AS actionability) FROM steps),
    d AS (SELECT *, lead(ell) {_W} - ell AS dx0, lead(actionability) {_W} - actionability AS dy0, {_hist('ell', 0.0, 100.0, 5)} AS x_bin, {_hist('actionability', 0.0, 100.0, 5)} AS y_bin FROM h)
    SELECT x_bin, y_bin, avg(dx0) AS dx, avg(dy0) AS dy, avg(CAST(acceptable AS INT)) AS acceptable, count(*) AS n FROM d WHERE dx0 IS NOT NULL AND dy0 IS NOT NULL AND x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY 1, 2""",
    "dx dy acceptable",
)
def e17(spark, sf_dir):
    """In whole hundredths, so that sums are exact in any order."""
    whole = steps(spark, sf_dir).withColumns({c: F.round(F.col(c) * 100).cast("long") for c in ("ell", "actionability")})
    return logs.vector_field(whole, "ell", "actionability", (0.0, 100.0), (0.0, 100.0), 5)


_DECILE = """|e AS (SELECT list_distinct(quantile_cont({by}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM {src} WHERE {by} IS NOT NULL AND {value} IS NOT NULL),
    b AS (SELECT s.*, CAST(greatest(len(list_filter(edges, lambda x: x < {by})) - 1, 0) AS INT) AS bin FROM {src} s, e WHERE {by} IS NOT NULL AND {value} IS NOT NULL)"""


@query(
    "e18_quantile_surface",
    """|e AS (SELECT list_distinct(quantile_cont(ell, [0, 0.25, 0.5, 0.75, 1.0])) AS ex, list_distinct(quantile_cont(p_bad, [0, 0.25, 0.5, 0.75, 1.0])) AS ey FROM steps),
    b AS (SELECT s.*, CAST(greatest(len(list_filter(ex, lambda x: x < ell)) - 1, 0) AS INT) AS x_bin, CAST(greatest(len(list_filter(ey, lambda x: x < p_bad)) - 1, 0) AS INT) AS y_bin FROM steps s, e)
    SELECT x_bin, y_bin, count(*) AS n, CASE WHEN count(*) >= 20 THEN avg(CAST(action <> 0 AS INT)) END AS action_rate, CASE WHEN count(*) >= 20 THEN avg(pnl) END AS mean_pnl FROM b GROUP BY 1, 2""",
    "action_rate mean_pnl",
)
def e18(spark, sf_dir):
    from tapeflow.functions.binning import with_quantile_bin

    df = with_quantile_bin(with_quantile_bin(steps(spark, sf_dir), "ell", 4, "x_bin"), "p_bad", 4, "y_bin")
    n = F.count("*")
    return df.groupBy("x_bin", "y_bin").agg(n.alias("n"), F.when(n >= 20, logs.share(F.col("action") != 0)).alias("action_rate"), F.when(n >= 20, F.avg("pnl")).alias("mean_pnl"))


@query("e19_surface_pivot", f"SELECT symbol, avg(CAST(action <> 0 AS INT)) FILTER (b = 0) AS b0, avg(CAST(action <> 0 AS INT)) FILTER (b = 1) AS b1, avg(CAST(action <> 0 AS INT)) FILTER (b = 2) AS b2, avg(CAST(action <> 0 AS INT)) FILTER (b = 3) AS b3 FROM (SELECT *, {_hist('ell', 0.0, 1.0, 4)} AS b FROM steps) GROUP BY 1", "b0 b1 b2 b3")
def e19(spark, sf_dir):
    from tapeflow.functions import binning

    df = steps(spark, sf_dir).withColumn("b", F.concat(F.lit("b"), binning.histogram(F.col("ell"), 0.0, 1.0, 4)))
    return df.groupBy("symbol").pivot("b", ["b0", "b1", "b2", "b3"]).agg(logs.share(F.col("action") != 0))


@query("e20_decile_stats", _DECILE.format(by="ell", value="ret", src="steps") + " SELECT bin, avg(ret) AS mean, stddev_samp(ret) AS std, count(*) AS n, avg(CAST(ret > 0 AS INT)) AS hit_rate, stddev_samp(ret) / sqrt(count(*)) AS stderr, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM b GROUP BY 1", "mean std hit_rate stderr sharpe")
def e20(spark, sf_dir):
    return logs.decile_stats(steps(spark, sf_dir), "ell", "ret")


@query("e21_tail_by_reason", "|q AS (SELECT symbol, quantile_cont(ret, 0.1) AS q FROM steps GROUP BY 1) SELECT symbol AS reason, any_value(q) AS tail_quantile, avg(ret) FILTER (ret <= q) AS tail_mean, count(ret) AS n FROM steps JOIN q USING (symbol) GROUP BY 1", "tail_quantile tail_mean")
def e21(spark, sf_dir):
    df = steps(spark, sf_dir)
    q = quantiles(df, ["symbol"], "ret", {"q": 0.1})
    return df.join(q, "symbol").groupBy(F.col("symbol").alias("reason")).agg(F.first("q").alias("tail_quantile"), F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))).alias("tail_mean"), F.count("ret").alias("n"))


_OCC = """{n} AS (SELECT state, pi, n / sum(n) OVER () AS rho FROM (SELECT CAST(acceptable AS INT) * 10 + greatest(0, least(floor(actionability / 0.1 + 1e-12), 9)) AS state, count(*) AS n, avg(CAST(action <> 0 AS INT)) AS pi FROM steps WHERE actionability IS NOT NULL AND {c} GROUP BY 1))"""


@query(
    "e22_policy_distance",
    "|" + _OCC.format(n="a", c="seq % 2 = 0") + ", " + _OCC.format(n="b", c="seq % 2 = 1") + """,
    j AS (SELECT coalesce(a.pi, 0) AS p, coalesce(b.pi, 0) AS q, (coalesce(a.rho, 0) + coalesce(b.rho, 0)) / 2 AS w FROM a FULL JOIN b USING (state)),
    c AS (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS cp, greatest(1e-12, least(1 - 1e-12, q)) AS cq, greatest(1e-12, least(1 - 1e-12, (p + q) / 2)) AS cm FROM j)
    SELECT sum(w * 0.5 * (cp * ln(cp / cm) + (1 - cp) * ln((1 - cp) / (1 - cm)) + cq * ln(cq / cm) + (1 - cq) * ln((1 - cq) / (1 - cm)))) AS js, sum(w * abs(p - q)) AS l1, sqrt(sum(w * (p - q) * (p - q))) AS l2 FROM c""",
    "js l1 l2",
)
def e22(spark, sf_dir):
    df = steps(spark, sf_dir)
    return logs.policy_distance(df.where("seq % 2 = 0"), df.where("seq % 2 = 1"))


@query("e23_transition_kernel", f"|p AS (SELECT action AS s0, lead(action) {_W} AS s1 FROM steps), n AS (SELECT s0, s1, count(*) AS n FROM p WHERE s1 IS NOT NULL GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY s0) AS p FROM n", "p")
def e23(spark, sf_dir):
    return logs.transition_kernel(steps(spark, sf_dir), "action")


@query(
    "e24_ks_distance",
    """|c AS (SELECT price AS v, count_if(seq % 2 = 0) AS a, count_if(seq % 2 = 1) AS b FROM steps GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM c) AS x, sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM c) AS y FROM c) SELECT max(abs(x - y)) AS ks FROM r""",
    "ks",
)
def e24(spark, sf_dir):
    df = steps(spark, sf_dir)
    return logs.ks_distance(df.where("seq % 2 = 0"), df.where("seq % 2 = 1"), "price")


_DENSITY = f"""|d AS (SELECT *, CASE WHEN action <> 0 THEN 1 ELSE 0 END AS m FROM steps), l AS (SELECT *, lag(exposure) {_W} AS x0, lag(m) {_W} AS m0 FROM d),
    r AS (SELECT symbol, sum(x0 * (m - m0)) AS sum_edge, sum(0.001 * m * abs(exposure - x0)) AS sum_cost, CAST(sum(m) AS BIGINT) AS n_support, sum(m) / count(*) AS activity FROM l WHERE m0 IS NOT NULL GROUP BY 1)"""


@query("e25_edge_density", _DENSITY + " SELECT *, sum_edge / (sum_cost + 1e-12) AS rho FROM r", "sum_edge sum_cost activity rho")
def e25(spark, sf_dir):
    return logs.edge_density(steps(spark, sf_dir).withColumn("m", (F.col("action") != 0).cast("int")))


@query(
    "e26_robustness",
    _DENSITY + """ SELECT symbol, rho, reason, CASE WHEN rho < 1 THEN 'false' WHEN reason = 'ok' THEN 'stable' ELSE 'unstable' END AS phase FROM (SELECT *, sum_edge / (sum_cost + 1e-12) AS rho, CASE WHEN n_support < 10 THEN 'sparse_support' WHEN sum_edge / (sum_cost + 1e-12) < 1 THEN 'below_thresh'
    WHEN sum_edge / (sum_cost * 1.25 + 1e-12) < 1 OR sum_edge / (sum_cost * 0.75 + 1e-12) < 1 THEN 'cost_sensitivity' ELSE 'ok' END AS reason FROM r)""",
    "rho",
)
def e26(spark, sf_dir):
    return logs.robustness(logs.edge_density(steps(spark, sf_dir).withColumn("m", (F.col("action") != 0).cast("int")))).select("symbol", "rho", "reason", "phase")
