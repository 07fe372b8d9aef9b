"""Queries of tower records, spectral features and remaining window jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators.features import quotient_features
from tapeflow.operators import spectral as sp
from tapeflow.operators import tower as tw
from tapeflow.operators import windows as w
from tapeflow.operators.quantiles import matched, median

from .fixtures import steps, ticks
from .fold_plans import _folded
from .registry import query
from .scalar_plans import CDF
from .window_plans import quotients

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
_FLAGS = "seq % 5 = 0 AS abstain, seq % 2 = 0 AS ready, seq % 7 <> 0 AS ledger, seq % 3 = 0 AS horizon, seq % 11 <> 1 AS fixed, (seq % 6) AS state_age"


def _tower(spark, sf_dir):
    df = steps(spark, sf_dir).selectExpr("*", *[x.strip() for x in _FLAGS.split(",")])
    return tw.tower(df, "run")


_TOWER = f"""|f AS (SELECT *, {_FLAGS}, CASE WHEN ban > 0 THEN 'BAN' WHEN hold > 0 THEN 'HOLD' ELSE 'ACT' END AS posture FROM steps),
    g AS (SELECT *, NOT abstain AND state_age >= 3 AS boundary FROM f), tower AS (SELECT *, boundary AND ready AND fixed AND ledger AS pre, CASE WHEN NOT boundary THEN 'missing_boundary_stable' WHEN NOT ready THEN 'missing_phase8_ready' WHEN NOT fixed THEN 'missing_actuator_mode_fixed' WHEN NOT ledger THEN 'missing_ledger_ready' WHEN NOT horizon THEN 'missing_horizon_certified' ELSE 'open' END AS reason FROM g)"""


@query("c21_tower_projection", _TOWER + " SELECT symbol, seq, posture, pre, pre AND horizon AS opened, reason, least(1.0, state_age / 3.0) AS a5, CASE posture WHEN 'ACT' THEN 1.0 WHEN 'HOLD' THEN 0.5 ELSE 0.0 END AS a9 FROM tower", "a5 a9")
def c21(spark, sf_dir):
    return _tower(spark, sf_dir).select("symbol", "seq", F.col("P5.posture").alias("posture"), F.col("M8.precheck").alias("pre"), F.col("M8.open").alias("opened"), F.col("M8.reason").alias("reason"), F.col("P5.A5").alias("a5"), F.col("P9.A9").alias("a9"))


@query(
    "c22_invariants",
    _TOWER + """, v AS (SELECT symbol, seq, 'I3' AS rule FROM tower WHERE seq % 4 = 0 AND pre AND horizon UNION ALL SELECT symbol, seq, 'I3' FROM tower WHERE seq % 4 = 0 AND action <> 0
    UNION ALL SELECT symbol, seq, 'I6' FROM tower WHERE posture <> 'ACT' AND action <> 0 UNION ALL SELECT symbol, seq, 'I5' FROM tower WHERE action <> 0 AND seq % 9 = 0) SELECT symbol, rule, count(*) AS n FROM v GROUP BY 1, 2""",
)
def c22(spark, sf_dir):
    df = _tower(spark, sf_dir).withColumns({"gate_closed": F.col("seq") % 4 == 0, "active": F.col("action") != 0, "justified": F.col("seq") % 9 != 0})
    return tw.violations(df).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


@query(
    "c29_tape_legitimacy",
    quotients(16, 64) + """ SELECT symbol, seq, greatest(0.0, least(1.0, exp(-(0.5 * ln(1 + vol_ratio) + 0.5 * ln(1 + drawdown) + 0.2 * ln(1 + abs(burstiness - 1)) + 0.3 * (1 - abs(acorr_1)) + 0.1 * curvature)))) AS ell FROM q""",
    "ell",
)
def c29(spark, sf_dir):
    df = quotient_features(steps(spark, sf_dir).select("symbol", "ts", "seq", "price"), 16, 64)
    penalty = 0.5 * F.log1p("vol_ratio") + 0.5 * F.log1p("drawdown") + 0.2 * F.log1p(F.abs(F.col("burstiness") - 1)) + 0.3 * (1 - F.abs("acorr_1")) + 0.1 * F.col("curvature")
    return df.select("symbol", "seq", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-penalty))).alias("ell"))


_UNIT = "greatest(0.0, least(1.0, {0}))"


@query(
    "c26_size_bucket",
    _folded(
        "0.0::DOUBLE AS ema; 0.0::DOUBLE AS size",
        ["(1 - 2 / 9.0) * b_ema + 2 / 9.0 * action * ell AS e1", f"{_UNIT.format('0.65 * ' + _UNIT.format('abs(coalesce(ret, 0))') + ' + 0.35 * ' + _UNIT.format('(e1 + 1) / 2'))} * (1 - 0.6 * p_bad) AS z"],
        "e1, CASE WHEN action = 0 OR z < 0.25 THEN 0.0 WHEN z < 0.75 THEN 0.5 ELSE 1.0 END",
        "size",
    ),
    "size",
)
def c26(spark, sf_dir):
    from tapeflow.operators.folds import ewma

    df = steps(spark, sf_dir).withColumn("trend", F.col("action") * F.col("ell"))
    df = ewma(df, "trend", 2 / 9, "ema")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    z = unit(0.65 * unit(F.abs(F.coalesce("ret", F.lit(0.0)))) + 0.35 * unit((F.col("ema") + 1) / 2)) * (1 - 0.6 * F.col("p_bad"))
    return df.select("symbol", "seq", F.when((F.col("action") == 0) | (z < 0.25), 0.0).when(z < 0.75, 0.5).otherwise(1.0).alias("size"))


@query(
    "e43_density_gate",
    """|h AS (SELECT symbol AS target, weekofyear(ts) AS iteration, CASE WHEN seq % 2 = 0 THEN 'T' ELSE 'R' END AS ont, user_id % 3 AS bin, count(*) AS n, quantile_cont(price, 0.5) AS med FROM ticks GROUP BY ALL),
    r AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY iteration DESC) AS k FROM h) WHERE k <= 3),
    s AS (SELECT *, CASE WHEN n >= 1 AND med <> 0 THEN sign(med) END AS sg FROM r),
    f AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY target, ont, bin ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
    b AS (SELECT target, ont, bin, count_if(n >= 1) AS hits, sum(CASE WHEN sg <> b THEN 1 ELSE 0 END) AS flips, arg_max(n, iteration) AS n, arg_max(med, iteration) AS med FROM f GROUP BY 1, 2, 3),
    g AS (SELECT *, hits >= 2 AND flips <= 1 AND n >= 1 AS good FROM b),
    o AS (SELECT target, ont, sum(n) AS rows, count_if(good) AS bins, min(n) FILTER (good) AS lo, max(n) FILTER (good) AS hi, max(med) FILTER (good) - min(med) FILTER (good) AS effect FROM g GROUP BY 1, 2),
    w AS (SELECT target, CASE WHEN rows < 5 THEN ont || ' rows' WHEN bins < 2 THEN ont || ' bins' WHEN lo / hi < 0.2 THEN ont || ' balance' WHEN effect < 0.0005 THEN ont || ' effect' END AS r FROM o)
    SELECT target, count(r) = 0 AS open, coalesce(string_agg(r, ',' ORDER BY r), '') AS reasons FROM w GROUP BY 1""",
)
def e43(spark, sf_dir):
    df = ticks(spark, sf_dir).select(F.col("symbol").alias("target"), F.weekofyear("ts").alias("iteration"), F.when(F.col("seq") % 2 == 0, "T").otherwise("R").alias("ont"), (F.col("user_id") % 3).alias("bin"), "price")
    cell = ["target", "iteration", "ont", "bin"]
    history = matched(df.groupBy(*cell).agg(F.count("*").alias("count")), median(df, cell, "price"), cell, "left")
    return tw.density_gate(history, least_rows=5, least_bin=1)


def _spectrum(n: int, i: int) -> str:
    """Energy, cancellation and spectral share of a list of n values a{i}, as e{i}, c{i}, s{i}."""
    wave = lambda f: f"list_sum(list_transform(range(0, {n}), lambda j: x[CAST(j + 1 AS INT)] * {f}(2 * pi() * k * j / {n})))"
    return f"""m{i} AS (SELECT *, list_median(a{i}) AS mid FROM {'n' if i == 1 else 'q1'}), x{i} AS (SELECT * EXCLUDE (mid, a{i}), list_transform(a{i}, lambda v: v / greatest(list_median(list_transform(a{i}, lambda u: abs(u - mid))), 1e-9)) AS x FROM m{i}),
    p{i} AS (SELECT *, list_transform(range(0, {n // 2 + 1}), lambda k: pow({wave('cos')}, 2) + pow({wave('sin')}, 2)) AS power, list_sum(list_transform(x, lambda v: abs(v))) AS total FROM x{i}),
    q{i} AS (SELECT * EXCLUDE (x, power, total), list_sum(list_transform(x, lambda v: v * v)) / {n} AS e{i}, CASE WHEN total > 1e-9 THEN abs(list_sum(x)) / greatest(total, 1e-9) ELSE 0 END AS c{i}, list_max(power) / greatest(list_sum(power), 1e-9) AS s{i} FROM p{i})"""


@query(
    "f2_spectral_features",
    f"""|r AS (SELECT symbol, ts, seq, CASE WHEN price > 0 AND lag(price) {_W} > 0 THEN ln(price) - ln(lag(price) {_W}) END AS r FROM steps),
    n AS (SELECT * EXCLUDE (ts, r) FROM (SELECT *, list(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS a1, list(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS a2 FROM r WHERE r IS NOT NULL) WHERE len(a2) = 64),
    {_spectrum(16, 1)}, {_spectrum(64, 2)} SELECT *, abs(e1 - e2) AS delta_e, abs(c1 - c2) AS delta_c, abs(s1 - s2) AS delta_s FROM q2""",
    "e1 c1 s1 e2 c2 s2 delta_e delta_c delta_s",
)
def f2(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("r", w.returns(log=True))
    return sp.spectral_features(df.select("symbol", "ts", "seq", "r"), "r", 16, 64).drop("ts", "r")


@query(
    "f10_synthetic_bad",
    f"""|r AS (SELECT *, coalesce(price / nullif(lag(price) {_W}, 0) - 1, 0) AS r, max(pnl) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - pnl AS dd FROM steps),
    s AS (SELECT *, CASE WHEN t >= 49 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sd, coalesce(dd - lag(dd) {_W}, 0) AS slope FROM r),
    b AS (SELECT *, coalesce(sd, first_value(sd IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS sg FROM s) SELECT symbol, seq, abs(r) > 3 * sg OR slope > 0.00151 AS bad FROM b""",
)
def f10(spark, sf_dir):
    v = w.tape()
    df = w.drawdown(steps(spark, sf_dir), "pnl").withColumns({"r": F.coalesce(w.returns(), F.lit(0.0)), "dd": -F.col("drawdown")})
    df = w.rolling(df, "r", 50, "sd").withColumn("slope", F.coalesce(F.col("dd") - F.lag("dd").over(v), F.lit(0.0)))
    sg = F.coalesce("sd", w.next_known(F.col("sd")), F.lit(0.0))
    return df.select("symbol", "seq", ((F.abs("r") > 3 * sg) | (F.col("slope") > 0.00151)).alias("bad"))


@query(
    "f22_goal_probability",
    f"""|d AS (SELECT *, coalesce(pnl - lag(pnl) {_W}, 0) AS d, count(*) OVER (PARTITION BY symbol) - t - 1 AS togo FROM steps), m AS (SELECT *, avg(d) OVER f AS mu, stddev_pop(d) OVER f AS sd FROM d WINDOW f AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, pnl + mu * togo AS mean, sd * sqrt(togo) AS std FROM m), x AS (SELECT *, (0.5 - mean) / std AS x FROM g)
    SELECT symbol, seq, CASE WHEN std > 0 THEN 1 - {CDF.format('x')} ELSE CAST(mean >= 0.5 AS DOUBLE) END AS goal_prob, greatest(0.0, 0.5 - mean) AS shortfall FROM x""",
    "goal_prob shortfall",
)
def f22(spark, sf_dir):
    return sp.goal_probability(steps(spark, sf_dir).select("symbol", "ts", "seq", "pnl"), "pnl", 0.5).select("symbol", "seq", "goal_prob", "shortfall")


@query(
    "f24_volatility_gate",
    f"""|v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM steps WHERE ret IS NOT NULL), m AS (SELECT *, quantile_cont(vol, 0.5) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS med FROM v),
    s AS (SELECT *, CASE WHEN abs(ret) > 0.5 * vol THEN CAST(sign(ret) AS INT) ELSE 0 END * CASE WHEN vol < 1.5 * med THEN 1 ELSE -1 END AS pos FROM m),
    p AS (SELECT *, pos * (ret - CASE WHEN pos <> coalesce(lag(pos) {_W}, 0) THEN 0.0001 * abs(pos) ELSE 0 END) AS gain, CASE WHEN pos <> coalesce(lag(pos) {_W}, 0) THEN 1 ELSE 0 END AS traded FROM s) SELECT symbol, sum(gain) AS total, avg(CAST(gain > 0 AS INT)) AS hit, CAST(sum(traded) AS BIGINT) AS trades FROM p GROUP BY 1""",
    "total hit",
)
def f24(spark, sf_dir):
    v = w.tape()
    df = steps(spark, sf_dir).where("ret IS NOT NULL").select("symbol", "ts", "seq", "ret").withColumn("vol", F.stddev_samp("ret").over(w.trailing(20)))
    df = sp.sliding(df, "vol", 21, 0.5, "med")
    trit = F.when(F.abs("ret") > 0.5 * F.col("vol"), F.signum("ret").cast("int")).otherwise(0)
    df = df.withColumn("pos", trit * F.when(F.col("vol") < 1.5 * F.col("med"), 1).otherwise(-1))
    df = df.withColumn("traded", (F.col("pos") != F.coalesce(F.lag("pos").over(v), F.lit(0))).cast("int"))
    df = df.withColumn("gain", F.col("pos") * (F.col("ret") - F.col("traded") * 0.0001 * F.abs("pos")))
    return df.groupBy("symbol").agg(F.sum("gain").alias("total"), F.avg((F.col("gain") > 0).cast("int")).alias("hit"), F.sum("traded").alias("trades"))


@query(
    "k18_adaptive_threshold",
    """|p AS (SELECT avg(ell) AS pm, stddev_pop(ell) AS ps FROM steps), o AS (SELECT symbol, ts, seq, ell, pm, ps, count(ell) OVER f AS n, avg(ell) OVER f AS m, stddev_pop(ell) OVER f AS s FROM steps, p WINDOW f AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, least(1.0, n / 50) AS k FROM o), z AS (SELECT *, (ell - (k * coalesce(m, pm) + (1 - k) * pm)) / greatest(k * coalesce(s, ps) + (1 - k) * ps, 0.001) AS z FROM k),
    l AS (SELECT *, list_sort(list(z) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) AS seen FROM z)
    SELECT symbol, seq, z, CASE WHEN len(seen) >= 20 THEN seen[greatest(1, CAST(round(0.9 * (len(seen) - 1)) AS INT) + 1)] ELSE 2.0 END AS threshold FROM l""",
    "z threshold",
)
def k18(spark, sf_dir):
    df = sp.standardised_score(steps(spark, sf_dir).select("symbol", "ts", "seq", "ell"), "ell", 100, 50)
    return sp.adaptive_threshold(df, "z", "threshold", 0.1, 100, 20, 2.0).select("symbol", "seq", "z", "threshold")


@query("f27_component_tracking")
def f27(spark, sf_dir):
    from tapeflow.functions import binning
    from tapeflow.operators.tracking import track

    df = steps(spark, sf_dir).where("acceptable").select("symbol", F.floor(F.col("t") / 20).alias("slice"), binning.histogram(F.col("ell"), 0.0, 1.0, 20).alias("bin"))
    return track(df, "slice", "bin").select("symbol", F.col("ts").alias("slice"), "alive", "born", "ended", "lasted")


@query("k17_live_legitimacy", "SELECT symbol, seq, least(1.0, (t + 1) * 0.01) AS schedule FROM steps", "schedule")
def k17(spark, sf_dir):
    from tapeflow.operators.tracking import live_legitimacy

    return steps(spark, sf_dir).select("symbol", "seq", live_legitimacy("schedule").alias("schedule"))


@query(
    "k17_live_modes",
    "|f AS (SELECT symbol, seq, ell, stddev_pop(ret) OVER w AS sd, avg(ell) OVER w AS m FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) SELECT symbol, seq, coalesce(exp(-sd), 1.0) AS vol, coalesce(1 / (1 + (ell - m) * (ell - m)), 1.0) AS spread FROM f",
    "vol spread",
)
def k17_modes(spark, sf_dir):
    from tapeflow.operators.tracking import live_legitimacy

    return steps(spark, sf_dir).select("symbol", "seq", live_legitimacy("vol").alias("vol"), live_legitimacy("spread", column="ell").alias("spread"))


@query(
    "h4_contract_problems",
    """|t AS (SELECT 'bars' AS target, ['close', 'vwap'] AS required, (SELECT count(*) FROM bars) AS n, (SELECT json_keys(to_json(b)) FROM bars b LIMIT 1) AS have
        UNION ALL SELECT x, ['ell', 'spread'], (SELECT count(*) FROM steps WHERE symbol = x), (SELECT json_keys(to_json(s)) FROM steps s LIMIT 1) FROM (VALUES ('click'), ('view'), ('never')) v(x)),
    g AS (SELECT symbol, arg_max(acceptable, (ts, seq)) AS open FROM steps WHERE symbol IN ('click', 'view') GROUP BY 1)
    SELECT target, 'missing ' || c AS problem FROM (SELECT target, have, unnest(required) AS c FROM t) WHERE NOT list_contains(have, c)
    UNION ALL SELECT target, 'rows ' || n FROM t WHERE n < 100
    UNION ALL SELECT target, CASE WHEN open IS NULL THEN 'no gate entry' ELSE 'gate closed' END FROM t LEFT JOIN g ON g.symbol = target WHERE NOT coalesce(open, false)""",
)
def h4(spark, sf_dir):
    from tapeflow.operators.tracking import contract_problems

    from .fixtures import bars

    s = steps(spark, sf_dir)
    gates = s.where("symbol IN ('click', 'view')").select(F.col("symbol").alias("target"), F.struct("ts", "seq").alias("ts"), F.col("acceptable").alias("open"))
    tables = {"bars": bars(spark, sf_dir)} | {x: s.where(F.col("symbol") == x) for x in ("click", "view", "never")}
    return contract_problems(tables, {"bars": ["close", "vwap"]} | {x: ["ell", "spread"] for x in ("click", "view", "never")}, 100, gates)
