"""Queries of gates, coverage, entropy and transition tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeflow.operators import gates as g
from tapeflow.operators import logs
from tapeflow.operators import windows as w
from tapeflow.operators.quantiles import median

from .fixtures import bars, steps, table
from .registry import query
from .window_plans import RUNS

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


@query("e28_block_decimation", "|b AS (SELECT symbol, CAST(t // 5 AS BIGINT) AS block, arg_max(exposure, t) AS x, product(1 + coalesce(ret, 0)) - 1 AS ret, count(*) AS n FROM steps GROUP BY 1, 2) SELECT symbol, block, x, ret FROM b WHERE n = 5", "x ret")
def e28(spark, sf_dir):
    return g.block_decimation(steps(spark, sf_dir), 5)


_RHO = "sum(x0 * r) / (sum(0.001 * abs(x - x0)) + 1e-12)"


_MIX = "((({}) % 2147483647) * 48271) % 2147483647"
_SALT = _MIX.format("rep * 7919 + k * 104729 + 1")
_OTHER = f"((({_SALT} - j) % n + n) % n)"
_SWAP = f"CASE WHEN ({_MIX.format(_MIX.format(f'greatest(j, {_OTHER}) + {_SALT}') + ' + ' + _SALT)}) // 32768 % 2 = 1 THEN {_OTHER} ELSE j END"


@query(
    "e29_permutation_null",
    f"""|b AS (SELECT symbol, row_number() {_W.replace('ts, seq', 'i')} - 1 AS i, x0, x, r, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, t AS i, lag(exposure) {_W} AS x0, exposure AS x, coalesce(ret, 0) AS r FROM steps) WHERE x0 IS NOT NULL),
    o AS (SELECT symbol, rep, x0, x, list_reduce(range(0, 12), lambda j, k: {_SWAP}, CAST(i AS BIGINT)) AS j FROM (SELECT b.*, unnest(range(1, 21)) AS rep FROM b)),
    n AS (SELECT o.symbol, rep, sum(o.x0 * b.r) / (sum(0.001 * abs(o.x - o.x0)) + 1e-12) AS rho FROM o JOIN b ON b.symbol = o.symbol AND b.i = o.j GROUP BY 1, 2), m AS (SELECT symbol, quantile_cont(rho, 0.5) AS null_median FROM n GROUP BY 1), w AS (SELECT symbol, {_RHO} AS rho FROM b GROUP BY 1)
    SELECT symbol, rho, null_median, rho - null_median AS delta FROM w JOIN m USING (symbol)""",
    "rho null_median delta",
)
def e29(spark, sf_dir):
    return g.permutation_null(steps(spark, sf_dir), "exposure", "ret")


@query("e30_asymmetry_medians", f"|d AS (SELECT symbol, prev_exposure * ret AS edge, 0.001 * abs(fill) AS cost FROM steps WHERE action <> 0 AND ret IS NOT NULL) SELECT symbol, quantile_cont(edge, 0.5) AS edge_median, quantile_cont(cost, 0.5) AS cost_median, quantile_cont(cost, 0.5) > abs(quantile_cont(edge, 0.5)) AS cost_dominates FROM d GROUP BY 1", "edge_median cost_median")
def e30(spark, sf_dir):
    d = steps(spark, sf_dir).where("action <> 0 AND ret IS NOT NULL").select("symbol", (F.col("prev_exposure") * F.col("ret")).alias("edge"), (0.001 * F.abs("fill")).alias("cost"))
    m = median(d, ["symbol"], "edge", "edge_median").join(median(d, ["symbol"], "cost", "cost_median"), "symbol")
    return m.withColumn("cost_dominates", F.col("cost_median") > F.abs("edge_median"))


@query(
    "e31_segment_drift",
    RUNS + f""", s AS (SELECT *, count(*) OVER (PARTITION BY symbol, island) AS size, abs(ell - lag(ell) {_W}) AS d FROM runs) SELECT symbol, avg(d) FILTER (ch = 0 AND size >= 2) AS inside, avg(d) FILTER (ch = 1) AS across, CAST(count_if(ch = 1) AS BIGINT) AS transitions FROM s GROUP BY 1""",
    "inside across",
)
def e31(spark, sf_dir):
    df = w.islands(steps(spark, sf_dir), "state").withColumn("d", F.abs(F.col("ell") - F.lag("ell").over(w.tape())))
    df = df.withColumns({"size": F.count("*").over(Window.partitionBy("symbol", "island")), "first": F.row_number().over(w.tape("island")) == 1})
    return df.groupBy("symbol").agg(F.avg(F.when(~F.col("first") & (F.col("size") >= 2), F.col("d"))).alias("inside"), F.avg(F.when(F.col("first"), F.col("d"))).alias("across"), F.count_if("first").alias("transitions"))


@query(
    "e32_shadow_report",
    f"""|r AS (SELECT *, lead(price, 5) {_W} / nullif(price, 0) - 1 AS f FROM steps), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ell, seq) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS c FROM r WHERE f IS NOT NULL)
    SELECT symbol, CAST(floor(k * 5 / c) AS BIGINT) AS bucket, avg(f) AS mean_forward, avg(CAST(sign(f) = state AS INT)) AS sign_accuracy, corr(ell, f) AS corr, avg(CAST(action <> 0 AS INT)) AS activation FROM n GROUP BY 1, 2""",
    "mean_forward sign_accuracy corr activation",
)
def e32(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("f", F.try_divide(F.lead("price", 5).over(w.tape()), F.col("price")) - 1).where("f IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("ell", "seq")) - 1
    df = df.withColumns({"k": k, "c": F.count("*").over(Window.partitionBy("symbol"))})
    return df.groupBy("symbol", F.floor(F.col("k") * 5 / F.col("c")).alias("bucket")).agg(F.avg("f").alias("mean_forward"), logs.share(F.signum("f") == F.col("state")).alias("sign_accuracy"), F.corr("ell", "f").alias("corr"), logs.share(F.col("action") != 0).alias("activation"))


@query(
    "e33_surface_coverage",
    """|s AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, count(DISTINCT (user_id % 5, event_id % 2)) / 10 AS share FROM events GROUP BY 1, 2) SELECT symbol, CAST(h AS DATE) AS day, avg(share) AS mean, min(share) AS least, max(share) AS most, count(*) AS snapshots FROM s GROUP BY 1, 2""",
    "mean least most",
)
def e33(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 5).alias("a"), (F.col("event_id") % 2).alias("b"))
    return g.coverage(e, ["a", "b"], 10)


@query(
    "e34_scoreboard",
    """|r AS (SELECT *, pnl - max(pnl) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS dd FROM steps) SELECT symbol, count(*) AS steps, CAST(count_if(fill <> 0) AS BIGINT) AS trades, arg_max(pnl, (ts, seq)) AS pnl, avg(hold) AS hold_pct, min(dd) AS max_dd FROM r GROUP BY 1 ORDER BY pnl DESC""",
    "pnl hold_pct max_dd",
)
def e34(spark, sf_dir):
    df = w.drawdown(steps(spark, sf_dir), "pnl", "dd")
    return df.groupBy("symbol").agg(F.count("*").alias("steps"), F.count_if(F.col("fill") != 0).alias("trades"), F.max_by("pnl", F.struct("ts", "seq")).alias("pnl"), F.avg("hold").alias("hold_pct"), F.min("dd").alias("max_dd")).orderBy(F.desc("pnl"))


@query(
    "e35_quotient_summary",
    """|m AS (SELECT symbol, CAST(ts AS DATE) AS day, quantile_cont(ell, 0.5) AS med FROM steps GROUP BY 1, 2) SELECT symbol, day, avg(ell) AS mean, any_value(med) AS median, quantile_cont(abs(ell - med), 0.5) AS mad, avg(CAST(ell >= 0.5 AS INT)) AS legitimacy_density, avg(CAST(actionability IS NULL AS INT)) AS unknown_frac, count(*) AS n FROM (SELECT *, CAST(ts AS DATE) AS day FROM steps) JOIN m USING (symbol, day) GROUP BY 1, 2""",
    "mean median mad legitimacy_density unknown_frac",
)
def e35(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("day", F.to_date("ts"))
    key = ["symbol", "day"]
    m = median(df, key, "ell")
    mad = median(df.join(m, key), key, F.abs(F.col("ell") - F.col("median")), "mad")
    return m.join(mad, key).join(df.groupBy(*key).agg(F.avg("ell").alias("mean"), logs.share(F.col("ell") >= 0.5).alias("legitimacy_density"), logs.share(F.col("actionability").isNull()).alias("unknown_frac"), F.count("*").alias("n")), key)


@query("e36_transition_buckets", f"|d AS (SELECT *, CASE WHEN p_bad > 0.8 THEN 'stress' WHEN state > 0 THEN 'long' WHEN state < 0 THEN 'short' ELSE 'flat' END AS label, CAST(floor(ell * 4) AS BIGINT) * 10 + ban AS bucket, lead(CAST(round(ell * 100) AS BIGINT)) {_W} AS nxt FROM steps), n AS (SELECT bucket, label, count(*) AS n, avg(nxt) AS mean_next FROM d WHERE nxt IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY bucket) AS total FROM n) SELECT bucket, label, n, n / total AS p, mean_next FROM t WHERE total >= 12", "p mean_next")
def e36(spark, sf_dir):
    label = F.when(F.col("p_bad") > 0.8, "stress").when(F.col("state") > 0, "long").when(F.col("state") < 0, "short").otherwise("flat")
    df = steps(spark, sf_dir).withColumns({"label": label, "bucket": F.floor(F.col("ell") * 4) * 10 + F.col("ban")})
    # Whole hundredths: sums are exact in any order.
    return g.transition_table(df.withColumn("ell", F.round(F.col("ell") * 100).cast("long")), "bucket", "label", "ell")


@query("e37_prefit_pool", "SELECT symbol, seq, ell FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM steps WHERE acceptable AND ell IS NOT NULL) WHERE rn <= 50", "ell")
def e37(spark, sf_dir):
    df = steps(spark, sf_dir).where("acceptable AND ell IS NOT NULL")
    return df.withColumn("rn", F.row_number().over(w.tape())).where("rn <= 50").select("symbol", "seq", "ell")


@query("e38_weight_medians", "|m AS (SELECT event_type AS k, user_id % 4 AS pos, greatest(0.05, least(0.8, 0.7 * quantile_cont(value / 100, 0.5) + 0.3 * 0.25)) AS x FROM events GROUP BY 1, 2) SELECT k, pos, x / sum(x) OVER (PARTITION BY k) AS weight FROM m", "weight")
def e38(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), (F.col("user_id") % 4).alias("pos"), (F.col("value") / 100).alias("v"))
    m = median(e, ["k", "pos"], "v").select("k", "pos", F.greatest(F.lit(0.05), F.least(F.lit(0.8), 0.7 * F.col("median") + 0.3 * 0.25)).alias("x"))
    return m.select("k", "pos", (F.col("x") / F.sum("x").over(Window.partitionBy("k"))).alias("weight"))


_CHARS = "|c AS (SELECT lang, doc_id, unnest(string_split(text, '')) AS sym, unnest(range(length(text))) AS i FROM documents)"


@query("e39_symbol_entropy", _CHARS + ", n AS (SELECT lang, sym, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM n) SELECT lang, -sum(p * log2(p)) AS bits, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1", "bits")
def e39(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "")).alias("sym"))
    return g.entropy(d, "sym", "lang")


@query("e40_context_entropy", _CHARS + ", x AS (SELECT lang, sym, lag(sym) OVER (PARTITION BY doc_id ORDER BY i) AS ctx FROM c), n AS (SELECT lang, ctx, sym, count(*) AS n FROM x GROUP BY 1, 2, 3), b AS (SELECT lang, n, -n * log2(n / sum(n) OVER (PARTITION BY lang, ctx)) AS b FROM n) SELECT lang, sum(b) / sum(n) AS bits, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1", "bits")
def e40(spark, sf_dir):
    # The symbol before stands in the same array, so no window over a text's symbols is needed.
    d = table(spark, sf_dir, "documents").where("text <> ''").select("lang", F.split("text", "").alias("s"))
    pairs = d.select("lang", F.explode(F.arrays_zip(F.col("s").alias("sym"), F.concat(F.array(F.lit(None).cast("string")), F.slice("s", F.lit(1), F.size("s") - 1)).alias("ctx"))).alias("p")).select("lang", "p.sym", "p.ctx")
    return g.context_entropy(pairs, "sym", ["ctx"], "lang")


@query("e41_side_information", "|c AS (SELECT symbol, CAST(round(fill * 10) AS INT) AS v, count(*) AS n FROM steps GROUP BY 1, 2) SELECT symbol, sum(n * (abs(v) - log2((1 - 0.5) / (1 + 0.5 - 2 * 0.5 ** 21)))) AS bits FROM c WHERE abs(v) <= 20 GROUP BY 1", "bits")
def e41(spark, sf_dir):
    c = steps(spark, sf_dir).groupBy("symbol", F.round(F.col("fill") * 10).cast("int").alias("v")).agg(F.count("*").alias("n")).where("abs(v) <= 20")
    norm = F.log2(F.lit((1 - 0.5) / (1 + 0.5 - 2 * 0.5**21)))
    return c.groupBy("symbol").agg(F.sum(F.col("n") * (F.abs("v") - norm)).alias("bits"))


@query("e42_merged_vendor_frames", "SELECT ts, avg(a) AS a, avg(b) AS b FROM (SELECT date_trunc('day', ts) AS ts, value AS a, NULL AS b FROM events WHERE user_id % 2 = 0 UNION ALL SELECT date_trunc('day', ts), NULL, value FROM events WHERE user_id % 2 = 1) GROUP BY 1", "a b")
def e42(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    a, b = e.where("user_id % 2 = 0").select("ts", F.col("value").alias("a")), e.where("user_id % 2 = 1").select("ts", F.col("value").alias("b"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("ts").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))


@query("e44_readiness", "|l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM steps), a AS (SELECT symbol AS target, count_if(ell > 0.3) AS r, count(*) AS n, arg_max(CASE WHEN p_bad > 0.5 THEN 'stress' END, CASE WHEN p_bad > 0.5 THEN (ts, seq) END) AS why FROM l WHERE rn <= 8 GROUP BY 1) SELECT target, r >= 6 AS open, CASE WHEN n < 6 THEN 'waiting ' || n || '/6' WHEN r < 6 THEN coalesce(why, 'not_ready ' || r || '/6') ELSE 'ready' END AS why, CAST(r AS BIGINT) AS ready_count, n AS window_size FROM a")
def e44(spark, sf_dir):
    df = steps(spark, sf_dir).select(F.col("symbol").alias("target"), "ts", "seq", (F.col("ell") > 0.3).alias("ready"), F.when(F.col("p_bad") > 0.5, "stress").otherwise("").alias("reason"))
    return g.readiness(df)


@query("e45_last_allowed", "SELECT symbol, arg_max(ts, (ts, seq)) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(exposure, (ts, seq)) AS exposure FROM steps WHERE slippage <= 0.0003 GROUP BY 1", "exposure")
def e45(spark, sf_dir):
    return g.last_allowed(steps(spark, sf_dir), F.col("slippage") <= 0.0003, "exposure")


@query("e46_escalation", "|l AS (SELECT symbol, arg_max(ell, (ts, seq)) AS ell FROM steps GROUP BY 1), s AS (SELECT DISTINCT symbol, state FROM steps WHERE p_bad > 0.9 AND state <> 0) SELECT symbol, s.state AS direction, ell > 0 AS escalate FROM s JOIN l USING (symbol)")
def e46(spark, sf_dir):
    df = steps(spark, sf_dir)
    last = df.groupBy("symbol").agg(F.max_by("ell", F.struct("ts", "seq")).alias("ell"))
    return df.where("p_bad > 0.9 AND state <> 0").select("symbol", F.col("state").alias("direction")).distinct().join(last, "symbol").select("symbol", "direction", (F.col("ell") > 0).alias("escalate"))


@query(
    "e47_readiness_row",
    f"""|a AS (SELECT *, CASE WHEN action <> 0 THEN 1 ELSE 0 END AS m FROM steps QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 100), l AS (SELECT *, lag(exposure) {_W} AS x0, lag(m) {_W} AS m0 FROM a),
    r AS (SELECT symbol, sum(x0 * (m - m0)) AS e, sum(0.001 * m * abs(exposure - x0)) AS c, CAST(sum(m) AS BIGINT) AS n_support, sum(m) / count(*) AS activity FROM l WHERE m0 IS NOT NULL GROUP BY 1),
    v AS (SELECT *, e / (c + 1e-12) AS rho, CASE WHEN n_support < 10 THEN 'sparse_support' WHEN e / (c + 1e-12) < 1 THEN 'below_thresh' WHEN e / (c * 1.25 + 1e-12) < 1 OR e / (c * 0.75 + 1e-12) < 1 THEN 'cost_sensitivity' ELSE 'ok' END AS reason FROM r)
    SELECT symbol, reason = 'ok' AS ready, reason, rho, n_support, activity FROM v""",
    "rho activity",
)
def e47(spark, sf_dir):
    last = w.latest(steps(spark, sf_dir), "symbol", n=100).withColumn("m", (F.col("action") != 0).cast("int"))
    return logs.robustness(logs.edge_density(last)).select("symbol", (F.col("reason") == "ok").alias("ready"), "reason", "rho", "n_support", "activity")


@query(
    "e48_near_misses",
    """|d AS (SELECT symbol, epoch(ts) AS s, ell AS a7, p_bad AS a8, actionability AS a9, acceptable AS pre, action <> 0 AS op, ban = 1 AS hor FROM steps), r AS (SELECT symbol, min(s) AS lo, max(s) AS hi FROM d GROUP BY 1),
    k AS (SELECT symbol, lo, unnest(generate_series(0, CAST(floor((hi - lo - 86400) / 43200) AS BIGINT))) AS k FROM r),
    a AS (SELECT k.symbol, k.k * 43200 AS t0, count(*) AS n, avg(a7) AS a7, avg(a8) AS a8, avg(a9) AS a9, avg(CAST(pre AS INT)) AS pre, avg(CAST(op AS INT)) AS op, avg(CAST(hor AS INT)) AS hor FROM k JOIN d ON d.symbol = k.symbol AND d.s BETWEEN lo + k.k * 43200 AND lo + k.k * 43200 + 86400 GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT symbol, t0, n, 'boundary_ready_near_miss' AS cls, a7 * (1 - coalesce(a8, 0)) AS rank FROM a WHERE a7 >= 0.4 AND coalesce(a8, 0) < 1
    UNION ALL SELECT symbol, t0, n, 'm8_precheck_missing_horizon', pre * (1 - coalesce(hor, 0)) FROM a WHERE pre > 0.2 AND coalesce(hor, 0) < 1 UNION ALL SELECT symbol, t0, n, 'witness_blocked', op * (1 - a9) FROM a WHERE op > 0.2 AND a9 < 1""",
    "rank",
)
def e48(spark, sf_dir):
    df = steps(spark, sf_dir).select("symbol", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"), F.col("ell").alias("a7"), F.col("p_bad").alias("a8"), F.col("actionability").alias("a9"), F.col("acceptable").alias("precheck"), (F.col("action") != 0).alias("opened"), (F.col("ban") == 1).alias("horizon"))
    return g.near_misses(df, 86400, 43200, 3)


@query("e49_grouping_totals", "SELECT symbol, sum(pnl) AS pnl, count(*) AS n FROM steps GROUP BY ROLLUP (symbol)", "pnl")
def e49(spark, sf_dir):
    return steps(spark, sf_dir).rollup("symbol").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))


@query("e50_bad_onsets", f"|o AS (SELECT *, CASE WHEN bad_flag AND NOT coalesce(lag(bad_flag) {_W}, false) THEN 1 ELSE 0 END AS o FROM steps), g AS (SELECT *, sum(o) {_W} AS g FROM o) SELECT symbol, CAST(g AS BIGINT) AS onset, count(*) AS length, arg_max(pnl, t) - arg_min(pnl, t) AS pnl FROM g WHERE g > 0 GROUP BY 1, 2", "pnl")
def e50(spark, sf_dir):
    onset = (F.col("bad_flag") & ~F.coalesce(F.lag("bad_flag").over(w.tape()), F.lit(False))).cast("int")
    df = steps(spark, sf_dir).withColumn("o", onset).withColumn("onset", F.sum("o").over(w.tape().rowsBetween(Window.unboundedPreceding, 0))).where("onset > 0")
    return df.groupBy("symbol", "onset").agg(F.count("*").alias("length"), (F.max_by("pnl", "t") - F.min_by("pnl", "t")).alias("pnl"))


@query("e51_distinct_counts", "SELECT symbol, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM ticks GROUP BY 1")
def e51(spark, sf_dir):
    from .fixtures import ticks

    return ticks(spark, sf_dir).groupBy("symbol").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("e52_latest_close", "SELECT CAST(ts AS DATE) AS day, symbol, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2", "close")
def e52(spark, sf_dir):
    return bars(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "symbol").agg(F.max_by("close", "ts").alias("close"))


@query("e53_normalised_entropy", "|w AS (SELECT symbol, user_id % 7 AS k, sum(price) AS x FROM ticks GROUP BY 1, 2), p AS (SELECT *, x / sum(x) OVER (PARTITION BY symbol) AS p FROM w WHERE x > 0) SELECT symbol, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS entropy, count(*) AS n FROM p GROUP BY 1", "entropy")
def e53(spark, sf_dir):
    from .fixtures import ticks

    return g.normalised_entropy(ticks(spark, sf_dir).groupBy("symbol", (F.col("user_id") % 7).alias("k")).agg(F.sum("price").alias("x")), "x", "symbol")


@query("e54_promotion_by_plane", "SELECT CAST(least(3, floor(abs(coalesce(ret, 0)) * 4)) AS BIGINT) AS plane, CAST(floor(p_bad * 4) AS BIGINT) AS stress_bin, avg(CAST(action <> 0 AS INT)) AS promotion, avg(pnl) AS mean_pnl, count(*) AS n FROM steps GROUP BY 1, 2", "promotion mean_pnl")
def e54(spark, sf_dir):
    plane = F.least(F.lit(3).cast("long"), F.floor(F.abs(F.coalesce("ret", F.lit(0.0))) * 4))
    return steps(spark, sf_dir).groupBy(plane.alias("plane"), F.floor(F.col("p_bad") * 4).alias("stress_bin")).agg(logs.share(F.col("action") != 0).alias("promotion"), F.avg("pnl").alias("mean_pnl"), F.count("*").alias("n"))


@query("f25_block_reuse", f"|b AS (SELECT symbol, ts, seq, qty % 3 AS pos, CAST(round(price) AS BIGINT) AS v FROM ticks), l AS (SELECT *, lag(v) OVER (PARTITION BY symbol, pos ORDER BY ts, seq) AS p, row_number() OVER (PARTITION BY symbol, v ORDER BY ts, seq) AS k FROM b) SELECT symbol, seq, CASE WHEN v = p THEN 'same' WHEN k > 1 THEN 'reuse' ELSE 'new' END AS label FROM l")
def f25(spark, sf_dir):
    from .fixtures import ticks

    df = ticks(spark, sf_dir).withColumn("pos", F.col("qty") % 3)
    return g.block_reuse(df, F.round("price").cast("long"), "pos").select("symbol", "seq", "label")


@query("f26_residual_digits", f"|b AS (SELECT *, CAST(round(price) AS BIGINT) AS v FROM ticks), r AS (SELECT *, ((v - coalesce(lag(v) {_W}, 0)) % 3 + 3) % 3 AS res FROM b) SELECT symbol, seq, res, CAST((v + 1) % 3 - 1 AS BIGINT) AS d0, CAST(((v + 1) // 3 + 1) % 3 - 1 AS BIGINT) AS d1 FROM r")
def f26(spark, sf_dir):
    from .fixtures import ticks

    v = F.col("v")
    df = ticks(spark, sf_dir).withColumn("v", F.round("price").cast("long"))
    return df.select("symbol", "seq", F.pmod(v - F.coalesce(F.lag("v").over(w.tape()), F.lit(0)), F.lit(3)).alias("res"), (F.pmod(v + 1, F.lit(3)) - 1).alias("d0"), (F.pmod(F.floor((v + 1) / 3) + 1, F.lit(3)) - 1).alias("d1"))


@query("s8_contiguous_windows", f"|b AS (SELECT *, CASE WHEN ts - lag(ts) {_W} <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM steps), g AS (SELECT *, sum(b) {_W} AS g FROM b) SELECT symbol, min(ts) - INTERVAL 5 MINUTE AS start, max(ts) + INTERVAL 5 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY symbol, g")
def s8(spark, sf_dir):
    return g.contiguous_windows(steps(spark, sf_dir), F.expr("INTERVAL 2 HOURS"), F.expr("INTERVAL 5 MINUTES"))


@query("g3_constrained_argmin", "|m AS (SELECT symbol, avg(ell) AS a, avg(p_bad) AS b FROM steps GROUP BY 1) SELECT symbol, a, b FROM m ORDER BY a >= 0.5 DESC, b, symbol LIMIT 1", "a b")
def g3(spark, sf_dir):
    m = steps(spark, sf_dir).groupBy("symbol").agg(F.avg("ell").alias("a"), F.avg("p_bad").alias("b"))
    return m.orderBy(F.desc(F.col("a") >= 0.5), "b", "symbol").limit(1)


@query("g5_tail_window", "SELECT symbol, seq FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM steps) WHERE ts >= m - INTERVAL 1 DAY")
def g5(spark, sf_dir):
    df = steps(spark, sf_dir)
    last = df.groupBy("symbol").agg(F.max("ts").alias("m"))
    return df.join(last, "symbol").where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 1 DAY")).select("symbol", "seq")


@query("g6_bounded_sample", "SELECT symbol, seq FROM steps ORDER BY md5(CAST(seq AS VARCHAR) || '/7'), seq LIMIT 100")
def g6(spark, sf_dir):
    return steps(spark, sf_dir).orderBy(F.md5(F.concat(F.col("seq").cast("string"), F.lit("/7"))), "seq").limit(100).select("symbol", "seq")
