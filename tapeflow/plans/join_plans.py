"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeflow.operators import joins as j

from .fixtures import bars, steps, table, ticks
from .registry import query

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
_RIGHT = "r AS (SELECT symbol, ts, close, volume FROM bars WHERE trades % 2 = 0)"


@query("d1_asof_backward", f"|{_RIGHT} SELECT t.symbol, t.seq, r.ts AS right_ts, r.close, r.volume FROM ticks t ASOF LEFT JOIN r ON t.symbol = r.symbol AND t.ts >= r.ts", "close")
def d1(spark, sf_dir):
    right = bars(spark, sf_dir).where("trades % 2 = 0")
    return j.asof(ticks(spark, sf_dir), right, values=("close", "volume")).select("symbol", "seq", "right_ts", "close", "volume")


@query(
    "d1_asof_many_short_tapes",
    """|o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
    SELECT l.o_orderkey, o.o_orderdate AS right_ts, o.k, o.p FROM orders l ASOF LEFT JOIN o ON l.o_custkey = o.o_custkey AND l.o_orderdate >= o.o_orderdate WHERE l.o_orderkey % 3 <> 0""",
    "p",
)
def d1_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    right = o.where("o_orderkey % 3 = 0").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("k"), F.max("o_totalprice").alias("p"))
    return j.asof(o.where("o_orderkey % 3 <> 0"), right, "o_orderdate", ("o_custkey",), ("k", "p")).select("o_orderkey", "right_ts", "k", "p")


@query(
    "d2_asof_tolerance",
    f"""|{_RIGHT}, a AS (SELECT t.symbol, t.seq, t.ts, r.ts AS right_ts, r.trades_ready FROM ticks t ASOF LEFT JOIN (SELECT symbol, ts, volume AS trades_ready FROM r) r ON t.symbol = r.symbol AND t.ts >= r.ts)
    SELECT symbol, seq, CASE WHEN ts - right_ts <= INTERVAL 90 MINUTE THEN trades_ready END AS ready, CASE WHEN ts - right_ts <= INTERVAL 90 MINUTE THEN least(1.0, trades_ready / 10.0) END AS a8 FROM a""",
    "a8",
)
def d2(spark, sf_dir):
    right = bars(spark, sf_dir).where("trades % 2 = 0")
    found = j.asof(ticks(spark, sf_dir), right, values=("volume",), tolerance=F.expr("INTERVAL 90 MINUTES"))
    return found.select("symbol", "seq", F.col("volume").alias("ready"), F.when(F.col("volume").isNotNull(), F.least(F.lit(1.0), F.col("volume") / 10)).alias("a8"))


@query(
    "d3_asof_snapshot_group",
    """|g AS (SELECT event_type AS symbol, date_trunc('day', ts) AS snap_ts, user_id % 5 AS cell, max(value) AS mid FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2, 3), d AS (SELECT DISTINCT symbol, snap_ts FROM g),
    a AS (SELECT b.symbol, b.ts, d.snap_ts FROM bars b ASOF JOIN d ON b.symbol = d.symbol AND b.ts >= d.snap_ts) SELECT a.symbol, a.ts, a.snap_ts, g.cell, g.mid FROM a JOIN g USING (symbol, snap_ts) WHERE a.ts - a.snap_ts <= INTERVAL 12 HOUR""",
    "mid",
)
def d3(spark, sf_dir):
    g = ticks(spark, sf_dir).where("user_id % 3 = 0").groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 5).alias("cell")).agg(F.max("price").alias("mid"))
    return j.asof_group(bars(spark, sf_dir).select("symbol", "ts"), g, "ts", ("symbol",), F.expr("INTERVAL 12 HOURS")).select("symbol", "ts", "snap_ts", "cell", "mid")


@query("d4_fallback_union", "|r AS (SELECT symbol, ts, close FROM bars WHERE trades > 1) SELECT symbol, ts, close, false AS filled FROM r UNION ALL SELECT symbol, ts, open, true FROM bars b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = b.symbol AND r.ts = b.ts)", "close")
def d4(spark, sf_dir):
    b = bars(spark, sf_dir)
    return j.fallback(b.where("trades > 1").select("symbol", "ts", "close"), b.select("symbol", "ts", F.col("open").alias("close")), ["symbol", "ts"])


@query(
    "d5_cross_lag_pairs",
    """|s AS (SELECT symbol, CAST(date_diff('day', TIMESTAMP '2000-01-01', date_trunc('day', ts)) AS BIGINT) AS k, avg(close) AS v FROM bars GROUP BY 1, 2)
    SELECT a.symbol AS target, b.symbol AS source, a.k AS "at", CAST(a.k - b.k AS INT) AS lag, a.v - b.v AS delta, a.v * b.v AS product FROM s a JOIN s b ON a.k - b.k BETWEEN 1 AND 4""",
    "delta product",
)
def d5(spark, sf_dir):
    s = bars(spark, sf_dir).groupBy("symbol", F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).cast("long").alias("window_index")).agg(F.avg("close").alias("value"))
    return j.cross_lag_pairs(s, 4)


_DAILY = "d AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))


@query("d6_inner_alignment", f"|{_DAILY}, n AS (SELECT count(DISTINCT symbol) AS k FROM d), g AS (SELECT ts FROM d, n GROUP BY ts, k HAVING count(*) = k) SELECT d.symbol, avg(close) AS mean_close, count(*) AS n FROM d JOIN g USING (ts) GROUP BY 1", "mean_close")
def d6(spark, sf_dir):
    grid = j.aligned(_daily(spark, sf_dir), "close")
    return grid.groupBy("symbol").agg(F.avg("close").alias("mean_close"), F.count("*").alias("n"))


@query(
    "d7_lagged_correlation",
    f"""|{_DAILY}, n AS (SELECT count(DISTINCT symbol) AS k FROM d), g AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT ts FROM d, n GROUP BY ts, k HAVING count(*) = k)), x AS (SELECT symbol, i, close FROM d JOIN g USING (ts))
    SELECT a.symbol AS target, b.symbol AS source, CAST(a.i - b.i AS INT) AS lag, count(*) AS n, corr(a.close, b.close) AS score FROM x a JOIN x b ON a.symbol <> b.symbol AND a.i - b.i IN (1, 2) GROUP BY 1, 2, 3""",
    "score",
)
def d7(spark, sf_dir):
    return j.lagged_correlations(_daily(spark, sf_dir), "close", [1, 2])


@query("d8_trade_entry_step", "|t AS (SELECT symbol, t AS exit_step, t - 3 AS entry_step FROM steps WHERE action <> 0 AND t >= 3) SELECT t.symbol, t.entry_step, t.exit_step, s.price AS entry_price, s.ell AS entry_ell FROM t JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY seq) AS rn FROM steps) s ON s.symbol = t.symbol AND s.t = t.entry_step AND rn = 1", "entry_price entry_ell")
def d8(spark, sf_dir):
    s = steps(spark, sf_dir)
    trades = s.where("action <> 0 AND t >= 3").select("symbol", F.col("t").alias("exit_step"), (F.col("t") - 3).alias("entry_step"))
    first = s.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "t").orderBy("seq"))).where("_rn = 1")
    return trades.join(first.select("symbol", F.col("t").alias("entry_step"), F.col("price").alias("entry_price"), F.col("ell").alias("entry_ell")), ["symbol", "entry_step"])


@query(
    "d9_nearest_entries",
    """|z AS (SELECT c_custkey AS id, c_nationkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a, (c_custkey % 97 - avg(c_custkey % 97) OVER ()) / stddev_pop(c_custkey % 97) OVER () AS b FROM customer),
    p AS (SELECT l.id AS left_id, r.id AS right_id, sqrt((l.a - r.a) * (l.a - r.a) + (l.b - r.b) * (l.b - r.b)) AS distance FROM z l JOIN z r ON l.id % 20 = 0 AND r.id <> l.id),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS INT) AS rank FROM p) SELECT left_id, rank, right_id, distance FROM k WHERE rank <= 3""",
    "distance",
)
def d9(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"))
    z = j.z_scored(c, ["a", "b"])
    return j.nearest(z.where("id % 20 = 0"), z, ["a", "b"], 3).select("left_id", "rank", "right_id", "distance")


@query(
    "d10_events_in_windows",
    """|w AS (SELECT symbol, ts - INTERVAL 10 MINUTE AS start, ts + INTERVAL 50 MINUTE AS "end" FROM bars WHERE trades >= 2), e AS (SELECT w.symbol AS window_symbol, w.start, t.symbol, t.price FROM w JOIN ticks t ON t.ts BETWEEN w.start AND w."end")
    SELECT window_symbol, start, count(*) AS n, avg(price) AS tone, count(DISTINCT symbol) AS codes FROM e GROUP BY 1, 2""",
    "tone",
)
def d10(spark, sf_dir):
    w = bars(spark, sf_dir).where("trades >= 2").select(F.col("symbol").alias("window_symbol"), (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("start"), (F.col("ts") + F.expr("INTERVAL 50 MINUTES")).alias("end"))
    found = j.in_windows(w, ticks(spark, sf_dir), 3600)
    return found.groupBy("window_symbol", "start").agg(F.count("*").alias("n"), F.avg("price").alias("tone"), F.countDistinct("symbol").alias("codes"))


@query("d11_execution_index_join", f"SELECT symbol, t, exposure * (h - price) - 0.001 * abs(exposure) * price AS realized FROM (SELECT *, lead(price, 5) {_W} AS h FROM steps) WHERE h IS NOT NULL AND exposure <> 0", "realized")
def d11(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("h", F.lead("price", 5).over(Window.partitionBy("symbol").orderBy("ts", "seq"))).where("h IS NOT NULL AND exposure <> 0")
    return df.select("symbol", "t", (F.col("exposure") * (F.col("h") - F.col("price")) - 0.001 * F.abs("exposure") * F.col("price")).alias("realized"))


@query("d12_not_ingested", "SELECT symbol, seq FROM ticks WHERE seq NOT IN (SELECT seq FROM ticks WHERE qty = 1)")
def d12(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.join(t.where("qty = 1").select("seq"), "seq", "left_anti").select("symbol", "seq")


_CELL = "CAST(floor(t / 50) AS BIGINT) AS t_bin, CAST(least(floor(ell * 10 + 1e-12), 9) AS INT) AS a_bin"


@query("d13_mask_overlap", f"|a AS (SELECT DISTINCT symbol, {_CELL} FROM steps WHERE acceptable), b AS (SELECT DISTINCT symbol, {_CELL} FROM steps WHERE action <> 0) SELECT symbol, count_if(a.x AND b.y) AS both_n, count_if(a.x AND b.y IS NULL) AS only_a, count_if(a.x IS NULL AND b.y) AS only_b FROM (SELECT *, true AS x FROM a) a FULL JOIN (SELECT *, true AS y FROM b) b USING (symbol, t_bin, a_bin) GROUP BY 1")
def d13(spark, sf_dir):
    from tapeflow.functions import binning

    s = steps(spark, sf_dir).select("symbol", F.floor(F.col("t") / 50).alias("t_bin"), binning.histogram(F.col("ell"), 0.0, 1.0, 10).alias("a_bin"), "acceptable", "action")
    both = s.groupBy("symbol", "t_bin", "a_bin").agg(F.max(F.col("acceptable").cast("int")).alias("x"), F.max((F.col("action") != 0).cast("int")).alias("y"))
    return both.groupBy("symbol").agg(F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("both_n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("only_a"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("only_b"))


@query("d14_compare_logs", "SELECT count(*) AS rows, avg(CAST((a.action <> 0) = (b.action <> 0) AS INT)) AS act_equal, count_if(a.ban = 1 AND b.action <> 0) AS veto_act, count_if(a.bad_flag AND b.action <> 0) AS hazard_act, avg(CAST(b.action <> 0 AS INT)) - avg(CAST(a.action <> 0 AS INT)) AS rate_change FROM (SELECT *, row_number() OVER (ORDER BY ts, seq) AS i FROM steps WHERE symbol = 'click') a JOIN (SELECT *, row_number() OVER (ORDER BY ts, seq) AS i FROM steps WHERE symbol = 'view') b USING (i)", "act_equal rate_change")
def d14(spark, sf_dir):
    s = steps(spark, sf_dir)
    a = s.where("symbol = 'click'").select("t", F.col("action").alias("a"), F.col("ban"), F.col("bad_flag"))
    b = s.where("symbol = 'view'").select("t", F.col("action").alias("b"))
    act = lambda c: (F.col(c) != 0)
    return a.join(b, "t").agg(
        F.count("*").alias("rows"), F.avg((act("a") == act("b")).cast("int")).alias("act_equal"), F.count_if((F.col("ban") == 1) & act("b")).alias("veto_act"), F.count_if(F.col("bad_flag") & act("b")).alias("hazard_act"),
        (F.avg(act("b").cast("int")) - F.avg(act("a").cast("int"))).alias("rate_change"),
    )


@query(
    "d15_shrinkage_blend",
    """|g AS (SELECT user_id % 7 AS bucket, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id % 7 AS bucket, event_type AS label, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2),
    gp AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket) AS p, sum(n) OVER (PARTITION BY bucket) AS total FROM g), ap AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket) AS p, sum(n) OVER (PARTITION BY bucket) AS total FROM a),
    t AS (SELECT bucket, max(gt) AS gt, max(ta) AS ta FROM (SELECT bucket, total AS gt, 0 AS ta FROM gp UNION ALL SELECT bucket, 0, total FROM ap) GROUP BY 1),
    m AS (SELECT bucket, label, coalesce(ap.p, 0) * (ta / (ta + gt)) + coalesce(gp.p, 0) * (1 - ta / (ta + gt)) AS w FROM gp FULL JOIN ap USING (bucket, label) JOIN t USING (bucket)) SELECT bucket, label, w / sum(w) OVER (PARTITION BY bucket) AS weight FROM m""",
    "weight",
)
def d15(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("bucket"), F.col("event_type").alias("label"), "user_id")
    both = e.groupBy("bucket", "label").agg(F.count("*").alias("g"), F.count_if(F.col("user_id") % 2 == 0).alias("a"))
    w = Window.partitionBy("bucket")
    both = both.withColumns({"gt": F.sum("g").over(w), "at": F.sum("a").over(w)}).withColumn("lam", F.col("at") / (F.col("at") + F.col("gt")))
    both = both.withColumn("w", F.when(F.col("at") > 0, F.col("a") / F.col("at")).otherwise(0.0) * F.col("lam") + F.col("g") / F.col("gt") * (1 - F.col("lam")))
    return both.select("bucket", "label", (F.col("w") / F.sum("w").over(w)).alias("weight"))


@query("d16_mark_to_market", f"|b AS (SELECT symbol, ts, close FROM bars), a AS (SELECT b.symbol, b.ts, b.close, s.exposure FROM b ASOF JOIN steps s ON b.symbol = s.symbol AND b.ts >= s.ts) SELECT symbol, ts, exposure, lag(exposure) OVER (PARTITION BY symbol ORDER BY ts) * (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS pnl FROM a", "exposure pnl")
def d16(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", "close")
    held = j.asof(b, steps(spark, sf_dir), values=("exposure",), tie="seq").where("right_ts IS NOT NULL")
    w = Window.partitionBy("symbol").orderBy("ts")
    return held.select("symbol", "ts", "exposure", (F.lag("exposure").over(w) * (F.col("close") - F.lag("close").over(w))).alias("pnl"))


@query(
    "d18_candidate_grid",
    """|c AS (SELECT s.symbol, s.seq, i.name, z.size, ell * i.u * z.size - p_bad * z.size * z.size AS score FROM steps s, (VALUES ('spot', 1.0), ('perp', 1.2), ('option', 0.8)) i(name, u), (VALUES (0.0), (0.5), (1.0)) z(size)),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, seq ORDER BY round(score, 9) DESC, name, size) AS rn FROM c) SELECT symbol, seq, max(CASE WHEN rn = 1 THEN name END) AS best, max(CASE WHEN rn = 1 THEN size END) AS size, max(CASE WHEN rn = 1 THEN score END) - max(CASE WHEN rn = 2 THEN score END) AS margin FROM r GROUP BY 1, 2""",
    "size margin",
)
def d18(spark, sf_dir):
    options = [(n, u, s) for n, u in (("spot", 1.0), ("perp", 1.2), ("option", 0.8)) for s in (0.0, 0.5, 1.0)]
    score = lambda u, s: F.col("ell") * u * s - F.col("p_bad") * s * s
    grid = F.array_sort(F.array(*[F.struct((-F.round(score(u, s), 9)).alias("k"), F.lit(n).alias("name"), F.lit(s).alias("size"), score(u, s).alias("score")) for n, u, s in options]))
    df = steps(spark, sf_dir).select("symbol", "seq", grid.alias("g"))
    return df.select("symbol", "seq", F.col("g")[0]["name"].alias("best"), F.col("g")[0]["size"].alias("size"), (F.col("g")[0]["score"] - F.col("g")[1]["score"]).alias("margin"))


@query(
    "d19_cosine_recurrence",
    """|p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id)
    SELECT e.vec_id AS id, CAST(count(*) FILTER (s > 0.3) AS BIGINT) AS n_earlier FROM embeddings e LEFT JOIN p ON p.id = e.vec_id GROUP BY 1""",
)
def d19(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return j.recurrence(e, "embedding", 0.3, "vec_id").select("id", "n_earlier")


@query("h2_set_operations", "SELECT symbol, qty, true AS in_both FROM (SELECT symbol, qty FROM ticks WHERE seq % 2 = 0 INTERSECT SELECT symbol, qty FROM ticks WHERE seq % 3 = 0) UNION ALL SELECT symbol, qty, false FROM (SELECT DISTINCT symbol, qty FROM ticks WHERE seq % 2 = 0 EXCEPT SELECT symbol, qty FROM ticks WHERE seq % 3 = 0)")
def h2(spark, sf_dir):
    t = ticks(spark, sf_dir).select("symbol", "qty", "seq")
    a, b = t.where("seq % 2 = 0").drop("seq"), t.where("seq % 3 = 0").drop("seq")
    return a.intersect(b).withColumn("in_both", F.lit(True)).unionByName(a.distinct().subtract(b).withColumn("in_both", F.lit(False)))


@query("h1_union_frames", "SELECT symbol, ts, price, NULL AS close FROM ticks WHERE qty = 2 UNION ALL SELECT symbol, ts, NULL, close FROM bars", "price close")
def h1(spark, sf_dir):
    return ticks(spark, sf_dir).where("qty = 2").select("symbol", "ts", "price").unionByName(bars(spark, sf_dir).select("symbol", "ts", "close"), allowMissingColumns=True)


@query("h3_distinct_days", "SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM steps WHERE action <> 0")
def h3(spark, sf_dir):
    return steps(spark, sf_dir).where("action <> 0").select("symbol", F.to_date("ts").alias("day")).distinct()
