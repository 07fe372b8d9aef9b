"""Queries of scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeflow.functions import scalar as s
from tapeflow.operators.quantiles import median, quantiles

from .fixtures import steps, table
from .registry import query

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


def _w():
    return Window.partitionBy("symbol").orderBy("ts", "seq")



@query("c1_time_units", "|r AS (SELECT event_id, epoch(ts) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000000 END AS raw FROM events) SELECT event_id, CASE WHEN raw > 1e14 THEN raw / 1e9 WHEN raw > 1e11 THEN raw / 1e3 ELSE raw END AS s, CAST(CASE WHEN raw > 1e14 THEN floor(raw / 1e6) WHEN raw > 1e11 THEN floor(raw) WHEN raw > 1e9 THEN floor(raw * 1e3) END AS BIGINT) AS ms FROM r", "s")
def c1(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(1000000000)
    return e.select("event_id", s.seconds(raw).alias("s"), s.milliseconds(raw).alias("ms"))


@query("c2_tolerant_casts", "|r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'x1' WHEN 2 THEN 'Yes' ELSE '17' END AS raw, value FROM events) SELECT event_id, TRY_CAST(raw AS DOUBLE) AS f, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INT) AS i, lower(raw) IN ('1', 'true', 'yes', 'y', 'on', 't') AS b FROM r", "f")
def c2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "x1").when(k == 2, "Yes").otherwise("17")
    return e.select("event_id", s.finite(raw.try_cast("double")).alias("f"), s.safe_int(raw).alias("i"), s.safe_bool(raw).alias("b"))


@query("c3_first_present", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS v FROM events")
def c3(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.first_present(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"), F.col("event_type")).alias("v"))


@query(
    "c6_ternary_control",
    """|x AS (SELECT symbol, seq, CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS sign, CASE WHEN p_bad >= 0.7 THEN -1 WHEN p_bad >= 0.4 THEN 0 ELSE 1 END AS permission, state, ban FROM steps)
    SELECT symbol, seq, sign, permission, CASE WHEN permission <> 1 OR state = 0 OR sign = 0 OR state <> sign THEN 0 ELSE state END AS control, CASE WHEN state + sign >= 1 THEN 1 WHEN state + sign <= -1 THEN -1 ELSE 0 END AS clipped FROM x""",
)
def c6(spark, sf_dir):
    df = steps(spark, sf_dir).select("symbol", "seq", "state", s.ternary_sign(F.col("ret"), 0.1).alias("sign"), s.permission(F.col("p_bad")).alias("permission"), (-F.col("ban")).alias("pressure"))
    return df.select("symbol", "seq", "sign", "permission", s.controller(F.col("state"), F.col("sign"), F.col("permission"), F.col("pressure")).alias("control"), s.clip_ternary(F.col("state") + F.col("sign")).alias("clipped"))


@query(
    "c7_abc_posture",
    """|x AS (SELECT symbol, seq, CAST(seq % 4 - 2 AS INT) AS a, CAST((seq // 4) % 3 - 1 AS INT) AS b, CAST((seq // 12) % 3 - 1 AS INT) AS c FROM steps) SELECT symbol, seq, CASE WHEN c = -1 THEN CASE WHEN a = 1 AND b = 1 THEN 2 ELSE -1 END WHEN a <= 0 THEN 0 WHEN b = 1 THEN 2 WHEN b = 0 THEN 1 ELSE 0 END AS posture FROM x""",
)
def c7(spark, sf_dir):
    a, b, c = F.col("seq") % 4 - 2, F.floor(F.col("seq") / 4) % 3 - 1, F.floor(F.col("seq") / 12) % 3 - 1
    return steps(spark, sf_dir).select("symbol", "seq", s.abc_posture(a, b, c).alias("posture"))


@query("c8_score_planes", "SELECT symbol, seq, CASE WHEN ret IS NULL THEN '⊥' WHEN ret >= 0.1 THEN '+1' WHEN ret <= -0.1 THEN '-1' ELSE '0' END AS sym, CASE WHEN ret IS NULL OR ret >= 0.1 THEN 1 ELSE 0 END AS p, CASE WHEN ret IS NULL OR ret <= -0.1 THEN 1 ELSE 0 END AS n FROM steps")
def c8(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("x", s.score_to_planes(F.col("ret")))
    return df.select("symbol", "seq", s.planes_symbol(F.col("x")).alias("sym"), "x.p", "x.n")


@query("c9_gf3_sums", f"|x AS (SELECT symbol, ts, seq, CASE WHEN ret IS NULL THEN NULL WHEN ret >= 0.1 THEN 1 WHEN ret <= -0.1 THEN -1 ELSE 0 END AS a, state AS b FROM steps) SELECT symbol, seq, CAST((a + b + 4) % 3 - 1 AS INT) AS total, CAST((a + 5) % 3 - 1 AS INT) AS rotated FROM x")
def c9(spark, sf_dir):
    df = steps(spark, sf_dir).select("symbol", "seq", s.score_to_planes(F.col("ret")).alias("a"), s.planes_of(F.col("state")).alias("b"))
    return df.select("symbol", "seq", s.trit(s.gf3_add(F.col("a"), F.col("b"))).alias("total"), s.trit(s.gf3_rotate(F.col("a"))).alias("rotated"))


@query("c10_trit_packing", "SELECT symbol, t // 3 AS pack, CAST(sum((state + 1) * CASE t % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END) AS BIGINT) AS code, count(*) AS n FROM steps GROUP BY 1, 2")
def c10(spark, sf_dir):
    weight = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(9)), (F.col("t") % 3 + 1).cast("int"))
    return steps(spark, sf_dir).groupBy("symbol", F.floor(F.col("t") / 3).alias("pack")).agg(F.sum((F.col("state") + 1) * weight).alias("code"), F.count("*").alias("n"))


@query("c10_trit_unpacking", "SELECT symbol, t, state FROM steps")
def c10_back(spark, sf_dir):
    packs = c10(spark, sf_dir)
    at = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    return packs.select("symbol", "pack", "code", at.alias("i")).select("symbol", (F.col("pack") * 3 + F.col("i")).alias("t"), (F.floor(F.col("code") / F.pow(F.lit(3), F.col("i"))) % 3 - 1).cast("int").alias("state"))


_ERF_T = "(1 / (1 + 0.3275911 * (abs({0}) / 1.4142135623730951)))"
_TAIL = f"((((1.061405429 * {_ERF_T} - 1.453152027) * {_ERF_T} + 1.421413741) * {_ERF_T} - 0.284496736) * {_ERF_T} + 0.254829592) * {_ERF_T} * exp(-(abs({{0}}) / 1.4142135623730951) * (abs({{0}}) / 1.4142135623730951))"
#: The normal distribution function of an expression.
CDF = f"CASE WHEN {{0}} >= 0 THEN 1 - ({_TAIL}) / 2 ELSE ({_TAIL}) / 2 END"
_PDF = "exp(-{0} * {0} / 2) / sqrt(2 * pi())"


def _inverse() -> str:
    """Newton's steps, one query each."""
    inner = "SELECT symbol, seq, ret, ell, ln(ell / (1 - ell)) / 1.702 AS x FROM steps WHERE ell > 0 AND ell < 1"
    for _ in range(6):
        inner = f"SELECT symbol, seq, ret, ell, greatest(-8.0, least(8.0, x - (({CDF.format('x')}) - ell) / greatest({_PDF.format('x')}, 1e-12))) AS x FROM ({inner})"
    return inner


@query("c11_normal_tail", f"|i AS ({_inverse()}) SELECT s.symbol, s.seq, CASE WHEN s.ret IS NOT NULL THEN {CDF.format('s.ret')} END AS cdf, {_PDF.format('s.ret')} AS pdf, i.x AS ppf FROM steps s LEFT JOIN i ON i.symbol = s.symbol AND i.seq = s.seq", "cdf pdf ppf")
def c11(spark, sf_dir):
    return steps(spark, sf_dir).select("symbol", "seq", s.norm_cdf(F.col("ret")).alias("cdf"), s.norm_pdf(F.col("ret")).alias("pdf"), s.norm_ppf(F.col("ell")).alias("ppf"))


@query(
    "c12_softmax_z",
    """|z AS (SELECT symbol, seq, ell, p_bad, coalesce(actionability, 0) AS c, (ell - avg(ell) OVER ()) / stddev_pop(ell) OVER () AS z FROM steps)
    SELECT symbol, seq, exp(ell) / (exp(ell) + exp(p_bad) + exp(c)) AS soft, 1 / (1 + exp(-z)) AS sig, z FROM z""",
    "soft sig z",
)
def c12(spark, sf_dir):
    from tapeflow.operators.joins import z_scored

    df = steps(spark, sf_dir).withColumn("z", F.col("ell"))
    df = z_scored(df, ["z"])
    return df.select("symbol", "seq", s.softmax([F.col("ell"), F.col("p_bad"), F.coalesce("actionability", F.lit(0.0))])[0].alias("soft"), s.sigmoid(F.col("z")).alias("sig"), "z")


@query(
    "c13_option_bins",
    "SELECT symbol, seq, CAST(CASE WHEN ell * 90 <= 10.5 THEN 0 WHEN ell * 90 <= 22 THEN 1 WHEN ell * 90 <= 45 THEN 2 ELSE 3 END AS INT) AS tenor, CAST(CASE WHEN p_bad < 0.2 THEN 0 WHEN p_bad < 0.5 THEN 1 WHEN p_bad < 0.8 THEN 2 ELSE 3 END AS INT) AS mny, CAST(greatest(0, least(9, floor(ell * 10 + 1e-12))) AS INT) AS ell_bin FROM steps",
)
def c13(spark, sf_dir):
    return steps(spark, sf_dir).select("symbol", "seq", s.nearest_target(F.col("ell") * 90, [7, 14, 30, 60]).alias("tenor"), s.first_cutoff(F.col("p_bad"), [0.2, 0.5, 0.8]).alias("mny"), s.ell_bin(F.col("ell"), 10).alias("ell_bin"))


@query("c14_coarse_state", "SELECT symbol, seq, CASE WHEN ret IS NOT NULL THEN greatest(-1, least(1, ret * 2)) END AS drift, greatest(0, least(1, 1 - p_bad)) AS contraction, greatest(0, least(1, abs(fill))) AS diffusion, greatest(-1, least(1, exposure * ell)) AS bias FROM steps", "drift contraction diffusion bias")
def c14(spark, sf_dir):
    return steps(spark, sf_dir).select("symbol", "seq", s.clip(F.col("ret") * 2, -1.0, 1.0).alias("drift"), s.clip(1 - F.col("p_bad"), 0.0, 1.0).alias("contraction"), s.clip(F.abs("fill"), 0.0, 1.0).alias("diffusion"), s.clip(F.col("exposure") * F.col("ell"), -1.0, 1.0).alias("bias"))


@query("c15_transition_score", "SELECT symbol, seq, ell / (p_bad + 1e-9) AS ratio, tanh(ell - p_bad) AS scaled_diff, 1 / (1 + exp(-(ell - p_bad))) AS logistic FROM steps WHERE p_bad > 0", "ratio scaled_diff logistic")
def c15(spark, sf_dir):
    return steps(spark, sf_dir).where("p_bad > 0").select("symbol", "seq", *[s.transition_score(F.col("ell"), F.col("p_bad"), m).alias(m) for m in ("ratio", "scaled_diff", "logistic")])


@query("c16_encodings", "SELECT symbol, seq, CASE symbol WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS code FROM steps")
def c16(spark, sf_dir):
    codes = F.create_map(*[F.lit(x) for kv in (("view", 0), ("click", 1), ("purchase", 2)) for x in kv])
    return steps(spark, sf_dir).select("symbol", "seq", F.try_element_at(codes, F.col("symbol")).alias("code"))


@query("c17_simplex", "SELECT symbol, seq, (p_bad + coalesce(actionability, 0) / 2) / (ell + p_bad + coalesce(actionability, 0)) AS x, coalesce(actionability, 0) * 0.8660254037844386 / (ell + p_bad + coalesce(actionability, 0)) AS y FROM steps WHERE ell + p_bad + coalesce(actionability, 0) > 0", "x y")
def c17(spark, sf_dir):
    x, y = s.simplex(F.col("ell"), F.col("p_bad"), F.coalesce("actionability", F.lit(0.0)))
    return steps(spark, sf_dir).select("symbol", "seq", x.alias("x"), y.alias("y")).where("x IS NOT NULL")


@query("c18_keyword_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'idiot')")
def c18(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(s.any_keyword(F.col("text"), ["License", "idiot"])).select("doc_id")


@query("c19_time_slice", "SELECT event_id FROM events, (SELECT min(ts) AS a FROM events) WHERE ts BETWEEN a + INTERVAL 1 DAY AND a + INTERVAL 3 DAY")
def c19(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts").alias("a"))
    return e.crossJoin(F.broadcast(first)).where(F.col("ts").between(F.col("a") + F.expr("INTERVAL 1 DAY"), F.col("a") + F.expr("INTERVAL 3 DAYS"))).select("event_id")


@query("c20_posture_inference", f"SELECT symbol, seq, CASE WHEN ban > 0 THEN -1 WHEN hold > 0 THEN 0 ELSE 1 END AS posture, coalesce(pnl - lag(pnl) {_W}, price - lag(price) {_W}, 0) AS delta_pnl FROM steps", "delta_pnl")
def c20(spark, sf_dir):
    from tapeflow.operators.logs import posture

    d = lambda c: F.col(c) - F.lag(c).over(_w())
    return steps(spark, sf_dir).select("symbol", "seq", posture().alias("posture"), F.coalesce(d("pnl"), d("price"), F.lit(0.0)).alias("delta_pnl"))


@query("c27_ontology_support", "|u AS (SELECT symbol, seq, ell AS a, p_bad AS b, coalesce(actionability, 0) AS c FROM steps), p AS (SELECT *, exp(2 * a) AS ea, exp(2 * b) AS eb, exp(2 * c) AS ec FROM u) SELECT symbol, seq, ea / (ea + eb + ec) AS p_trend, CASE WHEN a >= b AND a >= c THEN 'T' WHEN b >= c THEN 'R' ELSE 'H' END AS k FROM p", "p_trend")
def c27(spark, sf_dir):
    xs = [F.col("ell"), F.col("p_bad"), F.coalesce("actionability", F.lit(0.0))]
    p = F.array(*s.softmax(xs, 0.5))
    raw = F.array(*xs)
    return steps(spark, sf_dir).select("symbol", "seq", p[0].alias("p_trend"), F.element_at(F.array(F.lit("T"), F.lit("R"), F.lit("H")), F.array_position(raw, F.array_max(raw)).cast("int")).alias("k"))


@query(
    "c28_ontology_legitimacy",
    f"""|d AS (SELECT symbol, ts, seq, ell, abs(ell - lag(ell) {_W}) AS a, greatest(p_bad - lag(p_bad) {_W}, 0) AS b FROM steps), m AS (SELECT symbol, greatest(quantile_cont(a, 0.5), 1e-6) AS sa FROM d GROUP BY 1)
    SELECT symbol, seq, CASE WHEN a IS NULL THEN 1 ELSE exp(-a / sa) END AS close_part, ell * (0.7 + 0.3 * CASE WHEN a IS NULL THEN 1 ELSE exp(-a / sa) * exp(-b / sa) END) AS ell_eff FROM d JOIN m USING (symbol)""",
    "close_part ell_eff",
)
def c28(spark, sf_dir):
    up = F.col("p_bad") - F.lag("p_bad").over(_w())
    d = steps(spark, sf_dir).select("symbol", "seq", "ell", F.abs(F.col("ell") - F.lag("ell").over(_w())).alias("a"), F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))).alias("b"))
    m = median(d, ["symbol"], "a", "sa").withColumn("sa", F.greatest("sa", F.lit(1e-6)))
    part = lambda x: F.coalesce(F.exp(-F.col(x) / F.col("sa")), F.lit(1.0))
    return d.join(m, "symbol").select("symbol", "seq", part("a").alias("close_part"), (F.col("ell") * (0.7 + 0.3 * part("a") * part("b"))).alias("ell_eff"))


@query("c30_weight_normalise", "|w AS (SELECT symbol, seq, [greatest(0.05, least(0.8, x)) for x in [ell, p_bad, 0.5]] AS w FROM steps) SELECT symbol, seq, w[1] / list_sum(w) AS w1, w[2] / list_sum(w) AS w2, w[3] / list_sum(w) AS w3 FROM w", "w1 w2 w3")
def c30(spark, sf_dir):
    df = steps(spark, sf_dir).select("symbol", "seq", s.normalised(F.array("ell", "p_bad", F.lit(0.5))).alias("w"))
    return df.select("symbol", "seq", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(3)])


@query("c32_dead_zone", f"|v AS (SELECT symbol, seq, ret, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM steps) SELECT symbol, seq, CASE WHEN abs(ret) > 0.5 * sd THEN CAST(sign(ret) AS INT) ELSE 0 END AS trit FROM v")
def c32(spark, sf_dir):
    df = steps(spark, sf_dir)
    sd = df.groupBy("symbol").agg(F.stddev_samp("ret").alias("sd"))
    return df.join(sd, "symbol").select("symbol", "seq", F.when(F.abs("ret") > 0.5 * F.col("sd"), F.signum("ret").cast("int")).otherwise(0).alias("trit"))


@query("c33_c36_edges", "SELECT symbol, seq, CASE WHEN state * ell <= 0.2 THEN 0 ELSE state END AS gated, coalesce(actionability * action, ell, 0) AS edge, CASE WHEN p_bad >= 0.7 THEN 0 WHEN p_bad >= 0.4 THEN 0.5 ELSE 1 END AS permitted FROM steps", "edge permitted")
def c33(spark, sf_dir):
    gate = s.boundary_gate(F.col("state"), F.col("ell"), F.lit(0.2))
    allowed = s.permission(F.col("p_bad"))
    return steps(spark, sf_dir).select("symbol", "seq", gate.alias("gated"), s.predicted_edge(F.col("actionability"), F.col("action"), F.col("ell"), F.lit(0.0)).alias("edge"), F.when(allowed == -1, 0.0).when(allowed == 0, 0.5).otherwise(1.0).alias("permitted"))


@query("c35_regret_reward", f"SELECT symbol, seq, (coalesce(lag(action) {_W}, 0) - 1) * (ln(nullif(price, 0)) - ln(nullif(lag(price) {_W}, 0))) - 0.001 * abs(action - coalesce(lag(action) {_W}, 0)) AS reward FROM steps", "reward")
def c35(spark, sf_dir):
    before = F.coalesce(F.lag("action").over(_w()), F.lit(0))
    step = F.log("price") - F.log(F.lag("price").over(_w()))
    return steps(spark, sf_dir).select("symbol", "seq", ((before - 1) * step - 0.001 * F.abs(F.col("action") - before)).alias("reward"))


@query(
    "c31_feature_trits",
    f"""|r AS (SELECT symbol, ts, seq, t, price / nullif(lag(price) {_W}, 0) - 1 AS r FROM steps), z AS (SELECT *, avg(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM r),
    q AS (SELECT symbol, quantile_cont(sd, 0.75) AS q FROM z WHERE t >= 20 GROUP BY 1)
    SELECT symbol, seq, CAST(sign(r) AS INT) AS ret_trit, CASE WHEN (r - m) / sd > 0.5 THEN 1 WHEN (r - m) / sd < -0.5 THEN -1 ELSE 0 END AS z_trit, CASE WHEN sd > q THEN 1 ELSE 0 END AS stress_trit FROM z JOIN q USING (symbol) WHERE t >= 20""",
)
def c31(spark, sf_dir):
    from tapeflow.operators.windows import returns, trailing

    f = trailing(20)
    z = steps(spark, sf_dir).withColumn("r", returns()).withColumns({"m": F.avg("r").over(f), "sd": F.stddev_samp("r").over(f)}).where("t >= 20")
    q = quantiles(z, ["symbol"], "sd", {"q": 0.75})
    return z.join(q, "symbol").select("symbol", "seq", F.signum("r").cast("int").alias("ret_trit"), s.ternary_sign((F.col("r") - F.col("m")) / F.col("sd"), 0.5).alias("z_trit"), F.when(F.col("sd") > F.col("q"), 1).otherwise(0).alias("stress_trit"))


_PERM = "CASE WHEN p_bad >= 0.7 THEN -1 WHEN p_bad >= 0.4 THEN 0 ELSE 1 END"
_EDGE = "CASE WHEN seq % 3 = 0 THEN -state ELSE state END"


@query(
    "c34_decision_kind",
    f"""|d AS (SELECT *, {_PERM} AS perm, {_EDGE} AS edge FROM steps) SELECT symbol, seq, CASE perm WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - p_bad)) END AS act,
    CASE WHEN bad_flag OR perm = -1 THEN 'flat' WHEN seq % 17 = 0 THEN 'flat' WHEN perm = 0 THEN 'unknown' WHEN state = 0 OR edge = 0 OR state <> edge THEN 'unknown' WHEN action > 0 THEN 'long' WHEN action < 0 THEN 'short' ELSE 'unknown' END AS kind FROM d""",
    "act",
)
def c34(spark, sf_dir):
    df = steps(spark, sf_dir)
    perm = s.permission(F.col("p_bad"))
    kind = s.decision_kind(perm, F.col("state"), F.expr(_EDGE), F.col("action"), F.col("bad_flag"), F.col("seq") % 17 == 0)
    return df.select("symbol", "seq", s.actionability(perm, F.col("p_bad")).alias("act"), kind.alias("kind"))


@query("c23_phase_class", "SELECT symbol, seq, CASE WHEN ret <= 0 THEN 'false' WHEN NOT acceptable THEN 'boundary-unstable' ELSE 'boundary-stable' END AS phase FROM steps WHERE ret IS NOT NULL")
def c23(spark, sf_dir):
    return steps(spark, sf_dir).where("ret IS NOT NULL").select("symbol", "seq", s.phase_class(F.col("ret"), F.col("acceptable")).alias("phase"))


_TRAITS = ("ell", "p_bad", "exposure")


@query(
    "c25_instrument_utilities",
    """|z AS (SELECT symbol, seq, state, (ell - avg(ell) OVER ()) / stddev_pop(ell) OVER () AS a, (p_bad - avg(p_bad) OVER ()) / stddev_pop(p_bad) OVER () AS b, (exposure - avg(exposure) OVER ()) / stddev_pop(exposure) OVER () AS c FROM steps),
    u AS (SELECT *, 0.5 * a + 0.4 * b + 0.3 * c + 0.2 * a AS s_option, 0.6 * a - 0.4 * c * state - 0.2 * a - 0.3 * b + 0.2 * a AS s_perp, 0.1 - 0.2 * c - 0.2 * b AS s_spot FROM z),
    e AS (SELECT *, exp((s_option - greatest(s_option, s_perp, s_spot)) / 0.7) AS eo, exp((s_perp - greatest(s_option, s_perp, s_spot)) / 0.7) AS ep, exp((s_spot - greatest(s_option, s_perp, s_spot)) / 0.7) AS es FROM u)
    SELECT symbol, seq, s_spot, s_perp, s_option, es / (es + ep + eo) AS p_spot, ep / (es + ep + eo) AS p_perp, eo / (es + ep + eo) AS p_option FROM e""",
    "s_spot s_perp s_option p_spot p_perp p_option",
)
def c25(spark, sf_dir):
    from tapeflow.operators.joins import z_scored

    z = z_scored(steps(spark, sf_dir), list(_TRAITS))
    a, b, c = (F.col(x) for x in _TRAITS)
    found = s.utilities({"iv": a, "hazard": b, "funding_abs": c, "margin": a, "confidence": a, "carry": -c * F.col("state")})
    names = ("spot", "perp", "option")
    probabilities = s.softmax([found[n] for n in names], 0.7)
    return z.select("symbol", "seq", *[found[n].alias(f"s_{n}") for n in names], *[p.alias(f"p_{n}") for n, p in zip(names, probabilities)])


@query(
    "c24_option_value",
    f"""|x AS (SELECT symbol, seq, price, price * (0.8 + ell / 2) AS strike, 0.2 + p_bad AS sigma, (7 + seq % 90) / 365.0 AS tau, seq % 2 = 0 AS call FROM steps WHERE price > 0),
    d AS (SELECT *, (ln(price / strike) + sigma * sigma * tau / 2) / (sigma * sqrt(tau)) AS d1, (ln(price / strike) - sigma * sigma * tau / 2) / (sigma * sqrt(tau)) AS d2 FROM x), n AS (SELECT *, -d1 AS m1, -d2 AS m2 FROM d)
    SELECT symbol, seq, CASE WHEN call THEN price * ({CDF.format("d1")}) - strike * ({CDF.format("d2")}) ELSE strike * ({CDF.format("m2")}) - price * ({CDF.format("m1")}) END AS value FROM n""",
    "value",
)
def c24(spark, sf_dir):
    df = steps(spark, sf_dir).where("price > 0")
    value = s.black_scholes(F.col("price"), F.col("price") * (0.8 + F.col("ell") / 2), 0.2 + F.col("p_bad"), (7 + F.col("seq") % 90) / 365.0, F.col("seq") % 2 == 0)
    return df.select("symbol", "seq", value.alias("value"))


_PARTS = "CASE WHEN seq % 2 = 0 THEN actionability END AS margin, CASE WHEN seq % 3 = 0 THEN ell END AS own, CASE WHEN seq % 5 = 0 THEN p_bad END AS best"


@query("c36_predicted_edge", f"SELECT symbol, seq, CASE WHEN margin IS NOT NULL THEN margin * action WHEN own IS NOT NULL THEN own WHEN best IS NOT NULL THEN best ELSE 0 END AS edge FROM (SELECT *, {_PARTS} FROM steps)", "edge")
def c36(spark, sf_dir):
    df = steps(spark, sf_dir).selectExpr("*", *_PARTS.split(", "))
    return df.select("symbol", "seq", s.predicted_edge(F.col("margin"), F.col("action"), F.col("own"), F.col("best")).alias("edge"))


_THREE = "(VALUES ('act', ell), ('hold', p_bad), ('ban', coalesce(actionability, 0))) v(label, score)"


@query(
    "g4_best_label",
    f"|r AS (SELECT symbol, seq, label, score, row_number() OVER (PARTITION BY symbol, seq ORDER BY score DESC, label) AS k FROM steps, LATERAL (SELECT * FROM {_THREE})) SELECT symbol, seq, max(label) FILTER (k = 1) AS label, max(score) FILTER (k = 1) - max(score) FILTER (k = 2) AS margin FROM r GROUP BY 1, 2",
    "margin",
)
def g4(spark, sf_dir):
    return steps(spark, sf_dir).select("symbol", "seq", s.best_label({"act": F.col("ell"), "hold": F.col("p_bad"), "ban": F.coalesce("actionability", F.lit(0.0))}).alias("b")).select("symbol", "seq", "b.label", "b.margin")
