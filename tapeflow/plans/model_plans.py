"""Queries of fits and option surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators.features import quotient_features
from tapeflow.operators import models as m
from tapeflow.operators import options as o
from tapeflow.operators import windows as w
from tapeflow.operators.quantiles import median

from .fixtures import bars, steps, table
from .registry import query
from .scalar_plans import CDF
from .window_plans import quotients

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
_X = ["ell", "p_bad", "exposure"]


def _xy(spark, sf_dir):
    return m.standardised(steps(spark, sf_dir).where("ret IS NOT NULL"), _X).withColumn("y", F.col("acceptable").cast("double"))


@query(
    "m1_ridge_scores",
    """|z AS (SELECT symbol, seq, (ell - avg(ell) OVER ()) / stddev_pop(ell) OVER () AS a, (p_bad - avg(p_bad) OVER ()) / stddev_pop(p_bad) OVER () AS b, CAST(acceptable AS INT) AS y FROM steps),
    s AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(a) AS a1, sum(b * b) + 1 AS bb, sum(b) AS b1, count(*) + 1.0 AS n, sum(a * y) AS ay, sum(b * y) AS qy, sum(y) AS y1 FROM z),
    d AS (SELECT *, aa * (bb * n - b1 * b1) - ab * (ab * n - b1 * a1) + a1 * (ab * b1 - bb * a1) AS det FROM s),
    c AS (SELECT (ay * (bb * n - b1 * b1) - ab * (qy * n - b1 * y1) + a1 * (qy * b1 - bb * y1)) / det AS wa, (aa * (qy * n - y1 * b1) - ay * (ab * n - b1 * a1) + a1 * (ab * y1 - qy * a1)) / det AS wb, (aa * (bb * y1 - b1 * qy) - ab * (ab * y1 - a1 * qy) + ay * (ab * b1 - bb * a1)) / det AS w0 FROM d)
    SELECT symbol, seq, 1 / (1 + exp(-(wa * a + wb * b + w0))) AS ell_hat FROM z, c""",
    "ell_hat",
)
def m1(spark, sf_dir):
    df = m.standardised(steps(spark, sf_dir), ["ell", "p_bad"]).withColumn("y", F.col("acceptable").cast("double"))
    fit = m.ridge(df, ["ell", "p_bad"], "y")
    return df.select("symbol", "seq", (1 / (1 + F.exp(-m.linear(["ell", "p_bad"], fit)))).alias("ell_hat"))


@query(
    "m2_direction_features",
    """|f AS (SELECT symbol, seq, ell AS x0, lag(ell, 1) OVER w AS x1, lag(ell, 2) OVER w AS x2, CASE WHEN lead(price, 5) OVER w / nullif(price, 0) - 1 > 0.1 THEN 2 WHEN lead(price, 5) OVER w / nullif(price, 0) - 1 < -0.1 THEN 0 WHEN lead(price, 5) OVER w IS NOT NULL THEN 1 END AS label FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) SELECT * FROM f WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND label IS NOT NULL""",
    "x0 x1 x2",
)
def m2(spark, sf_dir):
    return m.direction_features(steps(spark, sf_dir), "ell", 3, 5, 0.1)


def _solved(r: int, k: int) -> str:
    """Queries from e{r}_0, which has k equations a00 .. b.., to c{r}, their solution c0 .., by elimination."""
    out = ""
    for p in range(k - 1):
        cells = [f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}" if i > p else f"a{i}{j}" for i in range(k) for j in range(k)]
        out += f", e{r}_{p + 1} AS (SELECT {', '.join(cells + [f'b{i} - a{i}{p} * b{p} / a{p}{p} AS b{i}' if i > p else f'b{i}' for i in range(k)])} FROM e{r}_{p})"
    back = [f"(b{i}{''.join(f' - a{i}{j} * c{j}' for j in range(i + 1, k))}) / a{i}{i} AS c{i}" for i in range(k - 1, -1, -1)]
    return out + f", c{r} AS (SELECT {', '.join(back)} FROM e{r}_{k - 1})"


def _softmax_rounds(n: int) -> str:
    """Three classes by n steps of Newton's, the middle one's weights held at 0; then the share of each label that is met."""
    w = [f"w{i}" for i in range(8)]  # four for class 0, four for class 2
    z = [" + ".join(f"w{4 * c + i} * x{i}" for i in range(4)) for c in (0, 1)]
    out = """|f AS (SELECT ell AS x0, lag(ell, 1) OVER w AS x1, lag(ell, 2) OVER w AS x2, 1.0::DOUBLE AS x3, CASE WHEN lead(price, 5) OVER w / nullif(price, 0) - 1 > 0.1 THEN 2 WHEN lead(price, 5) OVER w / nullif(price, 0) - 1 < -0.1 THEN 0 WHEN lead(price, 5) OVER w IS NOT NULL THEN 1 END AS label FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
    z AS MATERIALIZED (SELECT * FROM f WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND label IS NOT NULL), t0 AS (SELECT """ + ", ".join(f"0.0::DOUBLE AS {x}" for x in w) + ")"
    for r in range(n):
        cell = lambda a, b: f"p{a} * ({1 if a == b else 0} - p{b})"
        sums = [f"sum({cell(i // 4, j // 4)} * x{i % 4} * x{j % 4}) AS a{i}{j}" for i in range(8) for j in range(8)]
        sums += [f"sum((CASE WHEN label = {2 * (i // 4)} THEN 1 ELSE 0 END - p{i // 4}) * x{i % 4}) AS b{i}" for i in range(8)]
        out += f""", s{r} AS (SELECT *, exp({z[0]}) / (1 + exp({z[0]}) + exp({z[1]})) AS p0, exp({z[1]}) / (1 + exp({z[0]}) + exp({z[1]})) AS p1 FROM z, t{r}),
        e{r}_0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM s{r})""" + _solved(r, 8).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
        out += f", t{r + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} + c{i} AS w{i}' for i in range(8))} FROM t{r}, c{r})"
    best = f"CASE WHEN {z[0]} >= greatest(0, {z[1]}) THEN 0 WHEN {z[1]} > 0 THEN 2 ELSE 1 END"
    return out + f" SELECT label, avg(CAST({best} = label AS INT)) AS accuracy, count(*) AS n FROM z, t{n} GROUP BY 1"


@query("m2_direction_head", _softmax_rounds(7), "accuracy")
def m2_head(spark, sf_dir):
    df, xs = m2(spark, sf_dir), ["x0", "x1", "x2"]
    weights = m.newton_head(df, xs, "label", held=1, others=[0, 2])
    down, up = m.linear(xs, weights[0]), m.linear(xs, weights[2])
    best = F.when(down >= F.greatest(F.lit(0.0), up), 0).when(up > 0, 2).otherwise(1)
    return df.groupBy("label").agg(F.avg((best == F.col("label")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def _newton_rounds(n: int) -> str:
    """A logistic fit of the share of the second class by n steps of Newton's; its weights are halved between the classes."""
    out = "|z AS (SELECT p_bad AS x0, exposure AS x1, 1.0::DOUBLE AS x2, 1 - ell AS y FROM steps WHERE exposure IS NOT NULL), t0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"
    for r in range(n):
        sums = [f"sum(q * (1 - q) * x{i} * x{j}) AS a{i}{j}" for i in range(3) for j in range(3)] + [f"sum((y - q) * x{i}) AS b{i}" for i in range(3)]
        out += f", s{r} AS (SELECT z.*, 1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2))) AS q FROM z, t{r}), e{r}_0 AS (SELECT {', '.join(sums)} FROM s{r})" + _solved(r, 3)
        out += f", t{r + 1} AS MATERIALIZED (SELECT w0 + c0 AS w0, w1 + c1 AS w1, w2 + c2 AS w2 FROM t{r}, c{r})"
    return out + f" SELECT cls, feature, round(CASE feature WHEN 0 THEN w0 ELSE w1 END * CASE cls WHEN 0 THEN -0.5 ELSE 0.5 END, 4) AS weight FROM t{n}, (VALUES (0), (1)) c(cls), (VALUES (0), (1)) f(feature)"


@query("m3_soft_label_head", _newton_rounds(8), "weight")
def m3(spark, sf_dir):
    df = steps(spark, sf_dir).withColumns({"p0": F.col("ell"), "p1": 1 - F.col("ell"), "x0": F.col("p_bad"), "x1": F.col("exposure")})
    model = m.softmax_head(df, ["x0", "x1"], weights={"spot": "p0", "perp": "p1"}, rounds=200, tol=1e-13)
    # four digits, which the fit's last steps don't change
    return spark.createDataFrame([(i, j, round(float(v), 4) + 0.0) for i, row in enumerate(model.coefficientMatrix.toArray()) for j, v in enumerate(row)], "cls int, feature int, weight double")


def _huber_rounds(n: int) -> str:
    """Ridge by elimination, then n rounds with the rows of large errors weighed down; each round is a query of its own."""
    k = len(_X) + 1
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(_X))
    out = f"|z AS (SELECT symbol, seq, {z}, 1.0::DOUBLE AS x{k - 1}, ret AS y FROM steps WHERE ret IS NOT NULL)"
    error = f"abs(y - ({' + '.join(f'c{i} * x{i}' for i in range(k))}))"
    for r in range(n + 1):
        weight = "1.0" if r == 0 else f"CASE WHEN {error} <= 0.3 THEN 1.0 ELSE 0.3 / {error} END"
        sums = [f"sum(w * x{i} * x{j}){' + 1' if i == j else ''} AS a{i}{j}" for i in range(k) for j in range(k)] + [f"sum(w * x{i} * y) AS b{i}" for i in range(k)]
        out += f", w{r} AS (SELECT z.*, {weight} AS w FROM z{f', c{r - 1}' if r else ''}), e{r}_0 AS (SELECT {', '.join(sums)} FROM w{r})"
        out += _solved(r, k)
    return out + f", d AS (SELECT symbol, seq, {error} AS e FROM z, c{n}) SELECT symbol, seq, exp(-ln(2.0) * e / greatest((SELECT quantile_cont(e, 0.5) FROM d), 1e-9)) AS ell_hat FROM d"


@query("m4_huber_errors", _huber_rounds(5), "ell_hat")
def m4(spark, sf_dir):
    df = _xy(spark, sf_dir)
    fit = m.huber_ridge(df, _X, "ret", delta=0.3)
    scored = df.withColumn("e", F.abs(F.col("ret") - m.linear(_X, fit)))
    mid = median(scored, [], "e", "mid")
    return scored.crossJoin(F.broadcast(mid)).select("symbol", "seq", F.exp(-F.log(F.lit(2.0)) * F.col("e") / F.greatest("mid", F.lit(1e-9))).alias("ell_hat"))


@query(
    "m5_pair_rank_loss",
    """|h AS (SELECT seq, ell AS s, p_bad AS t, CAST('0x' || substr(md5(seq || '/0'), 1, 12) AS BIGINT) AS h FROM steps), p AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS s2, lead(t) OVER w AS t2 FROM h WINDOW w AS (PARTITION BY h % 4096 ORDER BY h, seq)),
    d AS (SELECT CASE WHEN t > t2 THEN s - s2 ELSE s2 - s END AS d FROM p WHERE k % 2 = 1 AND t2 IS NOT NULL AND t <> t2) SELECT count(*) AS pairs, avg(ln(1 + exp(-d))) AS loss, avg(-d / (1 + exp(d))) AS gradient FROM d""",
    "loss gradient",
)
def m5(spark, sf_dir):
    return m.pair_rank_loss(steps(spark, sf_dir), "ell", "p_bad", "seq")


def _median_rounds(n: int) -> str:
    out = "|m AS (SELECT l_returnflag AS ontology, CAST(floor(l_quantity / 15) AS INT) AS size, quantile_cont(l_discount, 0.5) AS m FROM lineitem GROUP BY 1, 2), w0 AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY ontology) AS w, count(*) OVER (PARTITION BY ontology) AS k FROM m)"
    for i in range(n):
        out += f""", u{i} AS (SELECT a.ontology, a.size, any_value(a.m) AS m, any_value(a.k) AS k, greatest(0.05, least(0.8, any_value(a.w) + 0.1 * sum(sign(a.m - b.m) / (1 + exp(sign(a.m - b.m) * (a.w - b.w)))) / any_value(a.k))) AS v FROM w{i} a JOIN w{i} b ON a.ontology = b.ontology GROUP BY 1, 2),
        w{i + 1} AS (SELECT ontology, size, m, k, v / sum(v) OVER (PARTITION BY ontology) AS w FROM u{i})"""
    return out


@query("m7_size_weights", _median_rounds(20) + " SELECT ontology, size, w AS weight FROM w20", "weight")
def m7(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ontology"), F.floor(F.col("l_quantity") / 15).cast("int").alias("size"), "l_discount")
    return m.weights_from_medians(li, "ontology", "size", "l_discount")


#: Options of the query of M6; shares are made from row numbers, some of them unknown.
_M6 = {"rounds": 3, "batch": 64, "rate": 0.5, "l2": 0.01, "entropy": 0.01}
_SHARES = {c: f"CASE WHEN seq % 89 = {i} THEN NULL ELSE CAST((seq * {29 + 6 * i}) % 101 AS DOUBLE) END" for i, c in enumerate(x for head in list(m.HEADS)[1:] for x in m.HEADS[head])}
_LABEL = "CASE seq % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'R' ELSE 'H' END"


def _rank_steps() -> str:
    """The fit of M6 as SQL: rows, pairs of all rounds, and the queries of each round."""
    share = lambda head: [f"ln(greatest(CASE WHEN {' + '.join(m.HEADS[head])} > 0 THEN {c} / ({' + '.join(m.HEADS[head])}) ELSE 1.0 / {len(m.HEADS[head])} END, 1e-6))" for c in m.HEADS[head]]
    z = [f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in m.HEADS["score"]]
    starts = ", ".join(f"('{g}', '{head}', {i}, {k}, {float(v)!r}::DOUBLE)" for g in "HRT" for k, (head, i, v) in enumerate(((h, j, v) for h, w in m.start_weights(g).items() for j, v in enumerate(w)), 1))
    out = quotients(4, 8) + f""", s AS (SELECT symbol, seq, ell, {_LABEL} AS label, {', '.join(f'{v} AS {c}' for c, v in _SHARES.items())},
        CASE WHEN price > 0 AND lead(price, 8) {_W} > 0 THEN greatest(-0.01, least(0.01, ln(lead(price, 8) {_W} / price))) END AS target FROM steps),
    sc AS (SELECT symbol, seq, {', '.join(z)} FROM q),
    x AS (SELECT label, seq AS key, target AS t, CAST([{', '.join(m.HEADS['score'] + [v for head in list(m.HEADS)[1:] for v in share(head)])}] AS DOUBLE[]) AS x FROM s JOIN sc USING (symbol, seq) WHERE target IS NOT NULL AND ell >= 0.3),
    h AS (SELECT x.*, round, CAST('0x' || substr(md5(key || '/7/' || round), 1, 12) AS BIGINT) AS h FROM x, range({_M6['rounds']}) r(round)),
    k AS (SELECT *, row_number() OVER w AS k, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM h WINDOW w AS (PARTITION BY round, label ORDER BY h, key)),
    dl AS (SELECT round, label, key, sign(t - t2) AS y, unnest(range(1, 24)) AS i, unnest(list_transform(range(1, 24), lambda j: x[j] - x2[j])) AS dx FROM k WHERE k % 2 = 1 AND k < {_M6['batch']} AND t <> t2),
    w0 AS (SELECT *, w AS first FROM (VALUES {starts}) v(label, vector, pos, i, w))"""
    for r in range(_M6["rounds"]):
        out += f""", m{r} AS (SELECT label, key, sum(dx * w) AS m FROM dl JOIN w{r} USING (label, i) WHERE round = {r} GROUP BY 1, 2),
        g{r} AS (SELECT label, i, avg(-y / (1 + exp(y * m)) * dx) / {_M6['batch']} AS g FROM dl JOIN m{r} USING (label, key) WHERE round = {r} GROUP BY 1, 2),
        e{r} AS (SELECT *, ln(greatest(w / s, 1e-6)) + 1 AS level FROM (SELECT *, sum(w) OVER (PARTITION BY label, vector) AS s FROM w{r})),
        u{r} AS (SELECT e.*, g + 2 * {_M6['l2']} * (w - first) + {_M6['entropy']} * (level / s - sum(w * level) OVER (PARTITION BY label, vector) / (s * s)) AS slope FROM e{r} e JOIN g{r} USING (label, i)),
        v{r} AS (SELECT *, greatest(0, least(1, w - {_M6['rate']} * slope / greatest(1, sqrt(sum(slope * slope) OVER (PARTITION BY label, vector))))) AS v FROM u{r}),
        w{r + 1} AS (SELECT label, vector, pos, i, v / sum(v) OVER (PARTITION BY label, vector) AS w, first FROM v{r})"""
    return out + f" SELECT label, vector, CAST(pos AS INT) AS pos, w AS weight FROM w{_M6['rounds']}"


@query("m6_weights_by_group", _rank_steps(), "weight")
def m6(spark, sf_dir):
    df = quotient_features(steps(spark, sf_dir).select("symbol", "ts", "seq", "ell", "price"), 4, 8)
    ahead = F.lead("price", 8).over(w.tape())
    df = df.withColumn("target", F.when((F.col("price") > 0) & (ahead > 0), F.greatest(F.lit(-0.01), F.least(F.lit(0.01), F.log(ahead / F.col("price"))))))
    df = df.withColumns({c: F.expr(v) for c, v in _SHARES.items()} | {"label": F.expr(_LABEL)})
    return m.label_weights(df, "label", "seq", "target", "ell", 0.3, tuple(m.HEADS), **_M6)


def _jacobi(sweeps: int) -> str:
    """Eigenvalues of the correlations of four columns, by rotations that clear one pair after the other."""
    columns = ["ell", "p_bad", "exposure", "price"]
    cell = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    out = "|r0 AS (SELECT " + ", ".join(f"coalesce(corr({columns[i]}, {columns[j]}), 0) AS a{i}{j}" if i != j else f"1.0::DOUBLE AS a{i}{i}" for i in range(4) for j in range(i, 4)) + " FROM steps)"
    k = 0
    for p, q in [(p, q) for _ in range(sweeps) for p in range(4) for q in range(p + 1, 4)]:
        turn = f"CASE WHEN {cell(p, q)} = 0 THEN 0.0 ELSE CASE WHEN {cell(q, q)} >= {cell(p, p)} THEN 1.0 ELSE -1.0 END * sign({cell(p, q)}) / (abs(({cell(q, q)} - {cell(p, p)}) / (2 * {cell(p, q)})) + sqrt(pow(({cell(q, q)} - {cell(p, p)}) / (2 * {cell(p, q)}), 2) + 1)) END"
        new = {cell(p, p): f"{cell(p, p)} - t * {cell(p, q)}", cell(q, q): f"{cell(q, q)} + t * {cell(p, q)}", cell(p, q): "0.0::DOUBLE"}
        for i in {0, 1, 2, 3} - {p, q}:
            new[cell(i, p)], new[cell(i, q)] = f"({cell(i, p)} - t * {cell(i, q)}) / sqrt(t * t + 1)", f"(t * {cell(i, p)} + {cell(i, q)}) / sqrt(t * t + 1)"
        out += f", q{k} AS (SELECT *, {turn} AS t FROM r{k}), r{k + 1} AS MATERIALIZED (SELECT {', '.join(f'{new[cell(i, j)]} AS {cell(i, j)}' if cell(i, j) in new else cell(i, j) for i in range(4) for j in range(i, 4))} FROM q{k})"
        k += 1
    return out + f" SELECT CAST(i - 1 AS INT) AS axis, list_reverse_sort([a00, a11, a22, a33])[i] / 4 AS explained FROM r{k}, (VALUES (1), (2)) v(i)"


@query("m8_principal_axes", _jacobi(6), "explained")
def m8(spark, sf_dir):
    axes, share = m.principal_axes(steps(spark, sf_dir), ["ell", "p_bad", "exposure", "price"])
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(share)], "axis int, explained double")


@query("d17_option_grid", "SELECT symbol, ts, t.tenor, m.mny, c.call FROM bars, (VALUES (7), (14), (30), (60), (90)) t(tenor), (VALUES (-0.2), (-0.1), (0.0), (0.1), (0.2)) m(mny), (VALUES (true), (false)) c(call)", "mny")
def d17(spark, sf_dir):
    return o.grid(bars(spark, sf_dir).select("symbol", "ts"))


def _surface(spark, sf_dir):
    b = quotient_features(bars(spark, sf_dir).withColumn("price", F.col("close")), 4, 8)
    return o.synthetic_surface(b)


_SURFACE = (
    quotients(4, 8, "bt", "close").replace("|p AS", f"|bt AS (SELECT *, row_number() {_W} - 1 AS t FROM bars), p AS")
    + """, sv AS (SELECT q.symbol, q.ts, b.close, greatest(0.05, least(3.0, 0.6 + 0.5 * greatest(vol_ratio, 0) + 0.1 * ln(1 + greatest(burstiness, 0)))) AS iv FROM q JOIN bt b ON b.symbol = q.symbol AND b.ts = q.ts),
    sg AS (SELECT sv.*, t.tenor, m.mny, c.call, close * exp(m.mny) AS strike FROM sv, (VALUES (7), (14), (30), (60), (90)) t(tenor), (VALUES (-0.2::DOUBLE), (-0.1), (0.0), (0.1), (0.2)) m(mny), (VALUES (true), (false)) c(call)),
    sd1 AS (SELECT *, iv * sqrt(tenor / 365.0) AS sd, (ln(close / strike) + iv * iv * (tenor / 365.0) / 2) / (iv * sqrt(tenor / 365.0)) AS d1 FROM sg), se AS (SELECT *, d1 - sd AS d2, -d1 AS m1, sd - d1 AS m2 FROM sd1),
    sf AS (SELECT symbol, ts, tenor, mny, call, iv, strike, CASE WHEN call THEN close * """
    + f"({CDF.format('d1')}) - strike * ({CDF.format('d2')}) ELSE strike * ({CDF.format('m2')}) - close * ({CDF.format('m1')}) END AS mid FROM se)"
)


@query("o1_synthetic_surface", _SURFACE + " SELECT * FROM sf", "mny iv strike mid")
def o1(spark, sf_dir):
    return _surface(spark, sf_dir).select("symbol", "ts", "tenor", "mny", "call", "iv", "strike", "mid")


@query("o2_surface_check", _SURFACE + " SELECT count(*) AS rows, CAST(count_if(epoch_ms(ts) NOT BETWEEN 1000000000000 AND 1000000000000000) AS BIGINT) AS bad_times, CAST(count_if(mid IS NULL OR mid < -1e-6) AS BIGINT) AS bad_prices, 50 - count(DISTINCT (tenor, mny, call)) AS missing_cells FROM sf")
def o2(spark, sf_dir):
    return o.surface_problems(_surface(spark, sf_dir))
