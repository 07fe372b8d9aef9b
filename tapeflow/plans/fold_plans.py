"""Queries of keyed folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeflow.operators import folds as k
from tapeflow.operators import logs
from tapeflow.operators import windows as w

from .fixtures import bars, pieced_steps, steps, ticks
from .registry import query


_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


def _recursive(first: str, then: str, columns: str, source: str = "steps") -> str:
    """A fold as a recursive query: `first` of row 0, `then` from the row before (f) and the row (s)."""
    return f"|f AS (SELECT symbol, t, seq, {first} FROM {source} s WHERE t = 0 UNION ALL SELECT s.symbol, s.t, s.seq, {then} FROM f JOIN {source} s ON s.symbol = f.symbol AND s.t = f.t + 1) SELECT symbol, seq, {columns} FROM f"


def _folded(start: str, lets: list[str], then: str, columns: str, source: str = "steps", keys: str = "symbol", first: str = "") -> str:
    """A fold as a recursive query from a virtual row before each tape's first.

    start: the state's columns and their values there; lets: columns of each row in turn, from the row's own columns and the
    state before it (named b_..); then: the state after the row; first: queries that come before it.
    """
    names = [x.rsplit(" AS ", 1)[1].strip() for x in start.split(";")]
    inner = f"SELECT s.*, {', '.join(f'f.{n} AS b_{n}' for n in names)} FROM f JOIN {source} s ON s.t = f.t + 1 AND {' AND '.join(f's.{k.strip()} = f.{k.strip()}' for k in keys.split(','))}"
    for let in lets:
        inner = f"SELECT *, {let} FROM ({inner})"
    return (
        f"|{first}{',' if first else ''} f AS (SELECT {keys}, CAST(-1 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS seq, {start.replace(';', ',')} FROM (SELECT DISTINCT {keys} FROM {source})"
        f" UNION ALL SELECT {keys}, t, seq, {then} FROM ({inner})), o AS (SELECT * FROM f WHERE t >= 0) SELECT {keys}, seq, {columns} FROM o"
    )


@query(
    "k1_hysteresis",
    _recursive(
        "CASE WHEN ell >= 0.6 THEN 1 ELSE 0 END AS a, CASE WHEN ell < 0.3 THEN 1 ELSE 0 END AS b, ell >= 0.6 AND 1 >= 2 AS e",
        "CASE WHEN s.ell >= 0.6 THEN f.a + 1 ELSE 0 END, CASE WHEN s.ell < 0.3 THEN f.b + 1 ELSE 0 END, ((CASE WHEN s.ell >= 0.6 THEN f.a + 1 ELSE 0 END) >= 2 OR f.e) AND NOT (s.ell < 0.3 AND f.b + 1 >= 2)",
        "e AS engaged",
    ),
)
def k1(spark, sf_dir):
    return k.hysteresis(steps(spark, sf_dir), "ell", F.lit(0.6), F.lit(0.3), 2, 2).select("symbol", "seq", "engaged")


_ACT = "CASE WHEN s.state = 0 OR s.ell <= 0 OR s.ell < 0.4 THEN 0 WHEN s.ell >= 0.7 THEN 1 ELSE 1 - f.act END"


@query("k2_toggling_gate", _recursive("CASE WHEN state = 0 OR ell < 0.7 THEN 0 ELSE 1 END AS act, CASE WHEN state = 0 OR ell < 0.7 THEN 0 ELSE state END AS direction", f"{_ACT}, CASE WHEN {_ACT} = 1 THEN s.state ELSE 0 END", "direction"))
def k2(spark, sf_dir):
    return k.toggling_gate(steps(spark, sf_dir), F.lit(0.7), F.lit(0.4)).select("symbol", "seq", "direction")


_GRID = "g AS (SELECT s.*, tau_on, tau_off FROM steps s, (SELECT unnest([0.5, 0.6, 0.7])::DOUBLE AS tau_on), (SELECT unnest([0.3, 0.4, 0.5])::DOUBLE AS tau_off) WHERE tau_on >= tau_off)"


@query(
    "k3_tau_sweep",
    "|" + _folded(
        "true AS act; 0 AS direction", ["CASE WHEN state = 0 OR ell <= 0 OR ell < tau_off THEN false WHEN ell >= tau_on THEN true ELSE NOT b_act END AS now"],
        "now, CASE WHEN now THEN state ELSE 0 END", "direction, tau_on, tau_off", "g", "symbol, tau_on, tau_off", _GRID,
    ).lstrip("|").replace("SELECT symbol, tau_on, tau_off, seq, direction, tau_on, tau_off FROM o", "SELECT tau_on, tau_off, avg(CAST(direction <> 0 AS INT)) AS act_pct, avg(CAST(direction = 0 AS INT)) AS hold_pct, count(*) AS n FROM o GROUP BY 1, 2"),
    "act_pct hold_pct",
)
def k3(spark, sf_dir):
    gated = k.toggling_gates(pieced_steps(spark, sf_dir), [0.5, 0.6, 0.7], [0.3, 0.4, 0.5])
    return gated.groupBy("tau_on", "tau_off").agg(logs.share(F.col("direction") != 0).alias("act_pct"), logs.share(F.col("direction") == 0).alias("hold_pct"), F.count("*").alias("n"))


_ENGAGED_COLUMNS = [
    "CASE WHEN seq % 97 = 1 THEN -3 WHEN seq % 13 = 0 THEN -2 ELSE state END AS tri",
    "CASE WHEN seq % 41 = 0 THEN 'UNWIND' WHEN seq % 37 = 0 THEN 'OBSERVE' WHEN seq % 5 = 0 THEN 'TRADE_CONVEX' ELSE 'TRADE_NORMAL' END AS posture",
    "seq % 211 = 0 AS broken", "seq % 26 = 0 AS risky", "seq % 39 = 0 AS neutral",
]
_ENGAGED = f"e AS (SELECT *, {', '.join(_ENGAGED_COLUMNS)} FROM steps)"


@query(
    "k4_intents",
    _folded(
        "0 AS prev; 0 AS age; false AS holding; 0 AS pos; 0 AS direction; 0.0::DOUBLE AS target; 0.0::DOUBLE AS urgency; false AS holds; 0.0::DOUBLE AS actionability; '' AS reason",
        [
            "CASE WHEN posture = 'UNWIND' THEN 'unwind' WHEN posture = 'OBSERVE' THEN 'observe' WHEN broken OR tri = -3 THEN 'collapse' END AS ov",
            "CASE WHEN ov IS NOT NULL THEN b_age WHEN tri NOT IN (0, -2) AND tri = b_prev THEN b_age + 1 ELSE 0 END AS age1",
            """CASE WHEN ov IS NOT NULL THEN ov WHEN tri = 0 THEN 'flat' WHEN tri = -2 AND risky THEN 'risk_stop' WHEN tri = -2 AND neutral THEN 'neutral_exit' WHEN tri = -2 THEN 'unknown'
            WHEN b_holding AND ell < 0.6 THEN 'suspended' WHEN NOT b_holding AND ell < 0.3 THEN 'prohibited' WHEN posture = 'TRADE_CONVEX' THEN 'active_convex' ELSE 'active' END AS why""",
            "why IN ('observe', 'unknown', 'suspended') AS keeps, CASE WHEN why = 'active' THEN least(1.0, (1 - exp(-age1 / 20.0)) * ell) WHEN why = 'active_convex' THEN least(1.0, 2 * (1 - exp(-age1 / 20.0)) * ell) ELSE 0 END AS size",
            "CASE WHEN keeps THEN b_pos WHEN why LIKE 'active%' THEN tri ELSE 0 END AS dirn",
        ],
        """CASE WHEN ov IS NULL THEN tri ELSE b_prev END, age1, CASE WHEN ov IS NULL THEN keeps ELSE b_holding END, CASE WHEN ov IS NOT NULL THEN b_pos WHEN keeps OR size > 0 THEN dirn ELSE 0 END, dirn, size,
        CASE WHEN why LIKE 'active%' THEN least(1.0, (0.3 + 0.1 * age1) * ell) WHEN why IN ('unwind', 'collapse') THEN 1.0 WHEN why IN ('flat', 'neutral_exit') THEN 0.5 WHEN why IN ('risk_stop', 'prohibited') THEN 0.2 ELSE 0.0 END,
        keeps, CASE WHEN ov IS NULL THEN ell ELSE 0 END, why""",
        "direction, target, urgency, holds, actionability, reason", "e", first=_ENGAGED,
    ),
    "target urgency actionability",
)
def k4(spark, sf_dir):
    df = steps(spark, sf_dir).selectExpr("symbol", "ts", "seq", "ell", *_ENGAGED_COLUMNS, "0.6D AS tau_on", "0.3D AS tau_off")
    found = k.intents(df, "tri", posture="posture", collapse="broken", risk_stop="risky", neutral_exit="neutral")
    return found.select("symbol", "seq", "direction", "target", "urgency", "holds", "actionability", "reason")


@query(
    "k5_follow_target",
    _recursive(
        "CASE WHEN abs(exposure) >= 0.25 THEN exposure ELSE 0.0::DOUBLE END AS pos",
        "CASE WHEN abs(s.exposure - f.pos) >= 0.25 THEN f.pos + (s.exposure - f.pos) ELSE f.pos END",
        "pos AS position",
    ),
    "position",
)
def k5(spark, sf_dir):
    return k.follow_target(steps(spark, sf_dir), "exposure", least=0.25).select("symbol", "seq", "position")


_HELD = _folded(
    "0.0::DOUBLE AS h; 0.0::DOUBLE AS a; 0.0::DOUBLE AS r; 0.0::DOUBLE AS price",
    [
        "abs(exposure - b_h) >= 0.02 AS acts, exposure - b_h AS mv",
        "price * (1 + 0.0003 * sign(mv)) AS at_fill, b_h = 0 OR b_h * mv > 0 AS adds",
    ],
    """CASE WHEN acts THEN exposure ELSE b_h END,
    CASE WHEN NOT acts THEN b_a WHEN adds THEN (b_a * abs(b_h) + at_fill * abs(mv)) / (abs(b_h) + abs(mv)) WHEN b_h * exposure < 0 THEN at_fill WHEN exposure = 0 THEN 0 ELSE b_a END,
    CASE WHEN NOT acts THEN b_r WHEN adds THEN b_r - abs(mv) * price * 0.0005 ELSE b_r - abs(mv) * price * 0.0005 + (at_fill - b_a) * least(abs(mv), abs(b_h)) * sign(b_h) END, price""",
    "h AS held, CASE WHEN h <> 0 THEN a END AS avg_price, r AS realized, CASE WHEN h <> 0 THEN (price - a) * h ELSE 0 END AS unrealized",
)


@query("k6_position_accounting", _HELD, "held avg_price realized unrealized")
def k6(spark, sf_dir):
    return k.position_accounting(steps(spark, sf_dir), "exposure").select("symbol", "seq", "held", "avg_price", "realized", "unrealized")


@query(
    "k6_trade_ledger",
    _HELD[: _HELD.rindex("SELECT symbol, seq")].rstrip() + """, p AS (SELECT *, CAST(sign(h) AS INT) AS side, lead(CAST(sign(h) AS INT)) OVER w AS nx, lead(price) OVER w AS nprice, lead(seq) OVER w AS nseq, lead(r) OVER w AS nr, coalesce(lag(r) OVER w, 0) AS had,
    CASE WHEN t = 0 OR sign(h) <> lag(sign(h)) OVER w THEN 1 ELSE 0 END AS ch FROM o WINDOW w AS (PARTITION BY symbol ORDER BY t)), i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY t) AS island FROM p),
    l AS (SELECT symbol, island, first(side) AS side, arg_min(seq, t) AS entry_seq, max(t) AS last_t, count(*) AS rows, max(abs(h)) AS most, arg_min(price, t) AS entry_price, arg_min(had, t) AS had FROM i WHERE side <> 0 GROUP BY 1, 2)
    SELECT l.symbol, CAST(row_number() OVER (PARTITION BY l.symbol ORDER BY l.island) AS INT) AS trade, l.side, l.entry_seq, i.nseq AS exit_seq, l.rows, l.most, l.entry_price, i.nprice AS exit_price, coalesce(i.nr, i.r) - l.had AS gain,
    CASE WHEN i.nx IS NULL THEN 'open' WHEN i.nx = 0 THEN 'close' ELSE 'flip' END AS close_reason FROM l JOIN i ON i.symbol = l.symbol AND i.t = l.last_t""",
    "most entry_price exit_price gain",
)
def k6_ledger(spark, sf_dir):
    return k.trade_ledger(k.position_accounting(steps(spark, sf_dir), "exposure"))


@query(
    "k7_cost_gate",
    _folded(
        "0.0::DOUBLE AS h; []::STRUCT(u BIGINT, c DOUBLE)[] AS spent; false AS blocked; '' AS why; 0.0::DOUBLE AS cost",
        [
            "coalesce(exposure, 0) AS aim, epoch_ms(ts) AS now, CASE WHEN price > 0 THEN abs(coalesce(exposure, 0) - b_h) ELSE 0 END AS mv",
            "mv * price * 0.0008 AS due, abs(aim) > abs(b_h) AS grows, greatest(0, least(1, coalesce(actionability, 0))) * greatest(0, least(1, coalesce(ell, 0))) AS worth",
            "CASE WHEN grows THEN list_filter(b_spent, lambda x: x.u >= now - 3600000) ELSE b_spent END AS kept",
            "grows AND due > greatest(0, 1.0 - coalesce(list_sum(list_transform(kept, lambda x: x.c)), 0)) AS over, grows AND mv * price * 20.0 * 1e-4 * worth < due AS thin",
        ],
        """CASE WHEN over OR thin THEN b_h ELSE aim END, CASE WHEN NOT over AND NOT thin AND mv > 0 THEN list_append(kept, {'u': now, 'c': due}) ELSE kept END, over OR thin,
        CASE WHEN over AND thin THEN 'budget+edge' WHEN over THEN 'budget' WHEN thin THEN 'edge' ELSE '' END, CASE WHEN over OR thin THEN 0 ELSE due END""",
        "h AS gate_target, blocked, why, cost",
    ),
    "gate_target cost",
)
def k7(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return k.cost_gate(df, "exposure").select("symbol", "seq", "gate_target", "blocked", "why", "cost")


_THIN = _recursive("epoch(ts) AS at_s, epoch(ts) AS kept, true AS keep", "epoch(s.ts), CASE WHEN epoch(s.ts) - f.kept >= 7200 THEN epoch(s.ts) ELSE f.kept END, epoch(s.ts) - f.kept >= 7200", "keep")


@query("k8_time_thinning", f"SELECT symbol, seq FROM ({_THIN.replace('|f AS', 'WITH RECURSIVE f AS')}) WHERE keep")
def k8(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return k.thin(df, 7200.0).select("symbol", "seq")


@query(
    "e27_horizon_sweep",
    "|" + _folded(
        "-1e18::DOUBLE AS kept; false AS keep; 0.0::DOUBLE AS exposure; 0 AS m", ["at_s - b_kept >= least_s AS due"], "CASE WHEN due THEN at_s ELSE b_kept END, due, exposure, CASE WHEN action <> 0 THEN 1 ELSE 0 END", "1", "g", "symbol, least_s",
        "g AS (SELECT s.*, epoch(ts) AS at_s, least_s FROM steps s, (SELECT unnest([600, 3600, 14400])::DOUBLE AS least_s))",
    ).lstrip("|").replace("SELECT symbol, least_s, seq, 1 FROM o", """, l AS (SELECT *, lag(exposure) OVER w AS x0, lag(m) OVER w AS m0 FROM o WHERE keep WINDOW w AS (PARTITION BY symbol, least_s ORDER BY t)),
    r AS (SELECT symbol, least_s, sum(x0 * (m - m0)) AS e, sum(0.001 * m * abs(exposure - x0)) AS c, CAST(sum(m) AS BIGINT) AS n_support FROM l WHERE m0 IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, least_s, e / (c + 1e-12) AS rho, n_support, CASE WHEN n_support < 10 THEN 'sparse_support' WHEN e / (c + 1e-12) < 1 THEN 'below_thresh' WHEN e / (c * 1.25 + 1e-12) < 1 OR e / (c * 0.75 + 1e-12) < 1 THEN 'cost_sensitivity' ELSE 'ok' END AS reason FROM r"""),
    "rho",
)
def e27(spark, sf_dir):
    df = k.over_grid(steps(spark, sf_dir), least_s=[600.0, 3600.0, 14400.0]).withColumns({"ts_s": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "m": (F.col("action") != 0).cast("int")})
    thinned = k.thin(df, None, keys=("symbol", "least_s"))
    return logs.robustness(logs.edge_density(thinned, "exposure", "m", 0.001, 1e-12, "least_s")).select("symbol", "least_s", "rho", "n_support", "reason")


@query(
    "k9_ontology_gate",
    _folded(
        "'H' AS now; 0 AS streak; false AS switched",
        [
            "ell AS pt, 1 - ell AS pr, p_bad / 2 AS ph",
            "CASE WHEN pt >= pr AND pt >= ph THEN 'T' WHEN pr >= ph THEN 'R' ELSE 'H' END AS best, greatest(pt, pr, ph) AS top, CASE b_now WHEN 'T' THEN pt WHEN 'R' THEN pr ELSE ph END AS own",
            "CASE WHEN hold = 0 THEN b_streak WHEN best = b_now THEN 0 WHEN top >= 0.5 AND top - own >= 0.05 THEN b_streak + 1 ELSE 0 END AS waited",
            "hold <> 0 AND best <> b_now AND waited >= 2 AS moves",
        ],
        "CASE WHEN moves THEN best ELSE b_now END, CASE WHEN moves THEN 0 ELSE waited END, moves",
        "now AS ontology, switched",
    ),
)
def k9(spark, sf_dir):
    df = steps(spark, sf_dir).withColumns({"pt": F.col("ell"), "pr": 1 - F.col("ell"), "ph": F.col("p_bad") / 2})
    return k.ontology_gate(df, {"T": "pt", "R": "pr", "H": "ph"}, "hold", wait=2).select("symbol", "seq", "ontology", "switched")


_VETOES = f"v AS (SELECT *, CAST(floor(ell * 4) AS INT) AS bin, CASE WHEN seq % 2 = 0 THEN 'spot' ELSE 'perp' END AS inst, CASE WHEN seq % 97 = 1 THEN -3 WHEN seq % 13 = 0 THEN -2 ELSE state END AS tri, lead(ret) {_W} AS result FROM steps)"
_AT = "list_transform({list}, lambda x, i: CASE WHEN i = slot AND adds THEN x + {what} ELSE x END)"


@query(
    "k10_veto_gate",
    _folded(
        "0 AS pause; list_transform(range(30), lambda x: 0) AS ns; list_transform(range(30), lambda x: 0.0::DOUBLE) AS s1; list_transform(range(30), lambda x: 0.0::DOUBLE) AS s2; false AS allowed; '' AS reason",
        [
            "CAST(((action + 1) * 5 + bin) * 2 + CASE WHEN inst = 'spot' THEN 0 ELSE 1 END + 1 AS BIGINT) AS slot, b_pause > 0 AS rests, b_pause <= 0 AND action <> 0 AND result IS NOT NULL AS adds",
            "b_ns[slot] AS n, b_s1[slot] AS total, b_s2[slot] AS squares",
            """CASE WHEN rests THEN 'cooldown' WHEN p_bad > 0.9 THEN 'collapse' WHEN tri = -3 THEN 'paradox' WHEN tri = -2 THEN 'unknown' WHEN action = 0 THEN 'flat' WHEN p_bad > 0.45 THEN 'hazard' WHEN n < 20 THEN 'few'
            WHEN total / n - 0.1 * sqrt(greatest(0, (squares - total * total / n) / (n - 1))) <= 0 THEN 'tail' ELSE '' END AS found""",
        ],
        f"CASE WHEN rests THEN b_pause - 1 WHEN found IN ('collapse', 'hazard', 'tail') THEN 3 ELSE 0 END, {_AT.format(list='b_ns', what='1')}, {_AT.format(list='b_s1', what='result * action')}, {_AT.format(list='b_s2', what='(result * action) * (result * action)')}, found = '', found",
        "allowed, reason", "v", first=_VETOES,
    ),
)
def k10(spark, sf_dir):
    df = steps(spark, sf_dir).selectExpr(
        "*", "CAST(floor(ell * 4) AS INT) AS bin", "CASE WHEN seq % 2 = 0 THEN 'spot' ELSE 'perp' END AS inst", "CASE WHEN seq % 97 = 1 THEN -3 WHEN seq % 13 = 0 THEN -2 ELSE state END AS tri", f"lead(ret) {_W} AS result"
    )
    return k.veto_gate(df, "action", "bin", "result", "p_bad", "inst", "tri", cooldown=3, least=20, kappa=0.1, most_hazard=0.45).select("symbol", "seq", "allowed", "reason")


_CHANGES = f"c AS (SELECT *, CAST(sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS INT) AS flips FROM (SELECT *, t > 0 AND state <> lag(state) {_W} AS ch FROM steps))"


@query(
    "k11_thesis_memory",
    _folded(
        "0 AS d; 0 AS s; 0 AS a; 0 AS pause; 0 AS v; 'none' AS event; '' AS why",
        [
            "CASE WHEN flips > 1 THEN -1 ELSE 1 END AS calm, CASE WHEN p_bad >= 0.7 THEN -1 WHEN p_bad <= 0.3 THEN 1 ELSE 0 END AS risk, state * b_d AS agrees, greatest(0, b_pause - 1) AS rests",
            "b_d = 0 AND rests = 0 AND ell > 0.5 AND calm >= 0 AND risk >= 0 AND state <> 0 AS enters, greatest(-1, least(1, agrees + calm + risk)) AS push, least(agrees, calm, risk) < 0 AS bad",
            "greatest(0, least(2, b_s + push)) AS s1, b_a + 1 AS a1, CASE WHEN bad THEN least(2, b_v + 1) ELSE greatest(0, b_v - 1) END AS v1",
            "CASE WHEN b_d = 0 THEN '' WHEN v1 = 2 THEN 'invalidated' WHEN s1 = 0 THEN 'decay' WHEN a1 >= 50 THEN 'timeout' ELSE '' END AS ends",
            "b_d <> 0 AND ends = '' AS stays",
        ],
        """CASE WHEN enters THEN state WHEN stays THEN b_d ELSE 0 END, CASE WHEN enters THEN 1 WHEN stays THEN s1 ELSE 0 END, CASE WHEN stays THEN a1 ELSE 0 END, CASE WHEN enters THEN 0 WHEN ends <> '' THEN 5 ELSE rests END, CASE WHEN stays THEN v1 ELSE 0 END,
        CASE WHEN enters THEN 'enter' WHEN b_d = 0 THEN 'none' WHEN stays THEN 'update' ELSE 'exit' END, CASE WHEN enters THEN 'promote' WHEN b_d = 0 THEN '' WHEN ends <> '' THEN ends WHEN push > 0 THEN 'reinforce' WHEN push < 0 THEN 'weaken' ELSE 'hold' END""",
        "d AS thesis, s AS strength, a AS age, event, why", "c", first=_CHANGES,
    ),
)
def k11(spark, sf_dir):
    df = steps(spark, sf_dir).withColumn("_ch", F.coalesce(F.col("state") != F.lag("state").over(w.tape()), F.lit(False)).cast("int"))
    df = df.withColumns({"promote": F.col("ell") > 0.5, "flips": F.sum("_ch").over(w.trailing(5)).cast("int")})
    return k.thesis_memory(df, "state", "promote", "p_bad", "p_bad", "flips").select("symbol", "seq", "thesis", "strength", "age", "event", "why")


def _counted(counter: str, side: str) -> str:
    return f"CASE WHEN perm = -1 THEN 0 WHEN state = 0 AND ell <= 0.3 THEN -1 WHEN b_{counter} = -1 THEN greatest(0, {side}state) ELSE greatest(0, least(2, b_{counter} + ({side}state))) END"


@query(
    "k12_belief",
    _folded(
        "0 AS p; 0 AS m",
        ["CASE WHEN p_bad >= 0.7 THEN -1 WHEN p_bad >= 0.4 THEN 0 ELSE 1 END AS perm"],
        f"{_counted('p', '')}, {_counted('m', '-')}",
        """p AS b_plus, m AS b_minus, CASE WHEN p = 2 AND m = 2 THEN 'conflict' WHEN p = 2 THEN 'l2' WHEN m = 2 THEN 's2' WHEN p = 1 THEN 'l1' WHEN m = 1 THEN 's1' WHEN p = 0 AND m = 0 THEN 'flat' ELSE 'unk' END AS belief""",
    ),
)
def k12(spark, sf_dir):
    from tapeflow.functions.scalar import permission

    df = steps(spark, sf_dir).withColumns({"steady": F.col("ell") > 0.3, "perm": permission(F.col("p_bad"))})
    return k.belief(df, "state", "steady", "perm").select("symbol", "seq", "b_plus", "b_minus", "belief")


@query("k13_persistence_clocks", "|c AS (SELECT *, CASE WHEN action IS DISTINCT FROM lag(action) OVER (PARTITION BY symbol ORDER BY ts, seq) OR t = 0 THEN 1 ELSE 0 END AS ch FROM steps), i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts, seq) AS g FROM c) SELECT symbol, seq, CAST(row_number() OVER (PARTITION BY symbol, g ORDER BY ts, seq) AS INT) AS action_age FROM i")
def k13(spark, sf_dir):
    df = w.islands(steps(spark, sf_dir), "action")
    return df.select("symbol", "seq", F.row_number().over(w.tape("island")).alias("action_age"))


@query("k14_fill_arithmetic", "SELECT symbol, seq, greatest(0.1, 1 - p_bad) AS cap, greatest(-greatest(0.1, 1 - p_bad), least(greatest(0.1, 1 - p_bad), exposure)) - prev_exposure AS filled, price * (1 + 0.0003 * sign(fill)) AS fill_price FROM steps", "cap filled fill_price")
def k14(spark, sf_dir):
    cap = F.greatest(F.lit(0.1), 1 - F.col("p_bad"))
    return steps(spark, sf_dir).select("symbol", "seq", cap.alias("cap"), (F.greatest(-cap, F.least(cap, F.col("exposure"))) - F.col("prev_exposure")).alias("filled"), (F.col("price") * (1 + 0.0003 * F.signum("fill"))).alias("fill_price"))


_BAR_LOG = _folded(
    "0 AS prev; 0 AS age; false AS holding; 0 AS pos; 0 AS direction; 0.0::DOUBLE AS target; '' AS reason; 0.0::DOUBLE AS exposure; 0.0::DOUBLE AS filled; 1.0::DOUBLE AS equity; 0.0::DOUBLE AS price; false AS acceptable",
    [
        "CASE WHEN posture = 'UNWIND' THEN 'unwind' WHEN posture = 'OBSERVE' THEN 'observe' WHEN broken OR tri = -3 THEN 'collapse' END AS ov, CASE WHEN b_price > 0 AND price > 0 THEN b_equity * (1 + b_exposure * (price / b_price - 1)) ELSE b_equity END AS marked",
        "CASE WHEN ov IS NOT NULL THEN b_age WHEN tri NOT IN (0, -2) AND tri = b_prev THEN b_age + 1 ELSE 0 END AS age1",
        """CASE WHEN ov IS NOT NULL THEN ov WHEN tri = 0 THEN 'flat' WHEN tri = -2 AND risky THEN 'risk_stop' WHEN tri = -2 AND neutral THEN 'neutral_exit' WHEN tri = -2 THEN 'unknown'
        WHEN b_holding AND ell < tau_on THEN 'suspended' WHEN NOT b_holding AND ell < tau_off THEN 'prohibited' WHEN posture = 'TRADE_CONVEX' THEN 'active_convex' ELSE 'active' END AS why""",
        "why IN ('observe', 'unknown', 'suspended') AS keeps, CASE WHEN why LIKE 'active%' THEN least(1.0, CASE why WHEN 'active' THEN 1 ELSE 2 END * (1 - exp(-age1 / 20.0)) * ell) ELSE 0 END AS size",
        "CASE WHEN keeps THEN b_pos WHEN why LIKE 'active%' THEN tri ELSE 0 END AS dirn",
        "CASE WHEN keeps THEN 0 ELSE size * dirn - b_exposure END AS gap",
        "CASE WHEN abs(gap) >= 0.02 THEN gap ELSE 0 END AS mv",
    ],
    """CASE WHEN ov IS NULL THEN tri ELSE b_prev END, age1, CASE WHEN ov IS NULL THEN keeps ELSE b_holding END, CASE WHEN ov IS NOT NULL THEN b_pos WHEN keeps OR size > 0 THEN dirn ELSE 0 END,
    dirn, size, why, b_exposure + mv, mv, marked - abs(mv) * 0.0005, CASE WHEN price <> 0 THEN price ELSE b_price END, run >= 3""",
    "direction, target, reason, exposure, filled, equity, acceptable", "g", "symbol, tau_on, tau_off",
    f"""{_ENGAGED}, ch AS (SELECT *, CASE WHEN t = 0 OR state <> lag(state) {_W} THEN 1 ELSE 0 END AS ch FROM e), il AS (SELECT *, sum(ch) {_W} AS island FROM ch),
    g AS (SELECT s.*, CASE WHEN state = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island, tau_on ORDER BY ts, seq) END AS run, tau_on, 0.3::DOUBLE AS tau_off FROM il s, (SELECT unnest([0.5, 0.7])::DOUBLE AS tau_on))""",
)


@query("k15_strategy_grid", _BAR_LOG, "target exposure filled equity")
def k15(spark, sf_dir):
    """Bar logs at two upper thresholds, with unknown and paradox states, postures, stops and collapses."""
    df = w.acceptability(steps(spark, sf_dir).selectExpr("symbol", "ts", "seq", "state", "ell", "price", *_ENGAGED_COLUMNS))
    run = k.run_strategy(df, grid={"tau_on": [0.5, 0.7], "tau_off": [0.3]}, carry=["acceptable"], state="tri", posture="posture", collapse="broken", risk_stop="risky", neutral_exit="neutral")
    return run.select("symbol", "tau_on", "tau_off", "seq", "direction", "target", "reason", F.col("exposure_out").alias("exposure"), "filled", "equity", "acceptable")


@query("k16_tau_metrics", _BAR_LOG[: _BAR_LOG.rindex("SELECT symbol, tau_on")] + "SELECT tau_on, tau_off, avg(CAST(direction <> 0 AS INT)) AS act_pct, sum(abs(filled)) AS turnover, avg(equity) AS equity FROM o GROUP BY 1, 2", "act_pct turnover equity")
def k16(spark, sf_dir):
    run = k15(spark, sf_dir)
    return run.groupBy("tau_on", "tau_off").agg(logs.share(F.col("direction") != 0).alias("act_pct"), F.sum(F.abs("filled")).alias("turnover"), F.avg("equity").alias("equity"))


@query("f7_ewma", _recursive("0.05 * ell AS z", "0.95 * f.z + 0.05 * s.ell", "z"), "z")
def f7(spark, sf_dir):
    return k.ewma(steps(spark, sf_dir), "ell", 0.05, "z", chunk=300).select("symbol", "seq", "z")


@query(
    "f8_triadic_state",
    _folded(
        "0.0::DOUBLE AS z; 0 AS tri",
        [
            "t > 0 AND sigma >= 1e-12 AS counts",
            "CASE WHEN counts THEN 0.95 * b_z + 0.05 * greatest(-5.0, least(5.0, r / (sigma + 1e-9))) ELSE b_z END AS z1",
        ],
        "z1, CASE WHEN t = 0 THEN 0 WHEN NOT counts THEN -2 WHEN abs(z1) < greatest(5e-5, 0.5 * sigma) THEN 0 WHEN z1 > 0 THEN 1 ELSE -1 END",
        "tri", "r", first=f"r AS (SELECT *, stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS sigma FROM (SELECT symbol, ts, seq, t, price / lag(price) {_W} - 1 AS r FROM steps))",
    ),
)
def f8(spark, sf_dir):
    return k.triadic_state(steps(spark, sf_dir).select("symbol", "ts", "seq", "price")).select("symbol", "seq", "tri")


@query(
    "f17_surprise_planes",
    _folded(
        "0.01::DOUBLE AS v; 0 AS plane", ["CASE WHEN ret IS NULL THEN b_v ELSE 0.98 * b_v + 0.02 * (ret * ret) END AS v1"],
        "v1, CASE WHEN ret IS NULL THEN 0 ELSE CAST(greatest(0, least(3, floor(ln(greatest(abs(ret), 1e-12) / (2 * sqrt(v1))) / ln(3.0)) + 1)) AS INT) END",
        f"plane, plane - lag(plane) OVER (PARTITION BY symbol ORDER BY t) AS d_plane, avg(CAST(plane > 0 AS INT)) OVER (PARTITION BY symbol ORDER BY t) AS stress",
    ),
    "stress",
)
def f17(spark, sf_dir):
    df = k.ewma(steps(spark, sf_dir).withColumn("r2", F.col("ret") * F.col("ret")), "r2", 0.02, "v", start=0.01)
    plane = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.log(F.greatest(F.abs("ret"), F.lit(1e-12)) / (2 * F.sqrt("v"))) / F.log(F.lit(3.0))) + 1))
    df = df.withColumn("plane", F.coalesce(plane, F.lit(0)).cast("int"))
    return df.select("symbol", "seq", "plane", (F.col("plane") - F.lag("plane").over(w.tape())).alias("d_plane"), F.avg((F.col("plane") > 0).cast("int")).over(w.tape().rowsBetween(Window.unboundedPreceding, 0)).alias("stress"))
