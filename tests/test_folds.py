"""Folds against row loops, and fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from tapeflow.operators import folds as k
from tapeflow.operators.windows import pieces, range_block, structural_stress
from tapeflow.plans import registry

SF = "/root/testdata/sf0.001"
WEAK = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.mark.parametrize("name", WEAK)
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0


def tape(spark, rows, columns):
    return spark.createDataFrame([("s", i, i, *r) for i, r in enumerate(rows)], f"symbol string, ts long, seq long, {columns}")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("k_on,k_off", [(1, 1), (2, 3)])
def test_hysteresis_equals_loop(spark, k_on, k_off):
    rng = random.Random(k_on)
    conf = [rng.random() for _ in range(300)]
    got = [x for (x,) in values(k.hysteresis(tape(spark, [(c,) for c in conf], "c double"), "c", F.lit(0.6), F.lit(0.4), k_on, k_off), "engaged")]
    on = off = 0
    engaged, want = False, []
    for c in conf:
        on, off = (on + 1 if c >= 0.6 else 0), (off + 1 if c < 0.4 else 0)
        engaged = (on >= k_on or engaged) and not (c < 0.4 and off >= k_off)
        want.append(engaged)
    assert got == want


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_gates_of_pieces_equal_gates_of_tapes(spark, blocks):
    """Pieces without a decided row, with one row, symbols without a name and equal times."""
    rng = random.Random(blocks)
    rows = [(rng.choice(["a", "", None, "="]), rng.randrange(300), i, rng.choice([-1, 0, 1, 1, 1]), 0.45 if i % 1200 < 700 else rng.random()) for i in range(2400)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, state int, ell double")
    own = "symbol", "tau_on", "tau_off", "seq", "direction"
    grid = k.over_grid(df, tau_on=[0.5, 0.7], tau_off=[0.3, 0.6]).where("tau_on >= tau_off")
    want = k.toggling_gate(grid, F.col("tau_on"), F.col("tau_off"), keys=("tau_on", "tau_off")).select(*own).collect()
    plan = k.toggling_gates(pieces(df, blocks), [0.5, 0.7], [0.3, 0.6]).select(*own)
    assert sorted(map(repr, plan.collect())) == sorted(map(repr, want)) and len(want) == 3 * 2400


def test_k3_puts_no_tape_in_one_task(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole = "], [symbol#"  # windows of whole tapes
    assert whole in plan(registry.QUERIES["k2_toggling_gate"](spark, SF)) and whole not in plan(registry.QUERIES["k3_tau_sweep"](spark, SF))


def test_stress_of_stretches_equals_that_of_one(spark):
    """Tapes of many and of fewer rows than a stretch or a window; a symbol without a name; the plan has no window of whole tapes."""
    rng = random.Random(3)
    rows = [(None if i % 40 == 0 else "s" if i % 50 == 1 else "ab"[i % 2], i, i, float(rng.randrange(1, 90)), rng.choice([-1, 0, 1])) for i in range(3000)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, price double, state int")
    one, many = structural_stress(df, 20, stretch=1000), structural_stress(pieces(df, 9), 20, stretch=3)
    assert "], [symbol#" not in many._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["seq"], r["stressed"], round(r["p_stress"], 9)) for r in many.orderBy("seq").collect()]
    assert got == [(r["seq"], r["stressed"], round(r["p_stress"], 9)) for r in one.orderBy("seq").collect()] and len(got) == 3000


def test_grid_points_of_a_strategy_are_tasks_of_their_own(spark):
    plan = registry.QUERIES["k15_strategy_grid"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [symbol#" in plan and plan.count("RepartitionByExpression") == 2 and "_island" not in plan


def test_position_accounting(spark):
    rows = [(1.0, 10.0), (2.0, 12.0), (1.0, 15.0), (-1.0, 14.0), (0.0, 10.0)]
    got = values(k.position_accounting(tape(spark, rows, "target double, price double"), "target", fee=0.0, slip=0.0), "held", "avg_price", "realized", "unrealized")
    assert got == [(1.0, 10.0, 0.0, 0.0), (2.0, 11.0, 0.0, 2.0), (1.0, 11.0, 4.0, 4.0), (-1.0, 14.0, 7.0, 0.0), (0.0, None, 11.0, 0.0)]


def test_cost_gate_blocks_growth_only(spark):
    rows = [(1.0, 100.0, 1.0, 1.0, 0), (5.0, 100.0, 0.1, 0.1, 1), (0.5, 100.0, 0.0, 0.0, 2), (2.0, 100.0, 1.0, 1.0, 3)]
    got = values(k.cost_gate(tape(spark, rows, "target double, price double, actionability double, ell double, ts_ms long"), "target", budget=0.2), "gate_target", "blocked", "why")
    assert got == [(1.0, False, ""), (1.0, True, "budget+edge"), (0.5, False, ""), (0.5, True, "budget")]


@pytest.mark.parametrize("seed", range(4))
def test_cost_gate_decides_close_calls_as_a_plain_sum(seed):
    """Costs are multiples of a thousandth here, so what is left of the budget often equals a cost but for rounding."""
    rng = random.Random(seed)
    step = k.cost_gate_step("aim", "price", "act", "urge", 0.001, 20.0, 1.0, 50, "at")
    state, held, spent = (0.0, k.deque(), 0), 0.0, []
    for at in range(4000):
        row = {"aim": rng.randrange(-9, 10) / 10, "price": float(rng.choice([10, 50, 100, 200])), "act": rng.randrange(101) / 100, "urge": rng.randrange(101) / 100, "at": at}
        state, (got, blocked, why, cost) = step(state, row)
        moved, grows = abs(row["aim"] - held) * row["price"], abs(row["aim"]) > abs(held)
        spent, used = [x for x in spent if x[0] >= at - 50], 0.0
        for _, c in spent:
            used += c
        due = moved * 0.001
        over, thin = grows and due > max(0.0, 1.0 - used), grows and moved * 20.0 * 1e-4 * (row["act"] * row["urge"]) < due
        if not over and not thin:
            spent, held = [*spent, (at, due)] if moved > 0 else spent, row["aim"]
        assert (got, why) == (held, "+".join(n for n, x in (("budget", over), ("edge", thin)) if x)), at


def test_thesis_enters_holds_and_cools_down(spark):
    rows = [(1, True, 0.1, 0), (1, False, 0.1, 0), (-1, False, 0.9, 2), (-1, False, 0.9, 2), (1, True, 0.1, 0)]
    got = values(k.thesis_memory(tape(spark, rows, "sign int, promote boolean, p double, flips int"), "sign", "promote", "p", "p", "flips", cooldown=3), "thesis", "event", "why")
    assert [g[1] for g in got] == ["enter", "update", "update", "exit", "none"] and got[0][0] == 1 and got[3][2] == "invalidated"


def test_ontology_waits_for_a_clear_streak(spark):
    rows = [(True, 0.9, 0.1, 0.0), (False, 0.9, 0.1, 0.0), (True, 0.9, 0.1, 0.0), (True, 0.1, 0.2, 0.3)]
    got = values(k.ontology_gate(tape(spark, rows, "hold boolean, t double, r double, h double"), {"T": "t", "R": "r", "H": "h"}, "hold", wait=2), "ontology", "switched")
    assert got == [("H", False), ("H", False), ("T", True), ("T", False)]


def test_chunks_do_not_change_ewma(spark):
    df = tape(spark, [(float(i % 7) if i % 5 else None,) for i in range(200)], "x double")
    whole, cut = (values(k.ewma(df, "x", 0.1, "z", chunk=c), "z") for c in (1000, 7))
    assert [round(a[0], 9) for a in whole] == [round(b[0], 9) for b in cut]


def test_veto_history_is_kept_by_instrument_and_judged_by_its_tail(spark):
    rows = [(1, "a", -0.5), (1, "b", 1.0), (1, "a", -0.6), (1, "b", 1.0), (1, "a", 1.0), (1, "b", 1.0), (0, "b", 1.0), (1, "b", 1.0)]
    df = tape(spark, [(d, 0, r, 0.0, i) for d, i, r in rows], "d int, bin int, r double, h double, inst string")
    for mode in ("mean", "cvar"):
        got = values(k.veto_gate(df, "d", "bin", "r", "h", "inst", cooldown=1, least=2, mode=mode, alpha=0.5, epsilon=0.1), "allowed", "reason")
        assert got == [(False, "few"), (False, "few"), (False, "few"), (False, "few"), (False, "tail"), (False, "cooldown"), (False, "flat"), (True, "")]


def test_postures_leave_no_trace(spark):
    """Overridden rows don't count: the others get what they get on a tape without them."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, -1, 0, -2]), rng.random(), rng.choice(["TRADE_NORMAL", "TRADE_NORMAL", "TRADE_CONVEX", "OBSERVE", "UNWIND"]), 0.6, 0.3) for _ in range(200)]
    columns, out = "state int, ell double, posture string, tau_on double, tau_off double", ("seq", "direction", "target", "urgency", "holds", "reason")
    whole = tape(spark, rows, columns)
    got = values(k.intents(whole, posture="posture"), *out)
    rest = values(k.intents(whole.where("posture NOT IN ('OBSERVE', 'UNWIND')"), posture="posture"), *out)
    assert [g for g in got if g[-1] not in ("observe", "unwind")] == rest
    assert all(g[1:5] == (0, 0.0, 1.0, False) for g in got if g[-1] == "unwind") and all(g[4] and g[2] == 0 for g in got if g[-1] == "observe")


def test_belief_tables(spark):
    rows = [(1, True, 1), (1, True, 1), (-1, True, 1), (0, False, 0), (-1, True, 0), (-1, True, -1)]
    got = values(k.belief(tape(spark, rows, "s int, steady boolean, perm int"), "s", "steady", "perm"), "b_plus", "b_minus", "belief")
    assert got == [(1, 0, "l1"), (2, 0, "l2"), (1, 1, "l1"), (-1, -1, "unk"), (0, 1, "s1"), (0, 0, "flat")]


@pytest.mark.parametrize("blocks", [2, 40])
def test_one_symbol_over_many_tasks(spark, blocks):
    """Machines give the same whether a tape is one piece or many, ties in time and a short tape among them."""
    rng = random.Random(11)
    tapes = [("hot", 700), ("cold", 3), (None, 50)]
    rows = [(s, i // 3, i, rng.choice([-1, 0, 1, None]), rng.random() < 0.4, rng.random(), rng.randrange(3), rng.choice([True, False, None]), rng.choice([-1, 0, 1, 1])) for s, n in tapes for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, s int, yes boolean, p double, flips int, steady boolean, perm int")
    df = df.withColumns({"a": F.col("p"), "b": F.pmod(F.col("p") * 7, F.lit(1.0)), "c": F.pmod(F.col("p") * 13, F.lit(1.0))})

    def all_of(n):
        out = k.thesis_memory(df, "s", "yes", "p", "p", "flips", a_max=9, cooldown=3, blocks=n)
        out = k.belief(out, "s", "steady", "perm", blocks=n)
        return k.ontology_gate(out, {"H": "a", "T": "b", "R": "c"}, "yes", on=0.3, margin=0.0, wait=3, blocks=n)

    one, many = (sorted(map(tuple, all_of(n).collect()), key=str) for n in (1, blocks))
    assert one == many and len(one) == 753
    assert {r[-2] for r in one} == {"H", "T", "R"} and {"exit", "enter", "update", "none"} <= {x for r in one for x in r if isinstance(x, str)}
    cut = df.withColumn("piece", range_block(df, "ts", blocks)).where("symbol = 'hot'")
    assert cut.select("piece").distinct().count() > blocks // 3


def test_machine_of_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, ts long, seq long, s int, steady boolean, perm int")
    assert k.belief(df, "s", "steady", "perm").collect() == []
