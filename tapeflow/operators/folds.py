"""Keyed sequential operators: state machines over the rows of a symbol in order.

What has a closed form is windows only.  The others are folds: rows are dealt by symbol (and grid point), sorted within
partitions, and streamed through one pure step function `step(state, row) -> (state, outputs)`; only the state of the
current key is held, so a long tape needs no more memory than a short one.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import islands, piece, range_block, tape

_SPARK_TO_ARROW = {"int": "int32", "long": "int64", "bigint": "int64", "double": "float64", "string": "string", "boolean": "bool_"}


class _Rows:
    """A batch's rows, one after the other: row[name] turns a column into values when it is asked for first."""

    __slots__ = ("at", "batch", "held")

    def __init__(self, batch):
        self.batch, self.held, self.at = batch, {}, 0

    def __getitem__(self, name: str):
        if name not in self.held:
            self.held[name] = self.batch.column(name).to_pylist()
        return self.held[name][self.at]


def fold(df: DataFrame, init: Callable, step: Callable, outputs: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """df with the columns that step yields for each row ("name type, ..."); init() is the state at a key's first row."""
    import pyarrow as pa

    fields = [x.split() for x in outputs.split(",")]
    kinds = [getattr(pa, _SPARK_TO_ARROW[kind])() for _, kind in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {k}" for n, k in fields])

    def run(batches):
        at = state = None
        for batch in batches:
            made: list[tuple] = []
            row = _Rows(batch)
            for row.at in range(batch.num_rows):
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, init()
                state, out = step(state, row)
                made.append(out)
            columns = list(zip(*made, strict=True)) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=[*batch.schema.names, *[n for n, _ in fields]])

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def machine(df: DataFrame, states: list[tuple], step: Callable, outputs: str, blocks: int | None = None) -> DataFrame:
    """fold for a step with finitely many states, of which the first is the start: a tape of one symbol is many tasks' work.

    Tapes are cut by ranges of time.  Every piece is a map from states to states, found by taking all states through its
    rows at once (states that have met go on as one); the maps of a tape, one for each piece, are put together in
    order, which gives each piece its start; then pieces are replayed, all at the same time.
    """
    import pandas as pd
    import pyarrow as pa

    number = {s: i for i, s in enumerate(states)}
    cut = df.withColumn("_c", F.coalesce(range_block(df, "ts", blocks), F.lit(-1)))

    def maps(batches):
        at, now = None, {}
        schema = pa.schema([("symbol", pa.string()), ("_c", pa.int32()), ("ends", pa.list_(pa.int32()))])

        def end():
            ends = [0] * len(states)
            for state, starts in now.items():
                for i in starts:
                    ends[i] = number[state]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), pa.array([ends], pa.list_(pa.int32()))], schema=schema)

        for batch in batches:
            row = _Rows(batch)
            for row.at in range(batch.num_rows):
                key = row["symbol"], row["_c"]
                if key != at:
                    if at is not None:
                        yield end()
                    at, now = key, {s: [i] for s, i in number.items()}
                moved: dict[tuple, list[int]] = {}
                for state, starts in now.items():
                    to = step(state, row)[0]
                    moved[to] = moved[to] + starts if to in moved else starts
                now = moved
        if at is not None:
            yield end()

    placed = cut.repartition("symbol", "_c").sortWithinPartitions("symbol", "_c", "ts", "seq")
    found = placed.withColumn("_c", F.col("_c").cast("int")).withColumn("symbol", F.col("symbol").cast("string")).mapInArrow(maps, "symbol string, _c int, ends array<int>")

    def starts(f: pd.DataFrame) -> pd.DataFrame:
        f, at, out = f.sort_values("_c"), 0, []
        for ends in f["ends"]:
            out.append(at)
            at = ends[at]
        return f[["symbol", "_c"]].assign(_start=out)

    begun = found.groupBy("symbol").applyInPandas(starts, "symbol string, _c int, _start int")
    begun = begun.select(F.col("symbol").alias("_symbol"), F.col("_c").alias("_piece"), "_start")
    ready = cut.join(begun, F.col("symbol").cast("string").eqNullSafe(F.col("_symbol")) & (F.col("_c") == F.col("_piece"))).drop("_symbol", "_piece")

    def replayed(state, row):
        return step(states[row["_start"]] if state is None else state, row)

    return fold(ready, lambda: None, replayed, outputs, ("symbol", "_c")).drop("_c", "_start")


def over_grid(df: DataFrame, **values: list[float]) -> DataFrame:
    """Every row for every combination of parameter values."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df


# --- closed forms -----------------------------------------------------------------------------------------------------


def hysteresis(df: DataFrame, conf: str, on: Column, off: Column, k_on: int = 1, k_off: int = 1, out: str = "engaged", keys: tuple[str, ...] = ()) -> DataFrame:
    """Engaged after k_on values in a row of at least `on`, until k_off in a row below `off`; leaving wins."""
    w = tape(*keys)
    marked = df.withColumn("_n", F.row_number().over(w))
    enter, leave = F.col(conf) >= on, F.col(conf) < off
    marked = marked.withColumns({"_in": F.when(~enter, F.col("_n")), "_out": F.when(~leave, F.col("_n"))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.col("_n") - F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0))
    marked = marked.withColumns({"_a": run("_in"), "_b": run("_out")})
    decision = F.when(leave & (F.col("_b") >= k_off), False).when(F.col("_a") >= k_on, True)
    marked = marked.withColumn("_d", decision)
    return marked.withColumn(out, F.coalesce(F.last("_d", ignorenulls=True).over(upto), F.lit(False))).drop("_n", "_in", "_out", "_a", "_b", "_d")


def toggling_gate(df: DataFrame, on: Column, off: Column, state: str = "state", ell: str = "ell", out: str = "direction", keys: tuple[str, ...] = ()) -> DataFrame:
    """Acts at ell >= on, holds below off and in flat or unsure rows, and in between does what it didn't do before."""
    w = tape(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e, live = F.col(ell), (F.col(state) != 0) & (F.col(ell) > 0)
    decided = F.when(~live | (e < off), 0).when(e >= on, 1)
    marked = df.withColumn("_d", decided).withColumn("_n", F.row_number().over(w))
    last = F.last(F.when(F.col("_d").isNotNull(), F.struct("_n", "_d")), ignorenulls=True).over(upto)
    marked = marked.withColumn("_l", last)
    # Rows between follow one another, so their number tells how often the gate turned; tapes start acting.
    act = (F.coalesce(F.col("_l._d"), F.lit(1)) + F.col("_n") - F.coalesce(F.col("_l._n"), F.lit(0))) % 2
    return marked.withColumn(out, F.when(act == 1, F.col(state)).otherwise(0)).drop("_d", "_n", "_l")


def toggling_gates(df: DataFrame, on: list[float], off: list[float], state: str = "state", ell: str = "ell", out: str = "direction") -> DataFrame:
    """toggling_gate of tapes cut to pieces, once for each pair of limits with on >= off, as columns tau_on and tau_off.

    Of a gate that turns with every row, whether it acts and the row's number are together even or odd as long as nothing
    decides; so the last decided row tells that of all rows up to the next one, in its own piece and the following ones.
    """
    pairs = [(a, b) for a in on for b in off if a >= b]
    names = [f"_k{i}" for i in range(len(pairs))]
    e, live, n = F.col(ell), (F.col(state) != 0) & (F.col(ell) > 0), F.col("_n")
    upto, before = piece().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_key").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda a, b: F.when(~live | (e < b), n % 2).when(e >= a, (n + 1) % 2)
    marked = df.withColumn("_n", F.row_number().over(piece()))
    marked = marked.withColumns({k: F.last(odd(F.lit(a), F.lit(b)), ignorenulls=True).over(upto) for k, (a, b) in zip(names, pairs)})
    ends = marked.groupBy("_key", "_c").agg(F.max("_n").alias("_all"), F.max_by(F.struct(*names), "_n").alias("_e"))
    # rows are numbered by tape here, and by piece before and after
    ends = ends.withColumn("_o", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    starts = ends.select("_key", "_c", *[((F.coalesce(F.last((F.col(f"_e.{k}") + F.col("_o")) % 2, ignorenulls=True).over(before), F.lit(1)) + F.col("_o")) % 2).alias(f"_s{k}") for k in names])
    found = marked.join(starts, ["_key", "_c"])
    acts = lambda k: F.when((n + F.coalesce(k, f"_s{k}")) % 2 == 1, F.col(state)).otherwise(0)
    points = F.array(*[F.struct(F.lit(a).alias("tau_on"), F.lit(b).alias("tau_off"), acts(k).alias(out)) for k, (a, b) in zip(names, pairs)])
    return found.withColumn("_p", F.explode(points)).select(*[c for c in df.columns if c not in ("_key", "_c")], "_p.*")


# --- folds ------------------------------------------------------------------------------------------------------------


def ewma(df: DataFrame, column: str, alpha: float, out: str, chunk: int = 10_000, start: float = 0.0) -> DataFrame:
    """z = (1 - alpha) * z + alpha * x from `start`; nulls leave z as it is.

    An affine recurrence: each chunk of a tape is a factor and an offset, found in parallel; the few chunks of a tape are
    put together in order; then every chunk is replayed from its known start.
    """
    w = tape()
    numbered = df.withColumn("_c", F.floor((F.row_number().over(w) - 1) / chunk).cast("long"))

    def replay(with_start: bool):
        def step(z, row):
            z = row["_start"] if z is None and with_start else (0.0 if z is None else z)
            if row[column] is not None:
                z = (1 - alpha) * z + alpha * row[column]
            return z, (z,)

        return step

    part = fold(numbered, lambda: None, replay(False), "_z double", ("symbol", "_c"))
    ends = part.groupBy("symbol", "_c").agg(F.max_by("_z", F.struct("ts", "seq")).alias("b"), F.pow(F.lit(1 - alpha), F.count(column)).alias("a"))

    def after(z, row):
        return row["a"] * z + row["b"], (z,)

    begin = fold(ends, lambda: start, after, "_start double", order=("_c",)).select("symbol", "_c", "_start")
    # z at a row of a chunk: what the chunk alone gives, and its start faded by the values so far.
    inside = Window.partitionBy("symbol", "_c").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = part.join(begin, ["symbol", "_c"])
    return found.withColumn(out, F.col("_z") + F.col("_start") * F.pow(F.lit(1 - alpha), F.count(column).over(inside))).drop("_c", "_z", "_start")


def triadic_state(df: DataFrame, price: str = "price", window: int = 200, dead: float = 5e-5, keep: float = 0.95, out: str = "tri") -> DataFrame:
    """1, 0, -1 by the smoothed normalised return against a dead zone; -2 where price or volatility are unknown; 0 first.

    A return from a price of 0 is infinite or no number: while the window holds one, its volatility is beyond all bounds, rows count
    as a return at the upper limit and lie in the dead zone.
    """

    def init():
        return None, deque(maxlen=window), 0.0

    def step(state, row):
        before, seen, z = state
        p = row[price]
        known = p is not None and math.isfinite(p)
        if before is None:
            return ((p if known else math.nan), seen, z), (0,)
        if not known or not math.isfinite(before):
            return ((p if known else math.nan), seen, z), (-2,)
        r = p / before - 1.0 if before else math.nan
        seen.append(r)
        mean = math.fsum(seen) / len(seen)
        if len(seen) > 1 and not math.isfinite(mean):
            return (p, seen, keep * z + (1 - keep) * 5.0), (0,)
        sigma = math.sqrt(math.fsum((x - mean) ** 2 for x in seen) / len(seen)) if len(seen) > 1 else 0.0
        if sigma < 1e-12:
            return (p, seen, z), (-2,)
        z = keep * z + (1 - keep) * max(-5.0, min(5.0, r / (sigma + 1e-9)))
        return (p, seen, z), (0 if abs(z) < max(dead, 0.5 * sigma) else 1 if z > 0 else -1,)

    return fold(df, init, step, f"{out} int")


def follow_target(df: DataFrame, target: str, hold: str | None = None, least: float = 0.02, fee: float = 0.0005, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """position, filled, cost: moves to the target when it is `least` away, and not while holding."""

    def step(held, row):
        aim = row[target]
        move = 0.0 if aim is None or hold and row[hold] else aim - held
        if abs(move) < least:
            move = 0.0
        return held + move, (held + move, move, abs(move) * fee)

    return fold(df, lambda: 0.0, step, "position double,filled double,cost double", keys)


def position_accounting(df: DataFrame, target: str, price: str = "price", fee: float = 0.0005, slip: float = 0.0003, least: float = 0.02) -> DataFrame:
    """held, avg_price, realized, unrealized by average price: adding moves the average, closing realizes against it."""

    def step(state, row):
        held, average, realized = state
        aim, p = row[target], row[price]
        move = 0.0 if aim is None or p is None else aim - held
        if abs(move) >= least:
            fill = p * (1 + math.copysign(slip, move))
            realized -= abs(move) * p * fee
            if held == 0 or held * move > 0:
                average = (average * abs(held) + fill * abs(move)) / (abs(held) + abs(move))
            else:
                closed = min(abs(move), abs(held))
                realized += (fill - average) * math.copysign(closed, held)
                if held * aim < 0:
                    average = fill
                elif aim == 0:
                    average = 0.0
            held = aim
        open_gain = (p - average) * held if held and p is not None else 0.0
        return (held, average, realized), (held, average if held else None, realized, open_gain)

    return fold(df, lambda: (0.0, 0.0, 0.0), step, "held double,avg_price double,realized double,unrealized double")


def cost_units(cost: float) -> int:
    """A cost in whole units of 2^-60, whose running sums are exact."""
    return int(min(cost, 1e200) * 2.0**60)


def cost_gate_step(target: str, price: str, actionability: str, urgency: str, rate: float, edge_bps: float, budget: float, window_ms: int, at_ms: str) -> Callable:
    """step(state, row) of cost_gate; the state is the position, the moves of the time window, each with its time and cost, and
    the sum of these costs in cost_units.  Where that is too close to tell, the costs are added up in the order of the moves."""
    share = lambda x: max(0.0, min(1.0, x or 0.0))

    def step(state, row):
        held, moves, total = state
        aim, now, value = row[target] or 0.0, row[at_ms], max(0.0, row[price] or 0.0)
        while moves and moves[0][0] < now - window_ms:
            total -= cost_units(moves.popleft()[1])
        amount = abs(aim - held) * value
        cost, worth = amount * rate, amount * edge_bps * 1e-4 * (share(row[actionability]) * share(row[urgency]))
        grows, spent = abs(aim) > abs(held), total * 2.0**-60
        if grows and abs(budget - spent - cost) <= 1e-9 * (budget + spent + cost):
            spent = 0.0
            for _, c in moves:  # not sum, which corrects its rounding
                spent += c
        refusals = {"budget": grows and 0 < budget and max(0.0, budget - spent) < cost, "edge": grows and 0 < edge_bps and worth < cost}
        why = "+".join(name for name, applies in refusals.items() if applies)
        if why:
            return (held, moves, total), (held, True, why, 0.0)
        if amount > 0 and budget > 0:
            moves.append((now, cost))
            total += cost_units(cost)
        return (aim, moves, total), (aim, False, "", cost)

    return step


def cost_gate(df: DataFrame, target: str, price: str = "price", actionability: str = "actionability", urgency: str = "ell", rate: float = 0.0008, edge_bps: float = 20.0, budget: float = 1.0, window_ms: int = 3_600_000, at_ms: str = "ts_ms") -> DataFrame:
    """gate_target, blocked, why, cost: growing a position must fit the budget of a time window and pay for its cost."""
    step = cost_gate_step(target, price, actionability, urgency, rate, edge_bps, budget, window_ms, at_ms)
    return fold(df, lambda: (0.0, deque(), 0), step, "gate_target double,blocked boolean,why string,cost double")


def thin(df: DataFrame, least_s: float, at_s: str = "ts_s", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows that come at least least_s after the last one kept; the first is kept."""

    def step(last, row):
        gap = row["least_s"] if least_s is None else least_s
        keep = last is None or row[at_s] - last >= gap
        return (row[at_s] if keep else last), (keep,)

    return fold(df, lambda: None, step, "_keep boolean", keys).where("_keep").drop("_keep")


def ontology_gate(df: DataFrame, probabilities: dict[str, str], holding: str, start: str = "H", on: float = 0.5, margin: float = 0.05, wait: int = 3, blocks: int | None = None) -> DataFrame:
    """ontology, switched: the label moves to the likeliest one only while holding, after `wait` clear rows in a row."""

    def step(state, row):
        now, streak = state
        if not row[holding]:
            return state, (now, False)
        p = {k: row[c] or 0.0 for k, c in probabilities.items()}
        best = max(p, key=p.get)
        if best == now:
            return (now, 0), (now, False)
        streak = streak + 1 if p[best] >= on and p[best] - p[now] >= margin else 0
        if streak >= wait:
            return (best, 0), (best, True)
        return (now, streak), (now, False)

    states = [(k, n) for k in (start, *(k for k in probabilities if k != start)) for n in range(wait)]
    return machine(df, states, step, "ontology string,switched boolean", blocks)


def veto_gate(
    df: DataFrame, direction: str, ell_bin: str, result: str, hazard: str, instrument: str | None = None, state: str | None = None, cooldown: int = 5, ring: int = 1024, least: int = 50,
    mode: str = "mean", kappa: float = 1.0, alpha: float = 0.05, epsilon: float = 0.0, most_hazard: float = 0.95,
) -> DataFrame:
    """allowed, reason: the first veto that applies to a row, "" if none does.

    Rows of a pause are held back and leave no trace.  Other rows with a direction add their signed result to the history of
    (direction, bin, instrument), after they are judged by it: by mean - kappa deviations of all of it (mode "mean"), which
    must be over 0, or by the mean of the worst alpha of the last `ring` results ("cvar"), which must reach -epsilon.
    Less than `least` results veto too.  Vetoes for the market or the history start a pause.
    """
    pausing = {"collapse", "hazard", "tail"}

    def judged(h, d, now, own):
        rules = (("collapse", h > 2 * most_hazard), ("paradox", now == -3), ("unknown", now == -2), ("flat", d == 0), ("hazard", h > most_hazard), ("few", own[0] < least))
        found = next((why for why, applies in rules if applies), "")
        if found:
            return found
        if mode == "mean":
            n, total, squares = own[:3]
            spread = math.sqrt(max(0.0, (squares - total * total / n) / (n - 1))) if n > 1 else 0.0
            return "tail" if total / n - kappa * spread <= 0 else ""
        last = sorted(own[3])
        worst = last[max(0, math.floor(alpha * len(last)) - 1)]
        tail = [x for x in last if x <= worst]
        return "tail" if math.fsum(tail) / len(tail) < -epsilon else ""

    def step(held, row):
        pause, history = held
        if pause > 0:
            return (pause - 1, history), (False, "cooldown")
        d = row[direction] or 0
        own = history.setdefault((d, row[ell_bin], row[instrument] if instrument else None), [0, 0.0, 0.0, deque(maxlen=ring)])
        why = judged(row[hazard] or 0.0, d, row[state] if state else 0, own)
        if d != 0 and row[result] is not None and math.isfinite(row[result]):
            x = row[result] * d
            own[:3] = own[0] + 1, own[1] + x, own[2] + x * x
            own[3].append(x)
        return (cooldown if why in pausing else 0, history), (not why, why)

    return fold(df, lambda: (0, {}), step, "allowed boolean,reason string")


#: A thesis' strength, 0 to 2, after a push of -1, 0 or 1, and its doubt after a row without and with adverse evidence.
_STRENGTH = {-1: (0, 0, 1), 0: (0, 1, 2), 1: (1, 2, 2)}
_DOUBT = {False: (0, 0, 1), True: (1, 2, 2)}
_PUSHED = {-1: "weaken", 0: "hold", 1: "reinforce"}


def thesis_memory(df: DataFrame, sign: str, promote: str, p_bad: str, stress: str, flips: str, a_max: int = 50, cooldown: int = 5, low: float = 0.3, high: float = 0.7, blocks: int | None = None) -> DataFrame:
    """thesis, strength, age, event, why: a direction held on evidence, left when invalid, faded or too old.

    What evidence a row gives but for its side is a column; the fold looks up what side, strength and doubt become of it.
    """
    bad, tense = F.coalesce(p_bad, F.lit(0.0)), F.coalesce(stress, F.lit(0.0))
    risk = F.when((bad >= high) | (tense >= high), -1).when((bad <= low) & (tense <= low), 1).otherwise(0)
    calm = F.when(F.coalesce(flips, F.lit(0)) > 1, -1).otherwise(1)
    known = df.withColumns({"_side": F.coalesce(F.signum(sign), F.lit(0)).cast("int"), "_risk": risk, "_calm": calm, "_opens": F.coalesce(promote, F.lit(False)) & (calm > 0) & (risk >= 0) & (F.coalesce(sign, F.lit(0)) != 0)})

    def step(state, row):
        thesis, strength, age, pause, doubt = state
        side, pause = row["_side"], max(0, pause - 1)
        if not thesis:
            opens = row["_opens"] and not pause
            kept = (side, 1, 0) if opens else (0, 0, 0)
            return (*kept, pause, 0), (*kept, *(("enter", "promote") if opens else ("none", "")))
        evidence = (side * thesis, row["_calm"], row["_risk"])
        push = max(-1, min(1, sum(evidence)))
        strength, age, doubt = _STRENGTH[push][strength], age + 1, _DOUBT[-1 in evidence][doubt]
        ends = [why for why, applies in (("invalidated", doubt == 2), ("decay", strength == 0), ("timeout", age >= a_max)) if applies]
        if ends:
            return (0, 0, 0, cooldown, 0), (0, 0, 0, "exit", ends[0])
        return (thesis, strength, age, pause, doubt), (thesis, strength, age, "update", _PUSHED[push])

    held = [(t, n, age, 0, doubt) for t in (-1, 1) for n in (1, 2) for age in range(a_max) for doubt in (0, 1)]
    states = [(0, 0, 0, pause, 0) for pause in range(cooldown + 1)] + held
    return machine(known, states, step, "thesis int,strength int,age int,event string,why string", blocks).drop("_side", "_risk", "_calm", "_opens")


#: What a counter of -1 (unknown), 0, 1 or 2 becomes by a row's evidence for its side.
_COUNTER = {"cleared": (0, 0, 0, 0), "lost": (-1, -1, -1, -1), "against": (0, 0, 0, 1), "neither": (0, 0, 1, 2), "for": (1, 1, 2, 2)}
#: Labels by the counter for long (rows: -1, 0, 1, 2) and for short (columns likewise).
_BELIEF = (("unk", "unk", "s1", "s2"), ("unk", "flat", "s1", "s2"), ("l1", "l1", "l1", "s2"), ("l2", "l2", "l2", "conflict"))


def belief(df: DataFrame, sign: str, steady: str, allowed: str, blocks: int | None = None) -> DataFrame:
    """b_plus, b_minus, belief: two counters from 0 to 2, -1 for unknown, and the label of the pair; see the tables above."""
    side = F.coalesce(F.col(sign), F.lit(0))
    evidence = lambda own: F.when(F.col(allowed) == -1, "cleared").when((side == 0) & ~F.coalesce(steady, F.lit(False)), "lost").when(side == 0, "neither").when(side == own, "for").otherwise("against")
    known = df.withColumns({"_long": evidence(1), "_short": evidence(-1)})

    def step(counters, row):
        p, m = (_COUNTER[row[c]][b + 1] for c, b in zip(("_long", "_short"), counters, strict=True))
        return (p, m), (p, m, _BELIEF[p + 1][m + 1])

    states = sorted(((p, m) for p in range(-1, 3) for m in range(-1, 3)), key=lambda s: s != (0, 0))
    return machine(known, states, step, "b_plus int,b_minus int,belief string", blocks).drop("_long", "_short")


#: Why a row acts or doesn't: the first of these that holds for x, whose fields are all columns or all plain values.  held and free:
#: whether the strategy holds or not; under_on, under_off: whether confidence is below the limits.
REASONS = (
    ("flat", lambda x: x.state == 0),
    ("risk_stop", lambda x: (x.state == -2) & x.risk_stop),
    ("neutral_exit", lambda x: (x.state == -2) & x.neutral_exit),
    ("unknown", lambda x: x.state == -2),
    ("suspended", lambda x: x.held & x.under_on),
    ("prohibited", lambda x: x.free & x.under_off),
    ("active_convex", lambda x: x.convex),
    ("active", lambda x: x.state == x.state),
)
#: Reasons that keep the direction held, and urgencies of those that don't act (0 for others).
HOLDING = ("observe", "unknown", "suspended")
URGENCY = {"unwind": 1.0, "collapse": 1.0, "flat": 0.5, "neutral_exit": 0.5, "risk_stop": 0.2, "prohibited": 0.2}


def intents(
    df: DataFrame, state: str = "state", conf: str = "ell", on: str = "tau_on", off: str = "tau_off", posture: str | None = None, collapse: str | None = None, risk_stop: str | None = None, neutral_exit: str | None = None,
    base: float = 1.0, ramp: float = 20.0, keys: tuple[str, ...] = (), grid: dict[str, list[float]] | None = None,
) -> DataFrame:
    """direction, target, urgency, holds, actionability, reason of every row, by windows alone.

    grid: values of parameters, `on` and `off` among them; rows come once for each combination, after all that doesn't depend on them.

    States: 1, 0, -1, -2 unknown, -3 paradox.  Postures UNWIND and OBSERVE, a collapse and a paradox override a row and leave
    no trace: the others see the tape without it.  Of these, flat and unknown states and confident ones settle whether the
    strategy holds, less confident ones leave it as it is; so the last one that settles it counts.  The direction that is
    held follows likewise, and a state's age is the distance to its last change.
    """
    w = tape(*keys)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c else F.lit(False)
    mode = F.coalesce(F.col(posture), F.lit("TRADE_NORMAL")) if posture else F.lit("TRADE_NORMAL")
    s, c = F.coalesce(F.col(state), F.lit(0)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf, F.lit(0.0))))
    override = F.when(mode == "UNWIND", "unwind").when(mode == "OBSERVE", "observe").when(flag(collapse) | (s == -3), "collapse")
    d = df.withColumns({"_s": s, "_c": c, "_why": override, "_live": override.isNull()})
    d = d.withColumns({"_last": F.last(F.when(F.col("_live"), F.col("_s")), ignorenulls=True).over(before), "_n": F.count_if("_live").over(upto)})
    same = F.col("_live") & ~F.col("_s").isin(0, -2) & F.col("_s").eqNullSafe(F.col("_last"))
    d = d.withColumn("_age", F.col("_n") - F.last(F.when(F.col("_live") & ~same, F.col("_n")), ignorenulls=True).over(upto))
    if grid:
        # tapes of each combination are tasks of their own, not rows of one
        d = over_grid(d, **grid).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", *keys, *grid)
        before = tape(*keys, *grid).rowsBetween(Window.unboundedPreceding, -1)
    stopped = (F.col("_s") == -2) & (flag(risk_stop) | flag(neutral_exit))
    settles = F.when(~F.col("_live"), None).when((F.col("_s") == 0) | stopped, False).when(F.col("_s") == -2, True).when(F.col("_c") >= F.col(on), False)
    d = d.withColumn("_settles", settles)
    d = d.withColumn("_held", F.coalesce(F.last("_settles", ignorenulls=True).over(before), F.lit(False)))
    x = SimpleNamespace(
        state=F.col("_s"), held=F.col("_held"), free=~F.col("_held"), under_on=F.col("_c") < F.col(on), under_off=F.col("_c") < F.col(off),
        risk_stop=flag(risk_stop), neutral_exit=flag(neutral_exit), convex=mode == "TRADE_CONVEX",
    )
    why = F.when(~F.col("_live"), F.col("_why"))
    for reason, applies in REASONS:
        why = why.when(applies(x), reason)
    d = d.withColumn("_why", why).withColumn("_on", F.col("_why").startswith("active"))
    size = base * F.when(F.col("_why") == "active_convex", 2.0).otherwise(1.0) * (1 - F.exp(-F.col("_age") / ramp)) * F.col("_c")
    d = d.withColumn("_size", F.when(F.col("_on"), F.least(F.lit(1.0), size)).otherwise(0.0))
    holds = F.col("_why").isin(*HOLDING)
    thesis = F.when(~F.col("_live") | holds, None).otherwise(F.when(F.col("_size") > 0, F.col("_s")).otherwise(0))
    d = d.withColumn("_thesis", F.coalesce(F.last(thesis, ignorenulls=True).over(before), F.lit(0)))
    urgency = F.when(F.col("_on"), F.least(F.lit(1.0), (0.3 + 0.1 * F.col("_age")) * F.col("_c")))
    for value in sorted(set(URGENCY.values())):
        urgency = urgency.when(F.col("_why").isin(*[k for k, v in URGENCY.items() if v == value]), value)
    urgency = urgency.otherwise(0.0)
    out = d.withColumns({
        "direction": F.when(holds, F.col("_thesis")).when(F.col("_on"), F.col("_s")).otherwise(0).cast("int"), "target": F.col("_size"), "urgency": urgency, "holds": holds,
        "actionability": F.when(F.col("_live"), F.col("_c")).otherwise(0.0), "reason": F.col("_why"),
    })
    return out.drop("_s", "_c", "_why", "_live", "_last", "_n", "_age", "_settles", "_held", "_on", "_size", "_thesis")


def executed(df: DataFrame, price: str = "price", direction: str = "direction", target: str = "target", holds: str = "holds", least: float = 0.02, fee: float = 0.0005, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """exposure_out, filled, equity: intents filled by a dead-band follower and marked to market."""

    def step(state, row):
        exposure, equity, last = state
        p = row[price]
        if last and p:
            equity *= 1 + exposure * (p / last - 1)
        move = 0.0 if row[holds] else row[target] * row[direction] - exposure
        move = move if abs(move) >= least else 0.0
        return (exposure + move, equity - abs(move) * fee, p or last), (exposure + move, move, equity - abs(move) * fee)

    return fold(df, lambda: (0.0, 1.0, None), step, "exposure_out double,filled double,equity double", keys)


def run_strategy(df: DataFrame, price: str = "price", keys: tuple[str, ...] = ("symbol",), least: float = 0.02, fee: float = 0.0005, grid: dict[str, list[float]] | None = None, carry: list[str] | None = None, **options) -> DataFrame:
    """A bar log: intents and what comes of them, for each symbol and point of a grid; options are those of intents.

    carry: columns of df that the log has beside its own, keys, times and prices; all of them by default.
    """
    found = intents(df, keys=tuple(k for k in keys if k != "symbol"), grid=grid, **options)
    every = (*keys, *(grid or {}))
    if carry is not None:
        found = found.select(*dict.fromkeys([*every, "ts", "seq", price, *carry]), "direction", "target", "urgency", "holds", "actionability", "reason")
    return executed(found, price, least=least, fee=fee, keys=every)


def trade_ledger(df: DataFrame, held: str = "held", price: str = "price", realized: str = "realized") -> DataFrame:
    """symbol, trade, side, entry_seq, exit_seq, rows, most, entry_price, exit_price, gain, close_reason: one row for each run
    of positions on one side; it ends by closing, by a flip to the other side, or is open at the end of the tape."""
    w = tape()
    sided = df.withColumn("_side", F.signum(held).cast("int")).withColumns({"_next": F.lead(F.signum(held).cast("int")).over(w), "_next_price": F.lead(price).over(w), "_next_seq": F.lead("seq").over(w), "_gain": F.lead(realized).over(w), "_had": F.coalesce(F.lag(realized).over(w), F.lit(0.0))})
    at = F.struct("ts", "seq")
    runs = islands(sided, "_side", "trade").where("_side <> 0").groupBy("symbol", "trade").agg(
        F.first("_side").alias("side"), F.min("seq").alias("entry_seq"), F.max_by("_next_seq", at).alias("exit_seq"), F.count("*").alias("rows"), F.max(F.abs(held)).alias("most"), F.min_by(price, at).alias("entry_price"),
        F.max_by("_next_price", at).alias("exit_price"), (F.max_by(F.coalesce("_gain", realized), at) - F.min_by("_had", at)).alias("gain"), F.max_by(F.when(F.col("_next").isNull(), "open").when(F.col("_next") == 0, "close").otherwise("flip"), at).alias("close_reason"),
    )
    return runs.withColumn("trade", F.row_number().over(Window.partitionBy("symbol").orderBy("trade")))
