"""Scalar expressions as Columns; none needs Python at run time."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """x as a double, null for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def seconds(x: Column) -> Column:
    """Epoch seconds from a number in seconds, milliseconds or nanoseconds, told by its size."""
    x = x.cast("double")
    return F.when(x > 1e14, x / 1e9).when(x > 1e11, x / 1e3).otherwise(x)


def milliseconds(x: Column) -> Column:
    """Epoch milliseconds from a number in nanoseconds (over 1e14), milliseconds (1e11) or seconds (1e9), else null."""
    x = x.cast("double")
    return F.when(x > 1e14, F.floor(x / 1e6)).when(x > 1e11, F.floor(x)).when(x > 1e9, F.floor(x * 1e3)).cast("long")


def safe_float(x: Column) -> Column:
    return finite(F.expr("try_cast({} AS DOUBLE)".format(x)) if isinstance(x, str) else x.try_cast("double"))


def safe_int(x: Column) -> Column:
    return x.try_cast("double").try_cast("int")


def safe_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y", "on", "t"), F.lit(False))


def first_present(*xs: Column) -> Column:
    return F.coalesce(*xs)


def ternary_sign(x: Column, tau: float = 0.0) -> Column:
    return F.when(x > tau, 1).when(x < -tau, -1).otherwise(0)


def permission(p_bad: Column, caution: float = 0.4, ban: float = 0.7) -> Column:
    return F.when(p_bad >= ban, -1).when(p_bad >= caution, 0).otherwise(1)


def actionability(allowed: Column, p_bad: Column) -> Column:
    """1 where permitted, a half where suspended, and what is left of 1 less p_bad where prohibited."""
    return F.when(allowed == 1, 1.0).when(allowed == 0, 0.5).otherwise(clip(1 - p_bad, 0.0, 1.0))


def decision_kind(allowed: Column, direction: Column, edge: Column, action: Column, veto: Column, leaving: Column) -> Column:
    """flat for a veto, a prohibition or an exit; long or short where permitted and direction and edge agree; else unknown."""
    agrees = (allowed == 1) & (direction != 0) & (direction == edge)
    return F.when(veto | leaving | (allowed == -1), "flat").when(agrees & (action > 0), "long").when(agrees & (action < 0), "short").otherwise("unknown")


def phase_class(rho: Column, robust: Column) -> Column:
    """false without an edge over cost, else boundary-stable or boundary-unstable."""
    return F.when(rho <= 0, "false").when(robust, "boundary-stable").otherwise("boundary-unstable")


#: Weights of z-scored traits in the utilities of the instruments (option, perp, spot), those of the query below; any may be given.
UTILITY = {
    "option": {"iv": 0.5, "hazard": 0.4, "funding_abs": 0.3, "basis": 0.2, "option_oi": 0.1, "option_volume": 0.1, "imbalance": 0.1, "margin": 0.2},
    "perp": {"confidence": 0.6, "carry": 0.4, "open_interest": 0.2, "iv": -0.2, "hazard": -0.3, "margin": 0.2},
    "spot": {"funding_abs": -0.2, "basis": -0.2, "hazard": -0.2},
}


def utilities(traits: dict[str, Column], weights: dict[str, dict[str, float]] = UTILITY, spot_base: float = 0.1) -> dict[str, Column]:
    """Utility of each instrument: weighted traits that are given, others count nothing; spot starts from its base."""
    total = lambda own: functools.reduce(lambda a, b: a + b, [F.lit(w) * traits[t] for t, w in own.items() if t in traits], F.lit(0.0))
    return {name: total(own) + (spot_base if name == "spot" else 0.0) for name, own in weights.items()}


def controller(direction: Column, edge: Column, allowed: Column, pressure: Column) -> Column:
    """The direction if it is allowed, agrees with the edge, and capital isn't short."""
    stop = (allowed != 1) | ((pressure == -1) & (allowed != 1)) | (direction == 0) | (edge == 0) | (direction != edge)
    return F.when(stop, 0).otherwise(direction)


def clip_ternary(x: Column) -> Column:
    return F.when(x >= 1, 1).when(x <= -1, -1).otherwise(0)


def abc_posture(a: Column, b: Column, c: Column) -> Column:
    """-1 unwind, 0 observe, 1 trade, 2 trade convex, from expressibility, constraints and integrity."""
    broken = F.when((a == 1) & (b == 1), 2).otherwise(-1)
    return F.when(c == -1, broken).when(a <= 0, 0).when((c >= 0) & (a == 1) & (b == 1), 2).when((c >= 0) & (a == 1) & (b == 0), 1).otherwise(0)


def score_to_planes(score: Column, threshold: float = 0.1) -> Column:
    """struct(p, n): (1, 0) up, (0, 1) down, (0, 0) flat, (1, 1) void for null, NaN and infinities."""
    s = finite(score)
    return F.struct(F.when(s.isNull() | (s >= threshold), 1).otherwise(0).alias("p"), F.when(s.isNull() | (s <= -threshold), 1).otherwise(0).alias("n"))


def planes_symbol(planes: Column) -> Column:
    return F.when((planes["p"] == 1) & (planes["n"] == 1), "⊥").when(planes["p"] == 1, "+1").when(planes["n"] == 1, "-1").otherwise("0")


def trit(planes: Column) -> Column:
    """-1, 0, 1, null for void."""
    return F.when((planes["p"] == 1) & (planes["n"] == 1), None).otherwise(planes["p"] - planes["n"])


def planes_of(t: Column) -> Column:
    return F.struct((t.isNull() | (t == 1)).cast("int").alias("p"), (t.isNull() | (t == -1)).cast("int").alias("n"))


def gf3_add(a: Column, b: Column) -> Column:
    """Sum of two plane pairs modulo 3; void absorbs."""
    total = trit(a) + trit(b)
    return planes_of(F.pmod(total + 1, F.lit(3)) - 1)


def gf3_rotate(a: Column) -> Column:
    return gf3_add(a, F.struct(F.lit(1).alias("p"), F.lit(0).alias("n")))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def norm_cdf(x: Column) -> Column:
    """By a rational approximation of the error function (absolute error under 1.5e-7)."""
    z = F.abs(x) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * z)
    # Coefficients of the approximation, from the highest power down.
    poly = functools.reduce(lambda acc, c: acc * t + F.lit(c), [-1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(1.061405429)) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function, by Newton steps from a logistic start; null outside of (0, 1)."""
    start = F.log(p / (1 - p)) / 1.702
    step = lambda x, _: clip(x - (norm_cdf(x) - p) / F.greatest(norm_pdf(x), F.lit(1e-12)), -8.0, 8.0)
    return F.when((p > 0) & (p < 1), F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: list[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*xs)
    e = [F.exp((x - top) / temperature) for x in xs]
    total = functools.reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def nearest_target(x: Column, targets: list[float]) -> Column:
    """Number of the nearest target, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(x - t).alias("d"), F.lit(i).alias("i")) for i, t in enumerate(targets)]))["i"]


def first_cutoff(x: Column, cutoffs: list[float]) -> Column:
    """Number of the first cutoff above x, their number if there is none."""
    out = F.lit(len(cutoffs))
    for i in range(len(cutoffs) - 1, -1, -1):
        out = F.when(x < cutoffs[i], i).otherwise(out)
    return out


def ell_bin(ell: Column, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(ell * bins + F.lit(1e-12)))).cast("int")


def transition_score(reward: Column, penalty: Column, mode: str, scale: float = 1.0, eps: float = 1e-9) -> Column:
    if mode == "ratio":
        return reward / (penalty + eps)
    if mode == "scaled_diff":
        return F.tanh((reward - penalty) / scale)
    return sigmoid((reward - penalty) / scale)


def simplex(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Plane coordinates of three non-negative shares; null where they add up to 0."""
    total = a + b + c
    return F.when(total > 0, (b + c / 2) / total), F.when(total > 0, c * 0.8660254037844386 / total)


def any_keyword(text: Column, keywords: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(k.lower())) for k in keywords])


def black_scholes(price: Column, strike: Column, sigma: Column, tau: Column, call: Column) -> Column:
    """Zero-rate option value."""
    root = sigma * F.sqrt(tau)
    d1 = (F.log(price / strike) + sigma * sigma * tau / 2) / root
    d2 = d1 - root
    return F.when(call, price * norm_cdf(d1) - strike * norm_cdf(d2)).otherwise(strike * norm_cdf(-d2) - price * norm_cdf(-d1))


def normalised(weights: Column, low: float = 0.05, high: float = 0.8) -> Column:
    """An array of weights clamped and divided by their sum."""
    kept = F.transform(weights, lambda w: F.greatest(F.lit(low), F.least(F.lit(high), w)))
    return F.transform(kept, lambda w: w / F.aggregate(kept, F.lit(0.0), lambda a, x: a + x))


def boundary_gate(signal: Column, edge: Column, cost: Column, margin: float = 0.0) -> Column:
    """The signal, or 0 where its edge doesn't pay for cost and margin."""
    return F.when(signal * edge <= cost + margin, 0).otherwise(signal)


def predicted_edge(margin: Column, direction: Column, ell: Column, best: Column) -> Column:
    return F.coalesce(margin * direction, ell, best, F.lit(0.0))


def best_label(scores: dict[str, Column]) -> Column:
    """label, score and margin: the label of the greatest score (of equal ones the least) and its lead over the second."""
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("k"), F.lit(name).alias("label")) for name, c in scores.items()]))
    first, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    return F.struct(first["label"].alias("label"), (-first["k"]).alias("score"), (second["k"] - first["k"]).alias("margin"))
