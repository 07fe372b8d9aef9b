"""Exact quantiles of any number of groups, of which none has to fit into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks that the rows of one key are dealt to where they meet the key's figures.
SPREAD = 16


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: list[str] | None = None) -> DataFrame:
    """left joined with right, which has a row at most for each value of the keys; nulls are equal.

    spread: columns of left by which the rows of one key are dealt to several tasks, of which each gets the key's row of right.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    if spread:
        left = left.withColumn("_spread", F.pmod(F.xxhash64(*spread), F.lit(SPREAD)))
        right = right.withColumn("_spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
        return matched(left, right, [*keys, "_spread"], how).drop("_spread")
    own = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(own, reduce(lambda a, b: a & b, same), how).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: Column | str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """keys and, by name, the quantile at each share between 0 and 1, of the group's known values, interpolated between rows.

    Two passes over df, both with sums on the map side, so that a large group is spread over all tasks: sketches of all groups give
    limits between which each rank lies for certain; then rows are counted, by value within those limits and in a lump
    outside of them.  What a task puts in order is the distinct values within the limits, some 8/accuracy of a group for
    each share, and groups of up to `accuracy` rows whole.  Groups without a known value have no row.
    """
    known = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, known.cast("double").alias("_v")).where("_v IS NOT NULL")
    margin = 4 / accuracy
    low, high = [q - margin for q in shares.values()], [q + margin for q in shares.values()]
    asked = F.array(*[F.lit(min(1.0, max(0.0, q))) for q in low + high])
    sketch = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", asked, accuracy).alias("_a"))
    v = F.col("_v")
    # beyond the ends there is no limit, so least and largest values, infinities and NaN are always inside
    over = [F.lit(True) if q <= 0 else v >= F.get("_a", F.lit(i)) for i, q in enumerate(low)]
    under = [F.lit(True) if q >= 1 else v <= F.get("_a", F.lit(len(low) + i)) for i, q in enumerate(high)]
    whole = F.col("_n") <= accuracy  # in a small group the sketch's limits are less than a row apart
    inside = whole | reduce(lambda a, b: a | b, [a & b for a, b in zip(over, under, strict=True)])
    block = F.when(whole, 0).otherwise(reduce(lambda a, b: a + b, [x.cast("int") for x in over]))
    counted = matched(base, sketch, keys, spread=["_v"]).select(*keys, "_n", block.alias("_b"), F.when(inside, v).alias("_v")).groupBy(*keys, "_n", "_b", "_v").agg(F.count("*").alias("_c"))
    # what is outside lies above all that is inside and has as many lower limits below it
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)

    rank = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in shares.items()}
    here = {f"_{x}{name}": (F.col("_upto") - F.col("_c") <= f(r)) & (f(r) < F.col("_upto")) for name, r in rank.items() for x, f in (("l", F.floor), ("h", F.ceil))}
    lost = F.bool_or(F.col("_v").isNull() & reduce(lambda a, b: a | b, here.values()))
    found = placed.groupBy(*keys, "_n").agg(lost.alias("_lost"), *[F.max(F.when(c, F.col("_v"))).alias(x) for x, c in here.items()])
    # the sketches' bounds leave no such row; an error rather than a wrong value if they ever did
    found = found.where(F.when(F.col("_lost"), F.raise_error(F.lit("a quantile's rank lies outside of its sketch's limits")).cast("boolean")).otherwise(F.lit(True)))

    def between(name: str) -> Column:
        a, b, r = F.col(f"_l{name}"), F.col(f"_h{name}"), rank[name]
        return F.when(a == b, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b).alias(name)

    return found.select(*keys, *[between(name) for name in shares])


def median(df: DataFrame, keys: list[str], value: Column | str, out: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})
