"""Joins of tapes: as-of, range, lagged pairs, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.operators.cells import earlier_alike, nearest_rows
from tapeflow.operators.windows import running


def asof(left: DataFrame, right: DataFrame, on: str = "ts", by: tuple[str, ...] = ("symbol",), values: tuple[str, ...] = (), tolerance: Column | None = None, at: str = "right_ts", tie: str | None = None) -> DataFrame:
    """left with the values of the last right row at or before it (of equal times the greatest `tie`), null beyond tolerance.

    Both sides are united and one window carries the last right row on: one shuffle by key and one sort, and no pair of
    rows is ever formed.  tolerance: an interval Column for how old a right row may be.
    """
    keys = list(by)
    names = left.columns
    one = left.select(F.struct(*names).alias("_l"), F.lit(None).alias("_r"), *keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"))
    packed = F.struct(F.col(on).alias(at), *values)
    two = right.where(F.col(on).isNotNull()).select(F.lit(None).alias("_l"), packed.alias("_r"), *keys, F.col(on).alias("_on"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None)).alias("_tie"))
    w = Window.partitionBy(*keys).orderBy("_on", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = one.unionByName(two).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    out = found.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in (at, *values)])
    if tolerance is not None:
        fresh = F.col(on) - F.col(at) <= tolerance
        out = out.select(*names, *[F.when(fresh, F.col(c)).alias(c) for c in (at, *values)])
    return out


def asof_group(left: DataFrame, groups: DataFrame, on: str, by: tuple[str, ...], max_age: Column) -> DataFrame:
    """left joined with all rows of the last group (rows of one time) at or before it that isn't older than max_age."""
    times = groups.select(*by, on).distinct()
    found = asof(left, times, on, by, (), max_age, "snap_ts").where("snap_ts IS NOT NULL")
    return found.join(groups.withColumnRenamed(on, "snap_ts"), [*by, "snap_ts"])


def fallback(real: DataFrame, synthetic: DataFrame, keys: list[str]) -> DataFrame:
    """Real rows, and synthetic ones, marked filled, where no real row has the keys."""
    return real.withColumn("filled", F.lit(False)).unionByName(synthetic.join(real.select(*keys).distinct(), keys, "left_anti").withColumn("filled", F.lit(True)))


def cross_lag_pairs(summaries: DataFrame, max_lag: int, window: str = "window_index", value: str = "value", targets: list | None = None, sources: list | None = None) -> DataFrame:
    """Pairs of summaries whose window numbers differ by 1 .. max_lag: an equi-join on the shifted number.

    All ordered pairs of symbols come out; sources and targets, lists of symbols, choose some.
    """
    chosen = lambda names: F.lit(True) if names is None else F.col("symbol").isin(names)
    late = summaries.where(chosen(targets)).select(F.col("symbol").alias("target"), F.col(window).alias("at"), F.col(value).alias("target_value"))
    early = summaries.where(chosen(sources)).select(F.col("symbol").alias("source"), F.col(window).alias("source_at"), F.col(value).alias("source_value"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")).withColumn("at", F.col("source_at") + F.col("lag"))
    return late.join(early, "at").select("target", "source", "at", "lag", (F.col("target_value") - F.col("source_value")).alias("delta"), (F.col("target_value") * F.col("source_value")).alias("product"))


def aligned(df: DataFrame, value: str, on: str = "ts") -> DataFrame:
    """on, symbol, value: one row for each symbol, at the times at which all symbols of df have a value."""
    rows = df.where(F.col("symbol").isNotNull())
    one = rows.groupBy(on, "symbol").agg(F.first(value).alias(value)).na.drop(subset=[value])
    every = rows.agg(F.countDistinct("symbol")).first()[0]
    return one.join(one.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") == every).select(on), on, "left_semi")


def lagged_correlations(df: DataFrame, value: str, lags: list[int], on: str = "ts", blocks: int | None = None, targets: list | None = None, sources: list | None = None) -> DataFrame:
    """target, source, lag, n, score: correlation of target with source `lag` rows before on the aligned grid.

    Rows of the grid are numbered by a prefix scan over ranges of times, so numbering needs no single task; the lag is then
    an equi-join on numbers.  All ordered pairs of symbols come out; sources and targets, lists of symbols, choose some.
    """
    grid = aligned(df, value, on)
    numbered = running(grid.select(on).distinct(), on, {"_i": F.lit(1)}, blocks)
    long = grid.join(numbered.select(on, "_i"), on).select("_i", F.col("symbol").alias("name"), F.col(value).alias("v"))
    chosen = lambda names: F.lit(True) if names is None else F.col("name").isin(names)
    source = long.where(chosen(sources)).select(F.col("name").alias("source"), F.col("v").alias("sv"), F.col("_i").alias("_j"), F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag")).withColumn("_i", F.col("_j") + F.col("lag"))
    pairs = long.where(chosen(targets)).select(F.col("name").alias("target"), F.col("v").alias("tv"), "_i").join(source, "_i").where("target <> source")
    return pairs.groupBy("target", "source", "lag").agg(F.count("*").alias("n"), F.corr("tv", "sv").alias("score"))


def nearest(left: DataFrame, right: DataFrame, features: list[str], k: int, id_column: str = "id", block: int = 2000) -> DataFrame:
    """left_id, right_id, distance, rank: the k nearest right rows of each left row, which is the stated query set.

    Right rows are dealt to cells of pivots; a left row meets only the cells that can hold one of its k nearest
    (cells.nearest_rows).  Rows with an unknown feature take no part.
    """
    side = lambda df: df.na.drop(subset=[id_column, *features]).select(F.col(id_column).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    return nearest_rows(side(left), side(right), k, block)


def z_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; 0 where that is 0."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def dyadic_cover(first: Column, last: Column) -> Column:
    """An array of (level, node): the fewest ranges of 2^level numbers from node * 2^level on that make up first .. last."""

    def nodes(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k)  # from low to before high at this level
        some = low < high
        return F.array(
            F.when(some & (F.call_function("bit_get", low, F.lit(0)) == 1), F.struct(k.alias("level"), low.alias("node"))),
            F.when(some & (F.call_function("bit_get", high, F.lit(0)) == 1), F.struct(k.alias("level"), (high - 1).alias("node"))),
        )

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), nodes)), lambda x: x.isNotNull())


def in_windows(windows: DataFrame, events: DataFrame, bucket_s: int, start: str = "start", end: str = "end", ts: str = "ts") -> DataFrame:
    """Window rows with the events from start to end, both included, by equi-joins on time buckets, then the bounds.

    Windows of any length: a window of n buckets is at most 2 log n dyadic ranges of them, and an event has a copy for
    each level of range that some window uses.
    """
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_s)
    cover = windows.withColumn("_at", F.explode(dyadic_cover(number(start), number(end))))
    levels = sorted(r[0] for r in cover.select("_at.level").distinct().collect())  # 63 at most
    copies = events.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_node", F.call_function("shiftright", number(ts), F.col("_level")))
    held = cover.withColumns({"_level": F.col("_at.level"), "_node": F.col("_at.node")}).drop("_at")
    return held.join(copies, ["_level", "_node"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("_level", "_node")


def recurrence(df: DataFrame, vector: str, least: float, id_column: str, block: int = 2000, top: int = 3) -> DataFrame:
    """id, n_earlier, links: earlier rows whose cosine similarity exceeds `least`, and the top of them.

    Rows are dealt to cells of pivots by angle and to ranges of ids; a row meets the cells that its angle reaches and no
    later ids (cells.earlier_alike).
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    found = earlier_alike(rows, least, top, block)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    links = F.array_sort(F.collect_list(F.when((F.col("rank") <= top) & (F.col("other") >= 0), F.struct("rank", "other"))))
    met = ranked.groupBy("id").agg(F.sum("n").alias("n_earlier"), links.alias("l")).select("id", "n_earlier", F.transform("l", lambda x: x["other"]).alias("links"))
    # a row that meets no cell has no links
    return rows.select("id").join(met, "id", "left").select("id", F.coalesce("n_earlier", F.lit(0)).alias("n_earlier"), F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))
