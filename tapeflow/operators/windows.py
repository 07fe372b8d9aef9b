"""Window operators over tapes: rows of one symbol in the order of (ts, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "symbol", ("ts", "seq")


def tape(*more: str) -> WindowSpec:
    return Window.partitionBy(KEY, *more).orderBy(*ORDER)


def next_known(value: Column, *more: str) -> Column:
    """The first non-null value from this row on; read backwards, as a frame that ends with the tape costs its square."""
    back = Window.partitionBy(KEY, *more).orderBy(*[F.desc(c) for c in ORDER])
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def trailing(n: int, end: int = 0) -> WindowSpec:
    """The n rows that end `end` rows from the current one."""
    return tape().rowsBetween(end - n + 1, end)


def range_block(df: DataFrame, column: str, blocks: int | None = None) -> Column:
    """The number of a value's range, of about equally many rows each (by default one for each shuffle partition, 64 to 512).

    The limits are found once, by a pass of their own, and are literals of the column, so every use of it deals rows alike, however a
    plan places or merges its partitions.  Equal values share a range; nulls have none.
    """
    if blocks is None:
        blocks = min(512, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = dict(df.dtypes)[column]
    value = F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(column) if kind == "date" else F.col(column)
    limits = sorted(set(df.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] or []))
    if not limits:
        return F.when(value.isNotNull(), 0)
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < value)))


def pieces(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """df with _key, a symbol's text that is never null, and _c, the range of times of a row: pieces of tapes, which follow one another."""
    return df.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(KEY).cast("string")), F.lit("")), "_c": F.coalesce(range_block(df, "ts", blocks), F.lit(-1))})


def piece() -> WindowSpec:
    return Window.partitionBy("_key", "_c").orderBy(*ORDER)


def with_before(df: DataFrame) -> DataFrame:
    """df, cut to pieces, and for each piece the row before its first one once more, with _halo true."""
    ends = df.groupBy("_key", "_c").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("_key", "_c")]), F.struct(*ORDER)).alias("_e"))
    later = ends.withColumn("_c", F.lead("_c").over(Window.partitionBy("_key").orderBy("_c"))).where("_c IS NOT NULL")
    return df.withColumn("_halo", F.lit(False)).unionByName(later.select("_key", "_c", "_e.*", F.lit(True).alias("_halo")))


def running(df: DataFrame, column: str, sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """Adds running sums in the order of a column over the whole of df, as columns of the dict's names.

    A prefix scan in two passes over the ranges of range_block: sums of whole ranges meet in one window, of a row for each range;
    rows are sorted within their own range only.  Rows of one value, which share a range, all have the sum up to the last of them.
    """
    held = df.withColumns({"_b": range_block(df, column, blocks)} | {f"_s{k}": v for k, v in sums.items()})
    totals = held.groupBy("_b").agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in sums])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_b").alias("_ob"), *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in sums])
    inside = Window.partitionBy("_b").orderBy(column)
    out = held.join(F.broadcast(offsets), F.col("_b").eqNullSafe(F.col("_ob"))).drop("_ob")
    return out.withColumns({k: F.sum(f"_s{k}").over(inside) + F.col(f"_o{k}") for k in sums}).drop("_b", *[f"_{x}{k}" for k in sums for x in "so"])


def returns(price: str = "price", log: bool = False) -> Column:
    before = F.lag(price).over(tape())
    return F.log(F.col(price)) - F.log(before) if log else F.try_divide(F.col(price), before) - 1


def full(value: Column, column: str, n: int) -> Column:
    """value where the trailing n rows all hold the column, else null."""
    return F.when(F.count(column).over(trailing(n)) == n, value)


def islands(df: DataFrame, value: str, out: str = "island") -> DataFrame:
    """Numbers the runs of equal values of each symbol."""
    change = (~F.col(value).eqNullSafe(F.lag(value).over(tape())) | (F.row_number().over(tape()) == 1)).cast("int")
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(tape().rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def run_length(df: DataFrame, state: str = "state", out: str = "run") -> DataFrame:
    """Rows of the current run of equal non-zero states up to here; 0 in runs of zero."""
    w = tape()
    changed = df.withColumn("_at", F.row_number().over(w)).withColumn("_from", F.when(~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.col("_at") == 1), F.col("_at")))
    # by the row of the last change, in the tape's own order: a window for each run would sort the tape once more
    at = F.col("_at") - F.last("_from", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return changed.withColumn(out, F.when(F.coalesce(F.col(state).cast("int"), F.lit(0)) == 0, 0).otherwise(at)).drop("_at", "_from")


def flip_rate(df: DataFrame, state: str = "state", window: int = 50, out: str = "flip_rate", lagged: bool = False) -> DataFrame:
    """Share of changes in the trailing window; lagged leaves the current row's change out."""
    before = F.lag(state).over(tape())
    flips = df.withColumn("_flip", (before.isNotNull() & (F.col(state) != before)).cast("int")).withColumn("_at", F.row_number().over(tape()) - 1)
    frame = tape().rowsBetween(-window + 1, -1) if lagged else tape().rowsBetween(-window + 2, 0)
    n = F.sum("_flip").over(frame) if window > 1 else F.lit(0)
    span = F.greatest(F.lit(1), F.least(F.col("_at"), F.lit(window - 1)))
    return flips.withColumn(out, F.coalesce(n, F.lit(0)) / span).drop("_flip", "_at")


def acceptability(df: DataFrame, min_run: int = 3, max_flip_rate: float | None = None, max_vol: float | None = None, vol: str = "vol", window: int = 50, state: str = "state") -> DataFrame:
    """Adds run, flip_rate and acceptable: a long run or few flips, and low volatility if asked; unknown volatility isn't."""
    found = flip_rate(run_length(df, state), state, window)
    stable = F.col("run") >= min_run
    if max_flip_rate is not None:
        stable = stable | (F.col("flip_rate") <= max_flip_rate)
    if max_vol is not None:
        stable = stable & F.coalesce(~F.isnan(vol) & (F.col(vol) <= max_vol), F.lit(False))
    return found.withColumn("acceptable", stable)


def legitimacy_margin(df: DataFrame, min_run: int = 3, max_flip_rate: float | None = None, max_vol: float | None = None, window: int = 50, price: str = "price", out: str = "margin") -> DataFrame:
    """Signed distance to the nearest violated bound."""
    found = flip_rate(run_length(df), "state", window, lagged=True)
    terms = [(F.col("run") - min_run).cast("double")]
    if max_flip_rate is not None:
        terms.append(F.lit(max_flip_rate) - F.col("flip_rate"))
    if max_vol is not None:
        found = found.withColumn("_d", F.coalesce(F.col(price) - F.lag(price).over(tape()), F.lit(0.0)))
        terms.append(F.lit(max_vol) - full(F.stddev_samp("_d").over(trailing(window)), "_d", window))
    return found.withColumn(out, F.least(*terms) if len(terms) > 1 else terms[0]).drop("_d")


def rolling(df: DataFrame, column: str, n: int, out: str, how: str = "std") -> DataFrame:
    """Trailing std (ddof 1), pstd (ddof 0), mean, sum or max over n rows, null until n values are there."""
    f = {"std": F.stddev_samp, "pstd": F.stddev_pop, "mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return df.withColumn(out, full(f(column).over(trailing(n)), column, n))


def drawdown(df: DataFrame, column: str, out: str = "drawdown") -> DataFrame:
    return df.withColumn(out, F.col(column) - F.max(column).over(tape().rowsBetween(Window.unboundedPreceding, 0)))


def first_exit(df: DataFrame, good: str = "acceptable", out: str = "exit_in") -> DataFrame:
    """Rows until the next one that isn't good (0 for such a row itself), null if none comes."""
    at = F.row_number().over(tape())
    numbered = df.withColumn("_at", at)
    bad = numbered.withColumn("_bad", F.when(~F.col(good), F.col("_at")))
    return bad.withColumn(out, next_known(F.col("_bad")) - F.col("_at")).drop("_at", "_bad")


def since_last(df: DataFrame, happened: Column, out: str) -> DataFrame:
    """Rows since the last one where `happened` was true, null before the first."""
    numbered = df.withColumn("_at", F.row_number().over(tape())).withColumn("_hit", F.when(happened, F.col("_at")))
    return numbered.withColumn(out, F.col("_at") - F.last("_hit", ignorenulls=True).over(tape().rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_hit")


def second_difference(df: DataFrame, column: str, out: str = "curvature") -> DataFrame:
    w = tape()
    return df.withColumn(out, F.lead(column).over(w) - 2 * F.col(column) + F.lag(column).over(w))


def latest(df: DataFrame, *keys: str, order: tuple[str, ...] = ORDER, n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, score: str, n: int, tie: str, *keys: str) -> DataFrame:
    """The n rows of each key with the greatest scores, and their rank; of equal scores the least `tie`."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def numbered(df: DataFrame, out: str = "_n") -> DataFrame:
    """df, cut to pieces, with the number of a row in its whole tape, from 0."""
    own = df.withColumn(out, F.row_number().over(piece()) - 1)
    before = Window.partitionBy("_key").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_key", "_c").agg(F.count("*").alias("_all")).select("_key", "_c", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_o"))
    return own.join(sizes, ["_key", "_c"]).withColumn(out, F.col(out) + F.col("_o")).drop("_o")


def structural_stress(df: DataFrame, window: int = 100, vol_z: float = 1.5, flips: float = 0.4, price: str = "price", state: str = "state", stretch: int = 200) -> DataFrame:
    """Adds p_stress and stressed: volatility against its median and MAD over the symbol's whole tape, jumps, and flips.

    The first `window` volatilities are filled from the first full one; the first row counts as a flip.  No tape has to fit into a
    task: it is cut to stretches of `stretch` windows by number, each with what its frames reach back to from the one before.
    """
    from .quantiles import matched, median

    size, key = window * stretch, ("_key", "_part")
    w = Window.partitionBy(*key).orderBy("_n")
    rows = numbered(df if "_c" in df.columns else pieces(df)).withColumn("_part", F.floor(F.col("_n") / size))
    also = F.when(F.col("_n") % size >= size - window - 1, F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part"))
    # a number of partitions, as adaptive plans would merge them up to sizes at which the sorts below take most memory
    rows = rows.withColumn("_part", F.explode(also)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    before = F.lag(state).over(w)
    flip = (~F.col(state).eqNullSafe(before) | (F.col("_n") == 0)).cast("double")
    out = rows.withColumns({"_r": F.coalesce(F.try_divide(F.col(price), F.lag(price).over(w)) - 1, F.lit(0.0)), "_flip": flip})
    out = block_frames(out, window, "_n", {"_t": F.col("_r"), "_q": F.col("_r") * F.col("_r"), "_fs": F.col("_flip")}, keys=key, order=("_n",))
    ready = F.col("_n") >= window - 1
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("_t") * F.col("_t") / window, F.lit(0.0)) / (window - 1))
    out = out.withColumns({"_v": F.when(ready, spread), "_f": F.when(ready, F.col("_fs") / window).otherwise(0.0)})
    # the first full volatility lies in the first stretch, as all rows that take it
    back = Window.partitionBy(*key).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_v", F.coalesce("_v", F.last("_v", ignorenulls=True).over(back), F.lit(0.0)))
    out = out.where(F.col("_n") >= F.col("_part") * size).drop("_part", "_flip", "_fs", "_n", "_t", "_q")
    out = matched(out, median(out, ["_key"], "_v", "_m"), ["_key"], spread=list(ORDER))
    out = matched(out, median(out, ["_key"], F.abs(F.col("_v") - F.col("_m")), "_mad"), ["_key"], spread=list(ORDER)).withColumn("_mad", F.col("_mad") + 1e-9)
    score = F.greatest((F.col("_v") - F.col("_m")) / F.col("_mad") / vol_z, F.lit(0.0)) + F.abs("_r") / (F.col("_v") + 1e-9) + F.col("_f") / flips
    out = out.withColumn("p_stress", score / (1 + score)).withColumn("stressed", F.col("p_stress") > 0.7)
    return out.select(*df.columns, "p_stress", "stressed")


def block_frames(df: DataFrame, n: int, number: str, sums: dict[str, Column], lows: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, fall: Column | None = None, keys: tuple[str, ...] = (KEY,), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds sums, minima and maxima over the trailing n rows, as columns of the dicts' names; right where n rows are there.

    With fall, the column `fall` is the largest drop from a row of the frame to a later one.  Tapes are cut into blocks of n
    rows (number: the row's number in its tape, from 0); a frame is the end of one block and the start of the next, so what
    grows from a block's start and what grows from its end makes up every frame, at a cost that doesn't depend on n.
    """
    from functools import reduce

    w = Window.partitionBy(*keys).orderBy(*order)
    held = df.withColumn("_b", F.floor(F.col(number) / n))
    key = Window.partitionBy(*keys, "_b")
    up = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = key.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    parts = [(k, c, F.sum, lambda a, b: a + b) for k, c in sums.items()] + [(k, c, F.min, F.least) for k, c in (lows or {}).items()] + [(k, c, F.max, F.greatest) for k, c in (highs or {}).items()]
    if fall is not None:
        parts += [("_most", fall, F.max, F.greatest), ("_least", fall, F.min, F.least)]
    held = held.withColumns({f"_x{k}": c for k, c, *_ in parts})
    held = held.withColumns({f"_u{k}": f(f"_x{k}").over(up) for k, _, f, _ in parts})
    if fall is not None:
        held = held.withColumn("_ufall", F.max(F.col("_u_most") - F.col("_x_most")).over(up))
    held = held.withColumns({f"_d{k}": f(f"_x{k}").over(down) for k, _, f, _ in parts})
    if fall is not None:
        held = held.withColumn("_dfall", F.max(F.col("_x_most") - F.col("_d_least")).over(down))
    whole = F.col(number) % n == n - 1
    before = lambda c: F.lag(c, n - 1).over(w)
    out = {k: F.when(whole, F.col(f"_u{k}")).otherwise(join(before(f"_d{k}"), F.col(f"_u{k}"))) for k, _, _, join in parts if not k.startswith("_most") and not k.startswith("_least")}
    if fall is not None:
        out["fall"] = F.when(whole, F.col("_ufall")).otherwise(reduce(F.greatest, [before("_dfall"), F.col("_ufall"), before("_d_most") - F.col("_u_least")]))
    names = [k for k, *_ in parts]
    return held.withColumns(out).drop("_b", "_ufall", "_dfall", *[f"_{x}{k}" for k in names for x in "xud"])
