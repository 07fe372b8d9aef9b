"""Bars: ticks to OHLCV, rollups of bars, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, every: str = "1 second", price: str = "price", qty: str = "qty") -> DataFrame:
    """One row for each symbol and time bucket that has ticks; open and close by (ts, seq)."""
    at = F.struct("ts", "seq")
    found = ticks.groupBy("symbol", F.window("ts", every).start.alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(qty).cast("long").alias("volume"), F.count("*").alias("trades")
    )
    return found.select("symbol", F.col("bucket").alias("ts"), F.lit(0).cast("long").alias("seq"), "open", "high", "low", "close", "volume", "trades")


def rollup(bars: DataFrame, every: str) -> DataFrame:
    """Longer bars from shorter ones, with range, signed return, realised volatility and direction persistence."""
    r = bars.withColumn("_r", F.log(F.try_divide("close", "open")))
    found = r.groupBy("symbol", F.window("ts", every).start.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"),
        F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("realised_vol"), F.abs(F.sum(F.signum("_r"))).alias("_s"), F.count("*").alias("bars"),
    )
    return found.select(
        "symbol", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume", "trades", (F.col("high") - F.col("low")).alias("range"), (F.try_divide("close", "open") - 1).alias("ret"),
        "realised_vol", (F.col("_s") / F.col("bars")).alias("persistence"), (F.col("bars") < 2).alias("unknown"),
    )


#: Buckets of a resampling grid that are made from one row.
_CHUNK = 4096


def resample(bars: DataFrame, every: str, fill: str = "ffill") -> DataFrame:
    """A row for every bucket between a symbol's first and last: the first bar in it, gaps filled from before or after."""
    first = bars.groupBy("symbol", F.window("ts", every).start.alias("bucket")).agg(F.min_by("close", F.struct("ts", "seq")).alias("close"), F.min_by("volume", F.struct("ts", "seq")).alias("volume"))
    span = first.groupBy("symbol").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    # The grid is made in chunks: no row ever holds more than a chunk of a symbol's buckets.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {every})")
    last = ((micros("b") - micros("a")) / step).cast("long")
    chunks = span.withColumn("n", last).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / _CHUNK))))
    numbers = F.sequence(F.col("c") * _CHUNK, F.least(F.col("n"), (F.col("c") + 1) * _CHUNK - 1))
    grid = chunks.withColumn("k", F.explode(numbers)).select("symbol", (F.col("a") + F.col("k") * F.expr(f"INTERVAL {every}")).alias("bucket"))
    w, back = (Window.partitionBy("symbol").orderBy(o) for o in (F.asc("bucket"), F.desc("bucket")))
    pick = (lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))) if fill == "ffill" else (lambda c: F.last(c, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return grid.join(first, ["symbol", "bucket"], "left").select("symbol", F.col("bucket").alias("ts"), pick("close").alias("close"), pick("volume").alias("volume")).where("close IS NOT NULL")
