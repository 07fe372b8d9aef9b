"""Option surfaces over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.scalar import black_scholes, clip

#: Days to expiry and log-moneyness of the grid.
TENORS = (7, 14, 30, 60, 90)
MONEYNESS = (-0.2, -0.1, 0.0, 0.1, 0.2)


def grid(df: DataFrame) -> DataFrame:
    """Every row for each tenor, moneyness, and call or put."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return df.withColumn("tenor", F.explode(arr(TENORS))).withColumn("mny", F.explode(arr(MONEYNESS))).withColumn("call", F.explode(arr((True, False))))


def synthetic_surface(bars: DataFrame, base: float = 0.6, k_vol: float = 0.5, k_burst: float = 0.1, spot: str = "close", vol_ratio: str = "vol_ratio", burst: str = "burstiness") -> DataFrame:
    """iv, strike and mid over the grid of each bar; ts_ms in milliseconds."""
    iv = clip(F.lit(base) + k_vol * F.greatest(F.col(vol_ratio), F.lit(0.0)) + k_burst * F.log1p(F.greatest(F.col(burst), F.lit(0.0))), 0.05, 3.0)
    rows = grid(bars.withColumn("iv", iv)).withColumn("strike", F.col(spot) * F.exp("mny"))
    mid = black_scholes(F.col(spot), F.col("strike"), F.col("iv"), F.col("tenor") / 365.0, F.col("call"))
    return rows.withColumns({"mid": mid, "ts_ms": F.unix_millis(F.col("ts").cast("timestamp"))})


def surface_problems(surface: DataFrame) -> DataFrame:
    """One row: rows, bad times, missing or negative prices, cells of the grid that never occur."""
    cells = len(TENORS) * len(MONEYNESS) * 2
    return surface.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("ts_ms").between(int(1e12), int(1e15))).alias("bad_times"), F.count_if(F.col("mid").isNull() | (F.col("mid") < -1e-6)).alias("bad_prices"),
        (F.lit(cells) - F.countDistinct("tenor", "mny", "call")).alias("missing_cells"),
    )
