"""The four binning conventions, each a Column of bin numbers from 0 (null outside the edges, and for null or NaN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def cut(x: Column, low: float, high: float, bins: int) -> Column:
    """Right-closed bins of equal width, the lowest edge included."""
    x = x.cast("double")
    at = F.ceil((x - F.lit(low)) / F.lit((high - low) / bins) - F.lit(1e-12)) - 1
    return F.when(_known(x) & x.between(F.lit(low), F.lit(high)), F.greatest(at, F.lit(0)).cast("int"))


def histogram(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Left-closed bins of equal width, the highest edge included."""
    x, low, high = x.cast("double"), F.lit(low) if not isinstance(low, Column) else low, F.lit(high) if not isinstance(high, Column) else high
    at = F.floor((x - low) / (high - low) * bins + F.lit(1e-12))
    return F.when(_known(x) & (x >= low) & (x <= high), F.least(at, F.lit(bins - 1)).cast("int"))


def digitize(x: Column, low: float, high: float, bins: int) -> Column:
    """Left-closed bins of equal width; what lies outside goes to the first or last bin."""
    x = x.cast("double")
    at = F.floor((x - F.lit(low)) / F.lit((high - low) / bins) + F.lit(1e-12))
    return F.when(_known(x), F.greatest(F.lit(0), F.least(at, F.lit(bins - 1))).cast("int"))


def center(at: Column, low: float, high: float, bins: int) -> Column:
    return F.lit(low) + (at + F.lit(0.5)) * F.lit((high - low) / bins)


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: edges, the distinct quantiles 0, 1/bins .. 1."""
    from tapeflow.operators.quantiles import quantiles

    names = [f"q{i}" for i in range(bins + 1)]
    found = quantiles(df, [], column, {n: i / bins for i, n in enumerate(names)})
    return found.select(F.array_distinct(F.array(*names)).alias("edges"))


def by_edges(x: Column, edges: Column) -> Column:
    """Right-closed bins between edges in an array, the lowest edge included."""
    above = F.size(F.filter(edges, lambda e: e < x))
    return F.when(_known(x) & (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1)), F.greatest(above - 1, F.lit(0)))


def with_quantile_bin(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Adds the quantile bin of a column; the edges, one row, are sent to all tasks."""
    edges = quantile_edges(df.where(F.col(column).isNotNull()), column, bins)
    return df.crossJoin(F.broadcast(edges)).withColumn(out, by_edges(F.col(column), F.col("edges"))).drop("edges")
