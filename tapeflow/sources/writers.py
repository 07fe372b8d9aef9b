"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: _clean(v, kind.valueType))
    return col


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls, in structs, arrays and maps too."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def append_bars(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def append_decisions(df: DataFrame, path: str) -> None:
    """Appends rows that have a time and a symbol; later columns are merged on read."""
    df.where("ts IS NOT NULL AND symbol IS NOT NULL").write.mode("append").parquet(path)


def write_log(df: DataFrame, path: str, kind: str = "json") -> None:
    writer = (json_safe(df) if kind == "json" else df).write.mode("append")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def csv_to_parquet(spark, source: str, target: str, schema: str) -> None:
    spark.read.schema(schema).option("header", True).csv(source).write.mode("overwrite").parquet(target)


#: The columns of the run logs.
STEP_LOG = "t long, ts timestamp, symbol string, source string, price double, volume double, pnl double, equity double, p_bad double, bad_flag boolean, action int, hold int, ban int, permission int, direction int, acceptable boolean, actionability double, ell double, exposure double, fill double, fee double, slippage double, stress double, edge_ema double, pred_edge double, plane_abs int, plane_sign int"
TRADE_LOG = "t long, ts timestamp, trade_id long, source string, close_reason string, entry_step long, exit_step long, entry_price double, exit_price double, trade_duration long, trade_pnl double, trade_pnl_pct double, price_move double, price_move_pct double"
TOWER_LOG = "t long, ts timestamp, symbol string, run_id string, P1 string, P2 string, P3 string, P4 string, P5 string, P6 string, P7 string, P8 string, P9 string, M8 string"
RUN_SUMMARY = "source string, steps long, trades long, pnl double, hold_pct double, max_drawdown double, elapsed_s double"


def as_log(df: DataFrame, schema: str) -> DataFrame:
    """df with a log's columns and types: what it lacks is null, structs become JSON where the log has strings, more goes."""
    kinds, out = dict(df.dtypes), []
    for name, kind in (x.split() for x in schema.split(", ")):
        if name not in kinds:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "string" and kinds[name].startswith(("struct", "array", "map")):
            out.append(F.to_json(name).alias(name))
        else:
            out.append(F.col(name).try_cast(kind).alias(name))
    return df.select(*out)


def append_log(df: DataFrame, path: str, schema: str, kind: str = "csv") -> None:
    """Appends rows to one of the logs above."""
    write_log(as_log(df, schema), path, kind)
