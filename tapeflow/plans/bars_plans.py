"""Queries of bars and sources of bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import bars as b
from tapeflow.operators import windows as w

from .fixtures import bars, ticks
from .registry import query

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


def _ohlc(unit: str) -> str:
    return f"""SELECT symbol, date_trunc('{unit}', ts) AS ts, CAST(0 AS BIGINT) AS seq, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (ts, seq)) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2"""


@query("e1_ohlcv_1s", _ohlc("second"), "open high low close")
def e1(spark, sf_dir):
    return b.ohlcv(ticks(spark, sf_dir), "1 second")


_ROLL = """SELECT symbol, date_trunc('{unit}', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
    CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trades) AS BIGINT) AS trades, max(high) - min(low) AS "range", arg_max(close, ts) / nullif(arg_min(open, ts), 0) - 1 AS ret,
    sqrt(sum(ln(nullif(close / nullif(open, 0), 0)) * ln(nullif(close / nullif(open, 0), 0)))) AS realised_vol, abs(sum(sign(ln(nullif(close / nullif(open, 0), 0))))) / count(*) AS persistence, count(*) < 2 AS unknown
    FROM {src} GROUP BY 1, 2"""


@query("e2_rollup_day", _ROLL.format(unit="day", src="bars"), 'open high low close "range" ret realised_vol persistence')
def e2_day(spark, sf_dir):
    return b.rollup(bars(spark, sf_dir), "1 day")


@query("e2_rollup_minute", "|s1 AS (" + _ohlc("second") + ") " + _ROLL.format(unit="minute", src="s1"), 'open high low close "range" ret realised_vol persistence')
def e2_minute(spark, sf_dir):
    return b.rollup(b.ohlcv(ticks(spark, sf_dir), "1 second"), "1 minute")


def _resample(fill: str) -> str:
    pick = "last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if fill == "ffill" else "first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""|f AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, arg_min(close, ts) AS close, arg_min(volume, ts) AS volume FROM bars GROUP BY 1, 2),
        g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 6 HOUR)) AS ts FROM f GROUP BY 1)
        SELECT symbol, ts, {pick.format(c="close")} AS close, {pick.format(c="volume")} AS volume FROM g LEFT JOIN f USING (symbol, ts)"""


@query("e3_resample_ffill", _resample("ffill"), "close")
def e3_forward(spark, sf_dir):
    return b.resample(bars(spark, sf_dir), "6 hours")


@query("e3_resample_bfill", _resample("bfill"), "close")
def e3_back(spark, sf_dir):
    return b.resample(bars(spark, sf_dir), "6 hours", "bfill")


@query(
    "flagship_gate_metrics",
    f"""|r AS (SELECT *, close / nullif(lag(close) {_W}, 0) - 1 AS ret FROM bars),
    s AS (SELECT *, CASE WHEN ret > 0.05 THEN 1 WHEN ret < -0.05 THEN -1 ELSE 0 END AS state FROM r),
    c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) {_W} OR row_number() {_W} = 1 THEN 1 ELSE 0 END AS ch FROM s),
    i AS (SELECT *, sum(ch) {_W} AS island FROM c),
    u AS (SELECT *, CASE WHEN state = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY ts, seq) END AS run FROM i)
    SELECT symbol, count(*) AS bars, avg(CAST(run >= 2 AS INT)) AS acceptable_share, CAST(max(run) AS INT) AS longest_run, avg(CAST(state <> 0 AS INT)) AS act_share, avg(ret) AS mean_ret FROM u GROUP BY 1""",
    "acceptable_share act_share mean_ret",
)
def flagship_gate_metrics(spark, sf_dir):
    """Hourly bars, their returns, regime acceptability and gate metrics of each symbol: one shuffle by symbol after the bars."""
    df = bars(spark, sf_dir).withColumn("ret", w.returns("close"))
    df = df.withColumn("state", F.when(F.col("ret") > 0.05, 1).when(F.col("ret") < -0.05, -1).otherwise(0))
    df = w.acceptability(df, min_run=2)
    return df.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.avg(F.col("acceptable").cast("int")).alias("acceptable_share"), F.max("run").alias("longest_run"), F.avg((F.col("state") != 0).cast("int")).alias("act_share"), F.avg("ret").alias("mean_ret")
    )
