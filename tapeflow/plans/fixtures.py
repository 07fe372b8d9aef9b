"""Views that queries start from: ticks, bars and a decision log, derived from the events table.

The select lists are plain SQL that Spark and DuckDB read alike, so a query and its SQL counterpart start from one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_W = "OVER (PARTITION BY symbol ORDER BY ts, seq)"

#: Each layer selects from the one before; the first one from events.
TICKS = [["event_type AS symbol", "ts", "event_id AS seq", "value AS price", "1 + user_id % 5 AS qty", "user_id", "props"]]
STEPS = [
    *TICKS,
    ["*", f"CAST(row_number() {_W} - 1 AS BIGINT) AS t", f"CASE WHEN lag(price) {_W} > 0 THEN greatest(-1.0, least(1.0, CAST(price / lag(price) {_W} - 1 AS DOUBLE))) END AS ret"],
    [
        "*",
        "CASE WHEN ret > 0.3 THEN 1 WHEN ret < -0.3 THEN -1 ELSE 0 END AS state",
        "CAST((seq * 37) % 101 AS DOUBLE) / 100 AS ell",
        "CASE WHEN seq % 97 = 0 THEN NULL ELSE CAST((seq * 53) % 101 AS DOUBLE) / 100 END AS actionability",
        "CAST((seq * 29) % 101 AS DOUBLE) / 100 AS p_bad",
        "(seq * 31) % 10 < 6 AS acceptable",
        "CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS ban",
    ],
    ["*", "CASE WHEN ell >= 0.4 THEN state ELSE 0 END AS action", "p_bad > 0.7 AS bad_flag"],
    ["*", "CASE WHEN action = 0 THEN 1 ELSE 0 END AS hold", "action * ell AS exposure"],
    ["*", f"coalesce(lag(exposure) {_W}, CAST(0 AS DOUBLE)) AS prev_exposure"],
    ["*", "exposure - prev_exposure AS fill", "abs(exposure - prev_exposure) / 1000 AS fee", "abs(exposure - prev_exposure) / 2000 AS slippage"],
    ["*", f"sum(prev_exposure * coalesce(ret, CAST(0 AS DOUBLE)) - fee) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pnl"],
]
#: Hourly bars.
BARS_SQL = """SELECT symbol, date_trunc('hour', ts) AS ts, CAST(0 AS BIGINT) AS seq, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, seq)) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2"""


def _layers(layers: list[list[str]]) -> str:
    sql = "events"
    for layer in layers:
        sql = f"(SELECT {', '.join(layer)} FROM {sql})"
    return f"SELECT * FROM {sql}"


#: What every SQL counterpart may read.
PREFIX = f"WITH RECURSIVE ticks AS ({_layers(TICKS)}), steps AS MATERIALIZED ({_layers(STEPS)}), bars AS ({BARS_SQL})"


def _view(spark: SparkSession, sf_dir: str, layers: list[list[str]]) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    for layer in layers:
        df = df.selectExpr(*layer)
    return df


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TICKS)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STEPS)


def pieced_steps(spark: SparkSession, sf_dir: str, blocks: int | None = None) -> DataFrame:
    """symbol, ts, seq, price and what steps makes of a row and the price before it, from pieces of tapes (windows.pieces)."""
    from pyspark.sql import functions as F

    from tapeflow.operators.windows import piece, pieces, with_before

    rows = with_before(pieces(ticks(spark, sf_dir).select("symbol", "ts", "seq", "price"), blocks))
    rows = rows.withColumn("_before", F.lag("price").over(piece())).where("NOT _halo").drop("_halo")
    made = STEPS[len(TICKS)][2].replace(f"lag(price) {_W}", "_before")
    return rows.selectExpr("*", made).drop("_before").selectExpr(*STEPS[len(TICKS) + 1])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.operators.bars import ohlcv

    return ohlcv(ticks(spark, sf_dir), "1 hour")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
