"""Scans: CSV, NDJSON, vendor snapshots, surfaces, weights; all with explicit schemas, bad rows dropped, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.operators.quantiles import median

TRADE = "type string, symbol string, ts_ms long, price double, qty double"
OHLC = "type string, symbol string, ts_ms long, open double, high double, low double, close double, volume double, trades long"
#: The column names that price files use, in lower case, by our name.
ALIASES = {"ts": ["date", "data", "datetime", "timestamp", "price"], "close": ["close", "zamkniecie"], "volume": ["volume", "wolumen"]}


def source_tag(path: Column) -> Column:
    """parent:stem of a file's path."""
    return F.concat_ws(":", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)*$", 1))


def _cells(line: Column) -> Column:
    """The fields of a CSV line."""
    return F.transform(F.split(F.regexp_replace(line, "[\r\ufeff]", ""), r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def layouts(lines: DataFrame) -> DataFrame:
    """file, head (the number of its header line), and the places (from 1) of ts, close and volume: 0 where absent.

    lines: _file, _start (of the split), value.  The header is the first line, or the third one where the first names no
    close.  Only the first splits of files are read.
    """
    from pyspark.sql import Window

    first = lines.where("_start = 0").withColumn("_id", F.monotonically_increasing_id())
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_id"))).where("_n <= 3")
    names = F.transform(_cells(F.col("value")), F.lower)
    place = lambda k: F.coalesce(*[F.nullif(F.array_position("_names", n), F.lit(0)) for n in ALIASES[k]], F.lit(0)).cast("int").alias(k)
    heads = numbered.where("_n <> 2").select("_file", "_n", names.alias("_names")).select("_file", "_n", *[place(k) for k in ALIASES]).where("close > 0")
    return heads.groupBy("_file").agg(F.min_by(F.struct(F.col("_n").alias("head"), *ALIASES), "_n").alias("at")).select("_file", "at.*")


def prices(spark: SparkSession, path: str, least_rows: int = 10) -> DataFrame:
    """symbol, ts, close, volume, seq from price CSVs below a folder.

    Every file has its own header, whose names are aliased; files without a close go.  Rows without a close, or without a
    date where the file has dates, go, header and ticker rows among them; a volume that isn't positive is the file's median
    positive one, 1e6 without any; files of fewer than least_rows rows go.
    """
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select("value", *meta)
    cell = lambda k: F.when(F.col(k) > 0, F.get("_cells", F.col(k) - 1))
    raw = lines.drop("_start").join(layouts(lines), "_file").withColumn("_cells", _cells(F.col("value")))
    volume = cell("volume").try_cast("double")
    df = raw.select(source_tag(F.col("_file")).alias("symbol"), F.try_to_timestamp(cell("ts")).alias("at"), (F.col("ts") > 0).alias("dated"), cell("close").try_cast("double").alias("close"), F.when(volume > 0, volume).alias("volume"))
    df = df.where("close IS NOT NULL AND NOT isnan(close) AND (at IS NOT NULL OR NOT dated)").withColumnRenamed("at", "ts").drop("dated")
    usual = df.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
    filled = df.join(usual, "symbol").join(median(df, ["symbol"], "volume", "_v"), "symbol", "left")
    return filled.select("symbol", "ts", "close", F.coalesce("volume", "_v", F.lit(1e6)).alias("volume"), F.xxhash64("ts", "close").alias("seq"))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NDJSON files that parse."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def ingest_frame(df: DataFrame, symbol: str, source_file: str, file_column: str | None = None) -> DataFrame:
    """A frame of bars as rows of ohlc_1s: times coerced, rows without prices dropped, symbol and trades defaulted.

    source_file is the same for all rows, or is read from file_column.
    """
    col = lambda c, kind, default=None: F.coalesce(F.col(c).try_cast(kind), F.lit(default).cast(kind)) if c in df.columns else F.lit(default).cast(kind)
    out = df.select(
        F.try_to_timestamp(F.col("timestamp").cast("string")).alias("timestamp"), col("symbol", "string", symbol).alias("symbol"), *[col(c, "double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        col("trades", "bigint", 0).alias("trades"), (F.col(file_column) if file_column else F.lit(source_file)).alias("source_file"),
    )
    return out.dropna(subset=["timestamp", "open", "high", "low", "close", "volume"])


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts (seconds), d, x, m from decision NDJSON under any of its key names; a mask is acting if absent."""
    from tapeflow.functions.scalar import seconds

    raw = ndjson(spark, path, "symbol string, timestamp double, ts_ms double, ts double, direction double, d double, action double, target_exposure double, x double, target double, m int")
    d = F.coalesce("direction", "d", "action", F.lit(0.0))
    x = F.abs(F.coalesce("target_exposure", "x", "target", F.lit(0.0)))
    return raw.select("symbol", seconds(F.coalesce("timestamp", "ts_ms", "ts")).alias("ts"), F.signum(d).cast("int").alias("d"), (F.signum(d) * x).alias("x"), F.coalesce("m", (d != 0).cast("int")).alias("m")).where("ts IS NOT NULL")


def log_returns(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, r: a given return under any name, else the mid's step, else close to close."""
    from pyspark.sql import Window

    from tapeflow.functions.scalar import seconds

    raw = ndjson(spark, path, "symbol string, ts double, r double, ret double, `return` double, price_ret double, delta_mid double, close double")
    w = Window.partitionBy("symbol").orderBy("ts")
    step = F.col("close") / F.lag("close").over(w) - 1
    return raw.select("symbol", seconds(F.col("ts")).alias("ts"), F.coalesce("r", "return", "ret", "price_ret", "delta_mid", step).alias("r")).where("r IS NOT NULL")


def surface(spark: SparkSession, path: str) -> DataFrame:
    """An options surface; fails if its times aren't in milliseconds."""
    ok = F.assert_true(F.col("ts").between(int(1e12), int(1e15)), F.lit("ts must be in milliseconds"))
    return spark.read.parquet(path).withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")


def open_interest(spark: SparkSession, path: str) -> DataFrame:
    """ts, open_interest, open_value, supply from arrays of open-interest snapshots; numbers that don't parse are null."""
    raw = spark.read.schema("timestamp long, sumOpenInterest string, sumOpenInterestValue string, CMCCirculatingSupply string").option("multiLine", True).json(path)
    number = lambda c, name: F.col(c).try_cast("double").alias(name)
    return raw.where("timestamp IS NOT NULL").select(F.col("timestamp").alias("ts"), number("sumOpenInterest", "open_interest"), number("sumOpenInterestValue", "open_value"), number("CMCCirculatingSupply", "supply"))


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each instrument list: ts (the latest creation in it), instruments, calls, puts, strike_mean,
    expiry_days_mean and expiry_days_median of its active instruments; lists without any give no row."""
    raw = spark.read.schema("result array<struct<option_type:string,strike:double,expiration_timestamp:long,creation_timestamp:long,is_active:boolean>>").option("multiLine", True).json(path)
    latest = F.array_max(F.transform("result", lambda r: F.coalesce(r["creation_timestamp"], F.lit(0))))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), latest.alias("ts"), F.explode("result").alias("r")).where("coalesce(r.is_active, true)")
    days = (F.coalesce("r.expiration_timestamp", F.lit(0)) - F.col("ts")) / 86_400_000
    return rows.groupBy("file", "ts").agg(
        F.count("*").alias("instruments"), F.count_if(F.col("r.option_type") == "call").alias("calls"), F.count_if(F.col("r.option_type") == "put").alias("puts"),
        F.avg("r.strike").alias("strike_mean"), F.avg(days).alias("expiry_days_mean"), F.percentile(days, F.lit(0.5)).alias("expiry_days_median"),
    ).drop("file")


#: The columns of a feature tape after symbol and ts.
QFEAT = ("vol_ratio", "curvature", "drawdown", "burstiness", "acorr_1", "var_ratio")


def feature_tape(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """symbol, ts, the six features and ell of a stored tape, as doubles; rows: how many of a symbol's first ones."""
    from pyspark.sql import Window

    raw = spark.read.parquet(path).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in (*QFEAT, "ell")])
    if rows is None:
        return raw
    return raw.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where(F.col("_n") <= rows).drop("_n")


def premium(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("time long, markPrice string, indexPrice string, lastFundingRate string").option("multiLine", True).json(path)
    mark, index = F.col("markPrice").try_cast("double"), F.col("indexPrice").try_cast("double")
    return raw.select(F.col("time").alias("ts"), mark.alias("mark"), F.when(index != 0, mark / index - 1).alias("premium"), F.col("lastFundingRate").try_cast("double").alias("funding"))


def book_summary(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("usIn long, result array<struct<instrument_name:string,mark_iv:double,open_interest:double>>").option("multiLine", True).json(path)
    rows = raw.select(F.floor(F.col("usIn") / 1000).alias("ts"), F.explode("result").alias("r"))
    return rows.groupBy("ts").agg(F.count("*").alias("instruments"), F.avg("r.mark_iv").alias("iv_mean"), F.percentile("r.mark_iv", F.lit(0.5)).alias("iv_median"), F.sum("r.open_interest").alias("open_interest"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """ont, name, pos, w from weight files (map of maps of arrays)."""
    raw = spark.read.schema("weights map<string, map<string, array<double>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("weights").alias("ont", "m")).select("ont", F.explode("m").alias("name", "a")).select("ont", "name", F.posexplode("a").alias("pos", "w"))


#: Where a file's lines come from, for own_columns.
LINE = ("value", "_file", "_start", "_name")


def csv_lines(reader, path: str, glob: str = "*") -> DataFrame:
    """The lines of files below a path with what own_columns needs; reader: spark.read or spark.readStream.

    Compressed files are read by their ending; a file that turns out to be broken ends with its last sound line.
    """
    lines = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_name").alias("_name"))


def own_columns(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of CSV files that each have a header of their own: columns as strings, and _name of the file.

    lines: as csv_lines gives them, but not a stream.  Columns are found by their names in each file's first line, in any
    order and case; one that a file doesn't have is null there.  Without columns, those are all names that any file has.  Lines
    that repeat their file's header and empty ones are no rows; a line of too few fields has nulls at its end.
    """
    at = F.monotonically_increasing_id()  # in the order of lines within a split
    first = lines.where("_start = 0").select("_file", F.struct(at.alias("at"), "value").alias("line"))
    heads = first.groupBy("_file").agg(F.min("line").alias("line")).select("_file", F.col("line.value").alias("_head"), F.transform(_cells(F.col("line.value")), F.lower).alias("_names"))
    if columns is None:
        columns = sorted(r[0] for r in heads.select(F.explode("_names")).distinct().collect() if r[0])
    rows = lines.join(heads, "_file").where("value <> _head AND trim(value) <> ''").withColumn("_cells", _cells(F.col("value")))
    place = lambda c: F.array_position("_names", c.lower()).cast("int")
    return rows.select(*[F.when(place(c) > 0, F.nullif(F.get("_cells", place(c) - 1), F.lit(""))).alias(c) for c in columns], "_name")


def named_logs(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV logs, each with its own header, with tau_on and tau_off read from their file names; columns as in own_columns."""
    raw = own_columns(csv_lines(spark.read, path), columns)
    tau = lambda k: F.regexp_extract("_name", rf"{k}[_=]?(\d+(?:\.\d+)?)", 1).try_cast("double").alias(k)
    return raw.select(*[c for c in raw.columns if c not in ("tau_on", "tau_off", "_name")], tau("tau_on"), tau("tau_off"))


def not_ingested(df: DataFrame, log: DataFrame, key: str = "source_file") -> DataFrame:
    return df.join(log.select(key).distinct(), key, "left_anti")
