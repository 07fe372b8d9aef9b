"""Trades to bars, summaries and decisions as streams.

Sources are folders of NDJSON (or any text stream with a `value` column).  Times are timestamps, watermarks are set by
the caller, and every keyed state is one symbol's.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tapeflow.operators.folds import HOLDING, REASONS, URGENCY, cost_gate_step, cost_units
from tapeflow.sources.readers import OHLC, TRADE, csv_lines, ingest_frame, own_columns


def lines(spark: SparkSession, folder: str, per_trigger: int = 1, archive: str | None = None) -> DataFrame:
    """A folder's text files as a stream of lines; with archive, files are moved there once read."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(folder)


def routed(raw: DataFrame, kind: str) -> DataFrame:
    """Valid lines of one kind ('trade' or 'ohlc1s') with a timestamp column ts."""
    schema = TRADE if kind == "trade" else OHLC
    row = raw.select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col("type") == kind)
    need = "price" if kind == "trade" else "close"
    return row.where(f"symbol IS NOT NULL AND ts_ms IS NOT NULL AND {need} IS NOT NULL").withColumn("ts", F.timestamp_millis("ts_ms"))


def kind_of(value: str = "value") -> Column:
    """A line's kind: trade, ohlc1s, other, invalid."""
    kind = F.get_json_object(value, "$.type")
    valid = F.from_json(value, "type string").isNotNull() & kind.isNotNull()
    return F.when(~valid, "invalid").when(kind.isin("trade", "ohlc1s"), kind).otherwise("other")


def counts(raw: DataFrame) -> DataFrame:
    """Lines by kind."""
    return raw.select(kind_of().alias("kind")).groupBy("kind").count()


def observed_lines(raw: DataFrame) -> DataFrame:
    """raw, whose lines of each kind are counted as they pass (Metrics)."""
    kind = kind_of()
    at = F.get_json_object("value", "$.ts_ms").try_cast("long")
    return raw.observe(
        "lines", F.count(F.lit(1)).alias("lines"), F.count_if(kind == "invalid").alias("invalid_lines"), F.count_if(kind == "trade").alias("trades"),
        F.count_if(kind == "ohlc1s").alias("ohlc"), F.max(F.when(kind == "ohlc1s", at)).alias("last_bar_ts_ms"),
    )


def observed_decisions(decided: DataFrame) -> DataFrame:
    """Rows of decisions, counted as they pass (Metrics)."""
    at = F.unix_millis("ts")
    return decided.observe(
        "decisions", F.count(F.lit(1)).alias("decisions"), F.count_if("blocked").alias("decisions_blocked"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_estimate"),
        F.count_if("clamped").alias("clamps"), F.max(F.when(F.col("direction") != 0, at)).alias("last_action_ts_ms"), F.max(at).alias("last_state_ts_ms"),
    )


class Metrics(StreamingQueryListener):
    """What the queries of a session have counted, over all batches; add it with spark.streams.addListener.

    Counts add up and times are the latest.  lag_ms: from the latest bar to the start of the batch that saw it; pending_rows: rows
    and keys that the state holds; last_batch_ts_ms: when the last batch with data began; connections are queries that run.
    """

    def __init__(self):
        self.totals = dict.fromkeys(("connections", "lines", "invalid_lines", "trades", "ohlc", "decisions", "decisions_blocked", "cost_estimate", "clamps"), 0)
        self.latest = dict.fromkeys(("last_bar_ts_ms", "last_action_ts_ms", "last_state_ts_ms", "last_batch_ts_ms", "lag_ms"))
        self.pending: dict = {}

    def onQueryStarted(self, event) -> None:
        self.totals["connections"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        began = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1000)
        self.pending[p.runId] = sum(s.numRowsTotal for s in p.stateOperators)
        if p.numInputRows:
            self.latest["last_batch_ts_ms"] = began
        for row in p.observedMetrics.values():
            for name, value in row.asDict().items():
                if name in self.totals:
                    self.totals[name] += value or 0
                elif name in self.latest and value is not None:
                    self.latest[name] = max(value, self.latest[name] or value)
                    if name == "last_bar_ts_ms":
                        self.latest["lag_ms"] = began - value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals["connections"] -= 1
        self.pending.pop(event.runId, None)

    def snapshot(self) -> dict:
        return {**self.totals, **self.latest, "pending_rows": sum(self.pending.values())}


def deduplicated(trades: DataFrame, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    return trades.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def bars(trades: DataFrame, every: str = "1 second", lateness: str = "0 seconds") -> DataFrame:
    """One bar for each symbol and bucket, emitted once when the watermark has passed it."""
    at = F.struct("ts", "price")
    found = trades.withWatermark("ts", lateness).groupBy(F.window("ts", every), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum(F.coalesce("qty", F.lit(0.0))).alias("volume"), F.count("*").alias("trades")
    )
    return found.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def sliding_means(rows: DataFrame, value: str, size: str, slide: str, lateness: str = "0 seconds") -> DataFrame:
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide), "symbol").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select("symbol", F.col("window.start").alias("ts"), "mean", "n")


def sessions(rows: DataFrame, gap: str, lateness: str = "0 seconds") -> DataFrame:
    found = rows.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return found.select("symbol", "start", "end", "n")


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then takes them through a step in the order of their times."""

    def __init__(self, first: tuple, step: Callable, state: str, columns: str, outputs: list[str]):
        self.first, self.step, self.state, self.columns, self.outputs = first, step, state, columns, outputs

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", self.state)
        self.waiting = handle.getListState("waiting", f"at long, {self.columns}")
        self.names = ["at", *[x.split()[0] for x in self.columns.split(", ")]]

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: (r[0], [(v is not None, v) for v in r[1:]]))
        n = sum(r[0] <= now for r in rows)
        if not n:
            return
        state = tuple(self.memory.get()) if self.memory.exists() else self.first
        for r in rows[:n]:
            state, made = self.step(state, dict(zip(self.names, r, strict=True)))
            if made is not None:
                yield Row(**dict(zip(["symbol", "at", *self.outputs], (key[0], r[0], *made), strict=True)))
        self.memory.update(state)
        self.waiting.clear()
        if rows[n:]:
            self.waiting.put(rows[n:])
            self._wake(rows[n][0])

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, first: tuple, step: Callable, state: str, outputs: str, columns: str, lateness: str) -> DataFrame:
    """step(state, row) -> (state, outputs or None) over each symbol's rows in the order of their times.

    A row waits in the state until the watermark, `lateness` behind the latest time of all rows, has passed it, so results
    don't depend on how rows come in batches; rows of one time go by their columns, nulls first; later ones than
    that are dropped.  A row's time in microseconds is its column `at`.  The state needs the RocksDB store, which this sets.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [x.split()[0] for x in columns.split(", ")]
    timed = rows.withWatermark("ts", lateness).select("symbol", "ts", F.unix_micros("ts").alias("at"), *names)
    made = [x.split()[0] for x in outputs.split(", ")]
    found = timed.groupBy("symbol").transformWithState(InOrder(first, step, state, columns, made), f"symbol string, at long, {outputs}", "Append", "EventTime")
    return found.select("symbol", F.timestamp_micros("at").alias("ts"), *made)


def window_state(closes: list[float], dead: float = 5e-5, keep: float = 0.95) -> int:
    """The triadic state after a window of closes: 1, 0, -1, or -2 where it is unknown; 0 after the first close."""
    p = np.asarray(closes, float)
    if len(p) < 2:
        return 0
    with np.errstate(divide="ignore", invalid="ignore"):
        r = p[1:] / p[:-1] - 1
    known = np.isfinite(p[1:]) & np.isfinite(p[:-1])
    n = np.maximum(np.cumsum(known), 1)
    wild = np.logical_or.accumulate(known & ~np.isfinite(r)) & (n > 1)  # a return from a price of 0, see operators.folds.triadic_state
    x = np.where(known & np.isfinite(r), r, 0.0)
    mean = np.cumsum(x) / n
    sigma = np.sqrt(np.maximum(np.cumsum(x * x) / n - mean * mean, 0.0))
    counts = known & (wild | (sigma >= 1e-12))
    step = np.where(wild, 5.0, np.clip(x / (sigma + 1e-9), -5.0, 5.0))
    z = 0.0
    for v in step[counts]:
        z = keep * z + (1 - keep) * v
    if not counts[-1]:
        return -2
    return 0 if wild[-1] or abs(z) < max(dead, 0.5 * sigma[-1]) else 1 if z > 0 else -1


def next_intent(memory: tuple, state: int, conf: float, observe: bool, on: float, off: float, base: float, ramp: float = 20.0) -> tuple[tuple, tuple]:
    """One row of operators.folds.intents, by its tables: memory (last state, its age, holds, thesis) and (direction, target,
    urgency, holds, actionability, reason); observing leaves the memory as it is."""
    last, age, held, thesis = memory
    if observe:
        return memory, (thesis, 0.0, URGENCY.get("observe", 0.0), True, 0.0, "observe")
    x = SimpleNamespace(state=state, held=held, free=not held, under_on=conf < on, under_off=conf < off, risk_stop=False, neutral_exit=False, convex=False)
    reason = next(name for name, applies in REASONS if applies(x))
    holds, acts = reason in HOLDING, reason == "active"
    age = (age + 1) * (state == last and state not in (0, -2))
    size = acts * min(1.0, base * (1 - math.exp(-age / ramp)) * conf)
    urgency = min(1.0, (0.3 + 0.1 * age) * conf) if acts else URGENCY.get(reason, 0.0)
    kept = thesis if holds else state * (size > 0)
    return (state, age, holds, kept), (thesis if holds else state * acts, size, urgency, holds, conf, reason)


_DECIDED = "closes array<double>, last int, age int, holding boolean, thesis int, held double, moved_at array<bigint>, costs array<double>, open boolean, ready boolean, why string"
_DECISION = "close double, state int, direction int, target double, urgency double, holds boolean, reason string, clamped boolean, blocked boolean, gate_target double, cost double"


def decisions(bars: DataFrame, gates: DataFrame | None = None, enforce: bool = False, window: int = 200, tau_on: float = 0.0, tau_off: float = 0.0, base: float = 0.05, lateness: str = "10 seconds", **cost: float) -> DataFrame:
    """The decision of every bar: the state of the trailing window of closes, the intent it gives, the clamp, the cost gate.

    gates: a stream of symbol, ts, open, ready, why, which come into force in the order of times, before a bar of the same
    time, also when they come `lateness` after the bars.  While a symbol's gate isn't open its strategy observes; with
    enforce, a symbol that isn't ready is clamped to no direction.  Without a row of gates a symbol is open, and not ready.
    cost: parameters of the cost gate.
    """
    options = {"rate": 0.0008, "edge_bps": 20.0, "budget": 1.0, "window_ms": 3_600_000} | cost
    gate = cost_gate_step("aim", "close", "actionability", "urgency", at_ms="at", **options)

    def step(state, row):
        closes, last, age, holding, thesis, held, moved_at, costs, is_open, ready, why = state
        if row["open"] is not None:
            return (closes, last, age, holding, thesis, held, moved_at, costs, bool(row["open"]), bool(row["ready"]), row["why"] or ""), None
        close = float(row["close"])
        closes = [*closes, close][-window:]
        now = window_state(closes)
        memory, (direction, target, urgency, holds, act, reason) = next_intent((last, age, holding, thesis), now, 1.0, not is_open, tau_on, tau_off, base)
        clamped = enforce and not ready
        if clamped:
            direction, target, urgency, holds, act, reason = 0, 0.0, 0.0, True, 0.0, f"{reason}+clamp{f' ({why})' if why else ''}"
        asked = {"aim": direction * target, "close": close, "actionability": act, "urgency": urgency, "at": row["at"] // 1000}
        (held, moves, _), (aim, blocked, _, due) = gate((held, deque(zip(moved_at, costs)), sum(map(cost_units, costs))), asked)
        kept = (closes, *memory, held, [int(t) for t, _ in moves], [float(c) for _, c in moves], is_open, ready, why)
        return kept, (close, now, direction, target, urgency, holds, reason, clamped, blocked, aim, due)

    rows = bars.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.lit(None).cast("boolean").alias("open"), F.lit(None).cast("boolean").alias("ready"), F.lit(None).cast("string").alias("why"))
    if gates is not None:
        rows = gates.select("symbol", "ts", F.lit(None).cast("double").alias("close"), "open", F.coalesce("ready", F.lit(False)).alias("ready"), "why").unionByName(rows)
    return keyed(rows, ([], 0, 0, False, 0, 0.0, [], [], True, False, ""), step, _DECIDED, _DECISION, "close double, open boolean, ready boolean, why string", lateness)


def summaries(bars: DataFrame, seconds: int = 60, last: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """n, mean, low, high of a symbol's last `last` closes, at the first bar of every `seconds` seconds."""

    def step(state, row):
        closes, due = state
        closes, at = [*closes, float(row["close"])][-last:], row["at"] // 1_000_000
        if at < due:
            return (closes, due), None
        return (closes, at - at % seconds + seconds), (len(closes), sum(closes) / len(closes), min(closes), max(closes))

    return keyed(bars, ([], 0), step, "closes array<double>, due bigint", "n int, mean double, low double, high double", "close double", lateness)


#: Columns of bar archives; a file without symbol or trades, or with columns in another order, is as good as any.
ARCHIVE = ["timestamp", "symbol", "open", "high", "low", "close", "volume", "trades"]


def ingest_archives(spark: SparkSession, folder: str, target: str, checkpoint: str, symbol: str | None = None) -> None:
    """Appends the bars of CSV archives (gz or plain) below a folder to a table, each file once, however often it is called.

    Every file is read by its own header.  Rows without a time or prices are dropped, so a file without such columns, or one
    that can't be read, gives none and stops nothing; symbol is that of rows without one, by default the file's name.
    """

    def write(lines: DataFrame, batch: int) -> None:
        rows = own_columns(lines, ARCHIVE)
        rows = rows.withColumn("symbol", F.coalesce("symbol", F.lit(symbol) if symbol else F.regexp_extract("_name", r"^[^.]+", 0)))
        put(ingest_frame(rows, symbol or "", "", "_name"), target, batch)

    lines = csv_lines(spark.readStream, folder, "*.csv*")
    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, folder: str, since_ms: int = 0, per_trigger: int = 1, archive: str | None = None) -> DataFrame:
    """Lines of a folder from the beginning, without those that are older than since_ms; new files follow as they come."""
    at = F.get_json_object("value", "$.ts_ms").try_cast("long")
    return lines(spark, folder, per_trigger, archive).where(F.coalesce(at, F.lit(since_ms)) >= since_ms)


def rolling_summary(bars: DataFrame, size: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """n, mean, low, high of the closes of every `size` bars of a symbol."""

    def step(state, row):
        n, total, low, high = state
        c = float(row["close"])
        n, total, low, high = n + 1, total + c, min(low, c), max(high, c)
        if n == size:
            return (0, 0.0, 1e300, -1e300), (n, total / n, low, high)
        return (n, total, low, high), None

    return keyed(bars, (0, 0.0, 1e300, -1e300), step, "n int, total double, low double, high double", "n int, mean double, low double, high double", "close double", lateness)


def audits(decided: DataFrame) -> DataFrame:
    """An audit row for each clamped or blocked decision."""
    return decided.where("clamped OR blocked").select("symbol", "ts", "reason", "clamped", "blocked")


def clamped(decisions: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions with direction 0 where the symbol's gate isn't open, and an audit row for each such decision."""
    joined = decisions.join(gates.select("symbol", "open", "why"), "symbol", "left").withColumn("clamped", ~F.coalesce("open", F.lit(False)) & (F.col("direction") != 0))
    out = joined.withColumn("direction", F.when(F.col("clamped"), 0).otherwise(F.col("direction")))
    return out.drop("open", "why"), joined.where("clamped").select("symbol", "ts", "direction", F.coalesce("why", F.lit("missing")).alias("why"))


#: How text formats write times: to the microsecond, so that a key that is read again is the one that was written.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def put(rows: DataFrame, path: str, batch: int, *parts: str, form: str = "parquet") -> None:
    """Writes a batch of a query into folders of its own below path, over what an earlier try of the same batch has left.

    Folders are named by the query (its id is kept in its checkpoint, so a query with a new one overwrites nothing) and batch.
    """
    query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    named = rows.withColumn("_batch", F.lit(f"{query[:8]}-{batch}"))
    named.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **_TIMES).partitionBy(*parts, "_batch").format(form).save(path)


def idempotent_sink(path: str, keys: list[str], part: str | None = None, form: str = "parquet") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows whose keys aren't in the table yet; a batch that comes again changes nothing.

    Null parts of keys are equal to each other.  part: a SQL expression of key columns that deals the table into folders, a day
    or an hour of their time for instance; by default one of 64 by a hash.  A batch reads the keys of the folders that its
    own rows fall into and no others, so with folders by time its cost follows from what arrives, not from the table.
    form: parquet or json (newline-delimited).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = F.expr(part) if part else F.pmod(F.xxhash64(*keys), F.lit(64))
        rows = batch.dropDuplicates(keys).withColumn("_part", F.coalesce(F.regexp_replace(kind.cast("string"), "[^0-9A-Za-z]", "-"), F.lit("none"))).persist()
        touched = sorted(r[0] for r in rows.select("_part").distinct().collect())
        if touched:
            schema = rows.drop("_part").schema.add("_part", "string").add("_batch", "string")
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
            try:
                seen = spark.read.schema(schema).options(basePath=path, **_TIMES).format(form).load(f"{path}/_part={{{','.join(touched)}}}")
            except Exception as e:  # none of these folders is there yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                seen = spark.createDataFrame([], schema)
            seen = seen.where(F.col("_batch") != f"{query[:8]}-{number}").select("_part", *keys)  # an earlier try of this batch doesn't count
            same = F.col("n._part") == F.col("s._part")
            for k in keys:
                same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}"))
            put(rows.alias("n").join(seen.alias("s"), same, "left_anti"), path, number, "_part", form=form)
        rows.unpersist()

    return write


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives each batch to every sink; the batch is computed once."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for sink in sinks:
            sink(held, number)
        held.unpersist()

    return write
