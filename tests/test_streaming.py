import gzip
import json
import math
import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tapeflow.operators.bars import ohlcv
from tapeflow.streaming import jobs


def trade(sym, ms, price, qty=1.0, **more):
    return json.dumps({"type": "trade", "symbol": sym, "ts_ms": ms, "price": price, "qty": qty, **more})


LINES = [trade("A", 1000, 10.0), trade("A", 1500, 12.0), trade("B", 1200, 5.0), "not json", '{"type":"hello"}', trade("A", 2100, 11.0), trade("B", 2500, 6.0), '{"type":"trade","symbol":"A"}', trade("A", 3100, 9.0), trade("B", 3100, 7.0), trade("A", 99000, 1.0), trade("B", 99000, 1.0)]


def placed(path, text, i):
    """A file of its own time: the source reads files in the order of their times."""
    path.write_text(text)
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(0, len(LINES), 3):
        placed(tmp_path / "in" / f"{i:03d}.json", "\n".join(LINES[i : i + 3]) + "\n", i)
    return str(tmp_path / "in")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_stream_bars_equal_batch_bars(spark, folder):
    stream = jobs.bars(jobs.routed(jobs.lines(spark, folder), "trade"))
    got = {(r[0], r[1], *r[2:]) for r in drain(stream, "s_bars")}
    batch = jobs.routed(spark.read.text(folder), "trade").withColumns({"seq": F.col("ts_ms"), "qty": F.col("qty")})
    want = {(r["symbol"], r["ts"], r["open"], r["high"], r["low"], r["close"], float(r["volume"]), r["trades"]) for r in ohlcv(batch).collect()}
    assert got == {w for w in want if w[1].timestamp() % 1000 < 90}


def test_counts_and_duplicates(spark, folder):
    raw = spark.read.text(folder)
    assert {r["kind"]: r["count"] for r in jobs.counts(raw).collect()} == {"trade": 10, "other": 1, "invalid": 1}
    got = drain(jobs.deduplicated(jobs.routed(jobs.lines(spark, folder), "trade"), ["symbol"], "10 days").select("symbol", "price"), "s_dedup")
    assert len(got) == 2


#: The second of the first bar: a watermark begins at 0, and what isn't after it is late.
BASE = 900


def bar(i, close):
    return json.dumps({"type": "ohlc1s", "symbol": "A", "ts_ms": 1000 * (BASE + i), "open": 1, "high": 1, "low": 1, "close": close, "volume": 1})


def fed(spark, folder, rows, n):
    folder.mkdir()
    for i in range(0, len(rows), n):
        placed(folder / f"{i:03d}.json", "\n".join(rows[i : i + n]), i)
    return jobs.routed(jobs.lines(spark, str(folder)), "ohlc1s")


#: A bar far ahead of all others, which lets the watermark pass them; it isn't passed itself.
END = 10_000_000


def ended(rows):
    return [*rows, bar(END, 1.0)]


def test_decisions_equal_the_batch_operators(spark, tmp_path):
    """States, intents and gated targets of a stream, in batches of any size and order, are those of the tape operators."""
    from tapeflow.operators import folds as k

    rng = random.Random(2)
    closes = [100.0]
    while len(closes) < 150:
        closes.append(closes[-1] * (1 + rng.gauss(0.004 if len(closes) // 25 % 2 else -0.004, 0.004)))
    rows = [bar(i, c) for i, c in enumerate(closes)]
    mixed = [r for i in range(0, 150, 10) for r in rng.sample(rows[i : i + 10], 10)]
    found = []
    for n, given in ((151, rows), (40, rows), (7, mixed)):
        made = jobs.decisions(fed(spark, tmp_path / str(n), ended(given), n), base=1.0, budget=10.0, edge_bps=12.0, lateness="30 seconds")
        found.append(sorted((r[1].timestamp(), *r[2:]) for r in drain(made, f"s_dec{n}")))
    assert found[0] == found[1] == found[2] and len(found[0]) == 150
    tape = spark.createDataFrame([("A", BASE + i, i, c) for i, c in enumerate(closes)], "symbol string, ts long, seq long, price double")
    batch = k.intents(k.triadic_state(tape).withColumns({"one": F.lit(1.0), "tau": F.lit(0.0), "ts_ms": F.col("ts") * 1000}), "tri", "one", "tau", "tau")
    batch = k.cost_gate(batch.withColumn("aim", F.col("direction") * F.col("target")), "aim", urgency="urgency", budget=10.0, edge_bps=12.0)
    want = [(r["tri"], r["direction"], r["target"], r["urgency"], r["holds"], r["reason"], r["blocked"], r["gate_target"]) for r in batch.orderBy("ts").collect()]
    got = [(r[2], r[3], r[4], r[5], r[6], r[7], r[9], r[10]) for r in found[0]]
    assert [w[0] for w in want] == [g[0] for g in got] and len({w[0] for w in want}) >= 3 and any(w[6] for w in want)
    for a, b in zip(got, want):
        assert a[1] == b[1] and a[4:7] == b[4:7] and all(math.isclose(a[x], b[x], abs_tol=1e-9) for x in (2, 3, 7))


def test_gates_come_into_force_in_time(spark, tmp_path):
    """Gates that come long after their bars count from their own times on."""
    bars = fed(spark, tmp_path / "b", ended([bar(i, 100 * 1.01**i + i % 3) for i in range(30)]), 4)
    (tmp_path / "g").mkdir()
    for i, (s, o, r, w) in enumerate([(0, True, True, ""), (9.5, False, True, ""), (19.5, True, False, "late")]):
        placed(tmp_path / "g" / f"{i}.json", json.dumps({"symbol": "A", "ts": BASE + s, "open": o, "ready": r, "why": w}), i)
    gates = spark.readStream.schema("symbol string, ts double, open boolean, ready boolean, why string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "g")).withColumn("ts", F.timestamp_seconds("ts"))
    made = sorted(drain(jobs.decisions(bars, gates, enforce=True, lateness="1 hour"), "s_gates"), key=lambda r: r[1])
    reasons, flags = [r[8] for r in made], [r[9] for r in made]
    assert set(reasons[10:20]) == {"observe"} and all(x.endswith("+clamp (late)") for x in reasons[20:]) and flags == [False] * 20 + [True] * 10
    assert "observe" not in reasons[:10] and all(r[4] == 0 for r in made[20:])


def test_metrics(spark, tmp_path):
    rows = ended([bar(i, 100.0 + i % 2) for i in range(20)]) + ["junk", '{"type":"x"}', trade("A", 5, 1.0)]
    (tmp_path / "in").mkdir()
    for i in range(0, len(rows), 8):
        placed(tmp_path / "in" / f"{i:03d}.json", "\n".join(rows[i : i + 8]), i)
    metrics = jobs.Metrics()
    spark.streams.addListener(metrics)
    try:
        raw = jobs.observed_lines(jobs.lines(spark, str(tmp_path / "in")))
        made = drain(jobs.observed_decisions(jobs.decisions(jobs.routed(raw, "ohlc1s"), enforce=True)), "s_metrics")
        for _ in range(100):
            found = metrics.snapshot()
            if found["connections"] == 0 and found["decisions"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    assert len(made) == 20
    assert {k: found[k] for k in ("lines", "invalid_lines", "trades", "ohlc", "decisions", "decisions_blocked", "clamps")} == {"lines": 24, "invalid_lines": 1, "trades": 1, "ohlc": 21, "decisions": 20, "decisions_blocked": 0, "clamps": 20}
    assert found["last_bar_ts_ms"] == 1000 * (BASE + END) and found["last_state_ts_ms"] == 1000 * (BASE + 19) and found["last_action_ts_ms"] is None
    assert found["lag_ms"] == found["last_batch_ts_ms"] - found["last_bar_ts_ms"] or found["lag_ms"] > 0


def test_summaries(spark, tmp_path):
    rows = ended([bar(i, i) for i in range(40)])
    assert [r[2] for r in drain(jobs.rolling_summary(fed(spark, tmp_path / "a", rows, 7), 10), "s_sum")] == [10] * 4
    got = sorted((r[1].timestamp(), *r[2:]) for r in drain(jobs.summaries(fed(spark, tmp_path / "b", rows, 9), 15, 10), "s_every"))
    assert got == [(BASE + 0.0, 1, 0.0, 0.0, 0.0), (BASE + 15.0, 10, 10.5, 6.0, 15.0), (BASE + 30.0, 10, 25.5, 21.0, 30.0)]


def test_sliding_means(spark, tmp_path):
    made = jobs.sliding_means(fed(spark, tmp_path / "a", [bar(i, i) for i in range(40)] + [bar(4000, 0)], 50).withColumn("ts", F.col("ts")), "close", "10 seconds", "5 seconds")
    got = {r[1].timestamp(): (r[2], r[3]) for r in drain(made, "s_slide", "complete")}
    assert got[BASE + 5.0] == (9.5, 10) and got[BASE - 5.0] == (2.0, 5)


def test_archives_are_ingested_once(spark, tmp_path):
    src, out, log = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "log")
    src.mkdir()
    head = "timestamp,symbol,open,high,low,close,volume,trades\n"
    with gzip.open(src / "btc.csv.gz", "wt") as f:
        f.write(head + "2024-01-01 00:00:00,,1,2,0.5,1.5,3,4\nbad,,1,2,0.5,1.5,3,4\n2024-01-01 00:00:01,ETH,1,2,0.5,,3,\n")
    for _ in range(2):
        jobs.ingest_archives(spark, str(src), out, log)
    (src / "eth.csv").write_text(head + "2024-01-01 00:00:02,ETH,1,2,0.5,1.5,3,\n")
    jobs.ingest_archives(spark, str(src), out, log)
    rows = sorted((r["symbol"], r["trades"], r["source_file"]) for r in spark.read.parquet(out).collect())
    assert rows == [("ETH", 0, "eth.csv"), ("btc", 4, "btc.csv.gz")]


def test_archives_of_many_layouts(spark, tmp_path):
    """Files without symbol or trades, in another order, broken or of another kind; none stops the stream."""
    src, out, log = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "log")
    (src / "deep").mkdir(parents=True)

    def zipped(name, *rows):
        with gzip.open(src / name, "wt") as f:
            f.write("\n".join(rows) + "\n")

    zipped("a.csv.gz", "timestamp,open,high,low,close,volume", "2024-01-01 00:00:00,1,2,0.5,1.5,3")
    zipped("deep/b.csv.gz", "trades,close,low,high,open,volume,Symbol,timestamp", "7,1.5,0.5,2,1,3,ETH,2024-01-01 00:00:01", '8,1.5,0.5,2,1,3,"",2024-01-01 00:00:02')
    zipped("c.csv.gz", "x,y", "1,2")
    (src / "d.csv.gz").write_bytes(b"\x1f\x8bnot a gzip file")
    (src / "e.csv").write_text("")
    jobs.ingest_archives(spark, str(src), out, log, symbol="BTC")
    zipped("f.csv.gz", "close,timestamp,open,high,low,volume,more", "1.5,2024-01-01T00:00:03,1,2,0.5,3,z", "close,timestamp,open,high,low,volume,more", "1.5,2024-01-01 00:00:04")
    for _ in range(2):
        jobs.ingest_archives(spark, str(src), out, log, symbol="BTC")
    found = spark.read.parquet(out)
    rows = sorted((r["timestamp"].second, r["symbol"], r["trades"], r["source_file"], r["open"], r["close"]) for r in found.collect())
    assert rows == [(0, "BTC", 0, "a.csv.gz", 1.0, 1.5), (1, "ETH", 7, "b.csv.gz", 1.0, 1.5), (2, "BTC", 8, "b.csv.gz", 1.0, 1.5), (3, "BTC", 0, "f.csv.gz", 1.0, 1.5)]
    (tmp_path / "log2").mkdir()
    jobs.ingest_archives(spark, str(src / "deep"), out, str(tmp_path / "log2"))  # another query overwrites nothing
    assert spark.read.parquet(out).count() == 6


def test_replay_and_rotation(spark, folder, tmp_path):
    got = [r[0] for r in drain(jobs.replay(spark, folder, since_ms=2500), "s_replay")]
    assert sum('"trade"' in x and "ts_ms" in x for x in got) == 5 and "not json" in got
    (tmp_path / "old").mkdir()
    stream = jobs.replay(spark, folder, archive=str(tmp_path / "old"))
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r[0] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == len(LINES)
    names = [f"{i:03d}.json" for i in range(0, len(LINES), 3)]
    assert sorted(os.listdir(folder)) == names[-1:]  # the newest file is held back
    assert sorted(p.name for p in (tmp_path / "old").rglob("*.json")) == names[:-1]


def test_gate_clamps(spark):
    d = spark.createDataFrame([("A", 1, 1), ("B", 1, -1), ("C", 1, 0)], "symbol string, ts long, direction int")
    gates = spark.createDataFrame([("A", True, "")], "symbol string, open boolean, why string")
    out, audit = jobs.clamped(d, gates)
    assert sorted((r["symbol"], r["direction"]) for r in out.collect()) == [("A", 1), ("B", 0), ("C", 0)]
    assert [r["symbol"] for r in audit.collect()] == ["B"]


KEYED = "run_id string, ts timestamp, symbol string, x int"


def keyed_rows(spark, *rows):
    return spark.createDataFrame([(r, None if t is None else datetime.fromtimestamp(t, timezone.utc), s, x) for r, t, s, x in rows], KEYED)


@pytest.mark.parametrize("form", ["parquet", "json"])
@pytest.mark.parametrize("part", [None, "date_format(ts, 'yyyy-MM-dd HH')"])
def test_sink_is_idempotent(spark, tmp_path, part, form):
    path = str(tmp_path / "t")
    write = jobs.idempotent_sink(path, ["run_id", "ts", "symbol"], part, form)
    read = lambda: spark.read.format(form).load(path)
    one = keyed_rows(spark, ("r", 1.000123, "A", 1), ("r", 1.000123, "A", 1), ("r", 2, "A", 2), (None, 3, "A", 3), ("r", None, None, 4))
    for _ in range(2):  # the same batch again, null key parts among its rows
        write(one, 0)
    assert read().count() == 4
    write(keyed_rows(spark, ("r", 1.000123, "A", 9), ("r", 2, "A", 9), (None, 3, "A", 9), ("r", None, None, 9), ("r", 9000, "B", 5)), 1)
    write(keyed_rows(spark), 2)
    assert sorted(r["x"] for r in read().collect()) == [1, 2, 3, 4, 5]


def test_sink_reads_only_folders_of_the_batch(spark, tmp_path, monkeypatch):
    """What a batch reads doesn't grow with the table: only the hours of its own rows."""
    path = str(tmp_path / "t")
    write = jobs.idempotent_sink(path, ["run_id", "ts", "symbol"], "date_format(ts, 'yyyy-MM-dd HH')")
    for hour in range(6):
        write(keyed_rows(spark, *[("r", 3600 * hour + i, "A", i) for i in range(5)]), hour)
    loaded = []
    reader = type(spark.read)
    plain = reader.load
    monkeypatch.setattr(reader, "load", lambda self, p=None, **k: loaded.append(p) or plain(self, p, **k))
    write(keyed_rows(spark, ("r", 3600 * 2, "A", 7), ("r", 3600 * 2 + 9, "A", 8)), 6)
    assert [p.rpartition("/")[2] for p in loaded] == ["_part={1970-01-01-02}"]
    assert spark.read.parquet(path).count() == 31


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """A query that dies after its sinks have written a batch, but before the batch is committed, writes it again."""
    made = fed(spark, tmp_path / "in", [bar(i, i) for i in range(6)] + [bar(3, 3)], 3)
    table, lines = str(tmp_path / "t"), str(tmp_path / "l")
    both = jobs.fan_out(jobs.idempotent_sink(table, ["symbol", "ts"]), jobs.idempotent_sink(lines, ["symbol", "ts"], form="json"))
    fails = [True]

    def dies(batch, number):
        both(batch, number)
        if number == 1 and fails.pop():
            raise RuntimeError("lost")

    go = lambda f: made.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        go(dies).awaitTermination()
    go(both).awaitTermination()
    assert spark.read.parquet(table).count() == spark.read.json(lines).count() == 6
