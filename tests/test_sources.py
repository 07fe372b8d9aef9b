import json
import math

import pytest

from tapeflow.sources import readers, writers


def test_prices(spark, tmp_path):
    (tmp_path / "stooq").mkdir()
    body = "\n".join(f"2024-01-{i:02d},1,2,0.5,{i},{0 if i == 3 else i}" for i in range(1, 12))
    (tmp_path / "stooq" / "spy.csv").write_text("Data,Otwarcie,Najwyzszy,Najnizszy,Zamkniecie,Wolumen\n" + body + "\nTicker,x,x,x,x,x\n")
    (tmp_path / "stooq" / "tiny.csv").write_text("Data,Otwarcie,Najwyzszy,Najnizszy,Zamkniecie,Wolumen\n2024-01-01,1,1,1,1,1\n")
    rows = readers.prices(spark, str(tmp_path)).orderBy("ts").collect()
    assert len(rows) == 11 and {r["symbol"] for r in rows} == {"stooq:spy"} and rows[2]["volume"] == 6.5


def test_prices_of_many_layouts(spark, tmp_path):
    """Every file has a header of its own: other names, another order, a header below two lines of tickers, no volume."""
    days = [f"2024-01-{i:02d}" for i in range(1, 16)]
    files = {
        "a.csv": ["Date,Open,High,Low,Close,Volume"] + [f"{d},1,2,0.5,{i + 1},{i}" for i, d in enumerate(days)],
        "b.csv": ["Wolumen,Zamkniecie,Najnizszy,Najwyzszy,Otwarcie,Data"] + [f"{i},{i + 1},0.5,2,1,{d}" for i, d in enumerate(days)],
        "c.csv": ["Price,Close,High,Low,Open,Volume", "Ticker,SPY,SPY,SPY,SPY,SPY", "Date,,,,,"] + [f'{d},"{i + 1}",2,0.5,1,{i}' for i, d in enumerate(days)],
        "d.csv": ["some,title", "another,line", "\ufeffclose,datetime\r"] + [f"{i + 1},{d}\r" for i, d in enumerate(days)],
        "e.csv": ["x,y", "1,2"] * 10,
        "f.csv": ["close"] + [str(i + 1) for i in range(15)],
    }
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    found = readers.prices(spark, str(tmp_path)).collect()
    by = {k: sorted((r["close"], str(r["ts"]), r["volume"]) for r in found if r["symbol"].endswith(f":{k}")) for k in "abcdef"}
    assert len(found) == 75 and by["e"] == [] and by["a"] == by["b"] == by["c"]
    assert by["a"] == [(float(i + 1), f"{d} 00:00:00", float(i or 7.5)) for i, d in enumerate(days)]
    assert by["d"] == [(float(i + 1), f"{d} 00:00:00", 1e6) for i, d in enumerate(days)]
    assert by["f"] == [(float(i + 1), "None", 1e6) for i in range(15)]


def test_ndjson_and_decisions(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('{"symbol":"A","timestamp":1700000000000,"direction":-2,"x":0.5}\nbroken\n{"symbol":"A","ts":1700000001,"d":0,"target":1,"m":1}\n{"symbol":"A"}\n')
    rows = readers.decisions(spark, str(p)).orderBy("ts").collect()
    assert [(r["ts"], r["d"], r["x"], r["m"]) for r in rows] == [(1700000000.0, -1, -0.5, 1), (1700000001.0, 0, 0.0, 1)]


def test_returns(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"symbol":"A","ts":1,"close":10}\n{"symbol":"A","ts":2,"close":11}\n{"symbol":"A","ts":3,"close":11,"ret":0.5}\n')
    assert [round(r["r"], 6) for r in readers.log_returns(spark, str(p)).orderBy("ts").collect()] == [0.1, 0.5]


def test_ingest_and_anti_join(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "1", 2.0, 0.5, 1.5, 3.0), ("bad", "1", 2.0, 0.5, 1.5, 3.0), ("2024-01-01 00:00:01", None, 2.0, 0.5, 1.5, 3.0)], "timestamp string, open string, high double, low double, close double, volume double")
    out = readers.ingest_frame(df, "BTC", "f1")
    assert [(r["symbol"], r["trades"], r["source_file"]) for r in out.collect()] == [("BTC", 0, "f1")]
    assert readers.not_ingested(out, out).count() == 0


def test_surface_unit(spark, tmp_path):
    spark.createDataFrame([(1700000000000, 1.0)], "ts long, iv double").write.parquet(str(tmp_path / "ok"))
    spark.createDataFrame([(1700000000, 1.0)], "ts long, iv double").write.parquet(str(tmp_path / "bad"))
    assert readers.surface(spark, str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception, match="milliseconds"):
        readers.surface(spark, str(tmp_path / "bad")).collect()


def test_vendor_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"time": 5, "markPrice": "11", "indexPrice": "10", "lastFundingRate": "0.1"}))
    (tmp_path / "b.json").write_text(json.dumps({"usIn": 7000, "result": [{"instrument_name": "a", "mark_iv": 50, "open_interest": 1}, {"instrument_name": "b", "mark_iv": None, "open_interest": 2}]}))
    (tmp_path / "w.json").write_text(json.dumps({"weights": {"T": {"score": [0.1, 0.2]}}}))
    assert round(readers.premium(spark, str(tmp_path / "p.json")).first()["premium"], 6) == 0.1
    b = readers.book_summary(spark, str(tmp_path / "b.json")).first()
    assert (b["ts"], b["instruments"], b["iv_mean"], b["open_interest"]) == (7, 2, 50.0, 3.0)
    assert [(r["ont"], r["name"], r["pos"], r["w"]) for r in readers.weights(spark, str(tmp_path / "w.json")).collect()] == [("T", "score", 0, 0.1), ("T", "score", 1, 0.2)]


def test_interest_and_instruments(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"timestamp": 5, "sumOpenInterest": "10.5", "sumOpenInterestValue": "x"}, {"timestamp": 6, "sumOpenInterest": "11"}]))
    day = 86_400_000
    item = lambda kind, strike, days, **k: {"option_type": kind, "strike": strike, "expiration_timestamp": 10 * day + days * day, "creation_timestamp": 10 * day, **k}
    (tmp_path / "i.json").write_text(json.dumps({"result": [item("call", 10, 1), item("put", 20, 3), item("put", 60, 8, is_active=True), item("call", 999, 99, is_active=False)]}))
    (tmp_path / "n.json").write_text(json.dumps({"result": []}))
    assert [tuple(r) for r in readers.open_interest(spark, str(tmp_path / "o.json")).orderBy("ts").collect()] == [(5, 10.5, None, None), (6, 11.0, None, None)]
    assert [tuple(r) for r in readers.instruments(spark, str(tmp_path / "[in].json")).collect()] == [(10 * day, 3, 1, 2, 30.0, 4.0, 3.0)]


def test_feature_tape(spark, tmp_path):
    columns = ", ".join(f"CAST(id AS FLOAT) AS {c}" for c in (*readers.QFEAT, "ell"))
    spark.range(5).selectExpr("'A' AS symbol", "id AS ts", columns.split(", ", 1)[0], *columns.split(", ")[1:], "1 AS other").write.parquet(str(tmp_path / "q"))
    tape = readers.feature_tape(spark, str(tmp_path / "q"), rows=3)
    assert tape.columns == ["symbol", "ts", *readers.QFEAT, "ell"] and sorted(r["ell"] for r in tape.collect()) == [0.0, 1.0, 2.0]


def test_json_safe(spark, tmp_path):
    df = spark.createDataFrame([(math.nan, [1.0, math.inf], {"a": -math.inf}, (math.nan, 1))], "x double, l array<double>, m map<string,double>, s struct<y:double,z:int>")
    r = writers.json_safe(df).first()
    assert r["x"] is None and r["l"] == [1.0, None] and r["m"] == {"a": None} and r["s"]["y"] is None and r["s"]["z"] == 1
    writers.write_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_logs_have_their_columns(spark, tmp_path):
    df = spark.sql("SELECT 1 AS t, 'A' AS symbol, 'x' AS price, named_struct('posture', 'ACT') AS P5, 9 AS more")
    for schema in (writers.STEP_LOG, writers.TRADE_LOG, writers.TOWER_LOG, writers.RUN_SUMMARY):
        log = writers.as_log(df, schema)
        assert [f"{n} {k.replace('bigint', 'long')}" for n, k in log.dtypes] == schema.split(", ")
    row = writers.as_log(df, writers.TOWER_LOG).first()
    assert row["P5"] == '{"posture":"ACT"}' and row["t"] == 1 and writers.as_log(df, writers.STEP_LOG).first()["price"] is None
    for _ in range(2):
        writers.append_log(df, str(tmp_path / "steps"), writers.STEP_LOG)
    assert spark.read.option("header", True).csv(str(tmp_path / "steps")).count() == 2


def test_csv_to_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    writers.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), "a int, b string")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "x"), (2, "y")]


def test_logs_of_many_layouts(spark, tmp_path):
    (tmp_path / "run_tau_on0.7_tau_off0.4.csv").write_text("a,b\n1,x\n2,\n")
    (tmp_path / "run_tau_on=0.5_tau_off=0.25.csv").write_text('B,c,tau_on\n"y, z",3,9\n')
    rows = readers.named_logs(spark, str(tmp_path))
    assert rows.columns == ["a", "b", "c", "tau_on", "tau_off"]
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "x", None, 0.7, 0.4), ("2", None, None, 0.7, 0.4), (None, "y, z", "3", 0.5, 0.25)]
    assert readers.named_logs(spark, str(tmp_path), ["c"]).where("c IS NOT NULL").count() == 1


def test_named_logs_and_appends(spark, tmp_path):
    (tmp_path / "run_tau_on0.7_tau_off0.4.csv").write_text("a\n1\n")
    r = readers.named_logs(spark, str(tmp_path / "*.csv")).first()
    assert (r["tau_on"], r["tau_off"]) == (0.7, 0.4)
    bars = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS timestamp, 'A' AS symbol, 1.0D AS close")
    for _ in range(2):
        writers.append_bars(bars, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).where("date = '2024-01-01'").count() == 2
