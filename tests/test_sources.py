"""Sources, artifacts and streams: round trips, pages, retries, refusals."""

import datetime as dt
import email.message
import io
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import at
from tidewright.functions.times import HOUR_US
from tidewright.sources import artifacts, candles
from tidewright.streaming import streams

STEP = 21_600_000


def raw(i):
    return [i * STEP, "1", "2", "0.5", "1.5", "10", i * STEP + STEP - 1, "15", 7, "5", "7.5", "0"]


def service(total, log=None):
    def fetch(symbol, interval, start_ms, end_ms, limit):
        if log is not None:
            log.append(start_ms)
        first = -(-start_ms // STEP)
        return [raw(i) for i in range(first, total) if i * STEP <= end_ms][:limit]

    return fetch


def test_pages():
    log = []
    got = list(candles.KlinePages(service(1001, log)).rows("X", "6h", 0, 2000 * STEP))
    assert len(got) == 1001 and log == [0, 1000 * STEP]
    assert [r[0] for r in candles.KlinePages(service(50), page=3).rows("X", "6h", 5 * STEP, 9 * STEP)] == [i * STEP for i in range(5, 9)]
    with pytest.raises(RuntimeError):
        list(candles.KlinePages(lambda *a: [raw(0)], page=1).rows("X", "6h", 5 * STEP, 9 * STEP))
    with pytest.raises(ValueError):
        list(candles.KlinePages(service(1)).rows("X", "7h", 0, 1))


def test_kline_source(spark):
    spark.dataSource.register(candles.kline_source(service(1001), "recorded"))
    df = spark.read.format("recorded").options(symbols="X,Y", interval="6h", start_ms=0, end_exclusive_ms=900 * STEP, spans=3, page=100).load()
    assert df.rdd.getNumPartitions() == 6 and df.count() == 1800 and df.select("symbol", "open_time_ms").distinct().count() == 1800
    assert df.where("high <> 2.0 or number_of_trades <> 7").count() == 0


def test_retries():
    waits, answers = [], []

    def error(code, after=None):
        headers = email.message.Message()
        if after:
            headers["Retry-After"] = after
        return urllib.error.HTTPError("u", code, "x", headers, None)

    def opener(url, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return io.BytesIO(json.dumps(a).encode())

    fetch = candles.http_fetch("http://x", opener=opener, sleep=waits.append)
    answers[:] = [error(429, "7"), error(503), urllib.error.URLError("down"), [[1]]]
    assert fetch("X", "6h", 0, 1, 1) == [[1]] and waits == [7.0, 2, 4]
    answers[:] = [error(404)]
    with pytest.raises(urllib.error.HTTPError):
        fetch("X", "6h", 0, 1, 1)
    answers[:] = [error(500)] * 5
    with pytest.raises(urllib.error.HTTPError):
        fetch("X", "6h", 0, 1, 1)


def test_csv_round_trip(spark, tmp_path):
    data = [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5, 59, 59, 999000), 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 7, 5.0, 7.5)]
    schema = candles.T.StructType(candles.CANDLE_SCHEMA.fields[:11])
    df = candles.with_provenance(spark.createDataFrame(data, schema), "Ex", "spot", "btcusdt", "BTC", "USDT", "6h")
    candles.write_csv(df.select(*reversed(df.columns)), str(tmp_path / "c"))
    back = candles.read_csv(spark, str(tmp_path / "c"))
    assert back.schema.names == candles.CANDLE_SCHEMA.names and back.exceptAll(df).count() == 0 and back.first().symbol == "BTCUSDT"
    candles.write_csv(df.drop("open"), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="open"):
        candles.read_csv(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        candles.with_provenance(df, "E", "spot", "X", "X", "Y", "7h")


def test_validating_readers(spark):
    t = spark.createDataFrame([(at(0),), (at(6),), (at(12),)], "t timestamp_ntz")
    assert candles.regular_calendar(t, "t", 6 * HOUR_US).count() == 3
    with pytest.raises(ValueError, match="irregular"):
        candles.regular_calendar(t.where(F.col("t") != F.lit(at(6)).cast("timestamp_ntz")), "t", 6 * HOUR_US)
    r = "x double, returns_valid boolean, invalid_reason string"
    candles.checked_returns(spark.createDataFrame([(1.0, True, ""), (None, False, "first_observation")], r), ["x"])
    for bad in [(None, True, ""), (1.0, True, "x"), (1.0, False, "x"), (None, False, "")]:
        with pytest.raises(ValueError):
            candles.checked_returns(spark.createDataFrame([bad], r), ["x"])
    i = "sample_id bigint, target_start_ms bigint, split string"
    good = spark.createDataFrame([(0, 1, "train"), (1, 2, "test")], i)
    candles.checked_index(good)
    candles.checked_partition(good, ["train", "test"])
    for bad in [[(0, 1, "a"), (2, 2, "a")], [(0, 2, "a"), (1, 2, "a")]]:
        with pytest.raises(ValueError):
            candles.checked_index(spark.createDataFrame(bad, i))
    for bad in [[(0, 1, "odd")], [(0, 1, "train"), (0, 1, "test")], [(0, 1, None)]]:
        with pytest.raises(ValueError):
            candles.checked_partition(spark.createDataFrame(bad, i), ["train", "test"])


def test_strict_candles(spark):
    from tidewright.operators.panel import VALUES

    row = {"open_time_utc": at(0), "symbol": "X", "interval": "6h", **{v: 1.0 for v in VALUES}}
    make = lambda *changes: spark.createDataFrame([row | c for c in changes], "open_time_utc timestamp_ntz, symbol string, interval string, " + ", ".join(f"{v} double" for v in VALUES))
    candles.checked_candles(make({}, {"open_time_utc": at(6)}), {"symbol": "X"})
    for bad, why in (([], "no row"), ([{}, {}], "repeated"), ([{"open_time_utc": None}], "unknown open time"), ([{"close": None}], "unknown value"), ([{}, {"open_time_utc": at(6), "symbol": "Y"}], "several"), ([{"symbol": "Y"}], "another symbol")):
        with pytest.raises(ValueError, match=why):
            candles.checked_candles(make(*bad), {"symbol": "X"} if why.startswith("another") else None)


def test_strict_panel(spark):
    names = ("open", "high", "low", "close", "volume")
    make = lambda *rows: spark.createDataFrame([(1, at(6 * i), ok, *v) for i, (ok, v) in enumerate(rows)], "k bigint, open_time_utc timestamp_ntz, is_complete boolean, " + ", ".join(f"a_{n} double" for n in names))
    fine = (True, (2.0, 3.0, 1.0, 2.5, 0.0))
    candles.checked_panel(make(fine, (False, (None,) * 5), (None, (9.0, 1.0, 2.0, 3.0, -1.0)), fine), ["a"], ["k"])
    for v in ((2.0, 3.0, 2.2, 2.5, 1.0), (2.0, 2.4, 1.0, 2.5, 1.0), (2.0, 3.0, 0.0, 2.5, 1.0), (None, 3.0, 1.0, 2.5, 1.0), (2.0, 3.0, 1.0, 2.5, -1.0)):
        with pytest.raises(ValueError, match="a price|a volume"):
            candles.checked_panel(make(fine, (True, v)), ["a"], ["k"])
    with pytest.raises(ValueError, match="repeated"):
        candles.checked_panel(make(fine).union(make(fine)), ["a"], ["k"])


def test_sums(tmp_path):
    import hashlib

    big = b"0123456789" * 300_000
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.bin").write_bytes(big)
    (tmp_path / "a.txt").write_bytes(b"abc")
    sums = artifacts.local_checksums([str(tmp_path / "d" / "b.bin"), str(tmp_path / "a.txt")], chunk=1000)
    artifacts.write_sums(str(tmp_path / "SHA256SUMS"), sums, str(tmp_path))
    assert (tmp_path / "SHA256SUMS").read_text() == f"{hashlib.sha256(b'abc').hexdigest()}  a.txt\n{hashlib.sha256(big).hexdigest()}  d/b.bin\n"


def test_artifacts(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    got = artifacts.file_checksums(spark, str(tmp_path / "f")).first()
    assert got.sha256 == hashlib.sha256(b"abc").hexdigest() and got.length == 3
    df = spark.createDataFrame([(1, "a"), (2, None)], "x bigint, y string")
    one = artifacts.table_checksum(df).first()
    assert one == artifacts.table_checksum(df.orderBy(F.desc("x")).select("y", "x")).first()
    assert one != artifacts.table_checksum(df.withColumn("x", F.col("x") + 1)).first()
    m = artifacts.write_manifest(str(tmp_path / "m" / "manifest.json"), {"in": df}, {"out": df}, {"c": 24})
    assert json.loads((tmp_path / "m" / "manifest.json").read_text()) == m and m["inputs"]["in"]["n_rows"] == 2
    assert artifacts.portable_path(str(tmp_path / "f"), str(tmp_path)) == "f" and artifacts.portable_path("/elsewhere", str(tmp_path)) == "/elsewhere"


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5)], "i bigint, x double")
    b = spark.createDataFrame([(2, {"w": 0.6})], "i bigint, m map<string,double>")
    both = artifacts.union_reports([a, b])
    artifacts.write_report(both, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 2
    texts = {r.m for r in spark.read.option("header", True).csv(str(tmp_path / "r" / "csv")).collect()}
    assert {json.dumps(json.loads(t)) for t in texts if t} == {'{"w": 0.6}'}
    with pytest.raises(ValueError, match="NaN"):
        artifacts.write_report(a.withColumn("x", F.lit(float("nan"))), str(tmp_path / "n"))


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "w.npz", x=np.arange(12.0).reshape(3, 2, 2), i=np.arange(3))
    got = artifacts.read_npz(spark, str(tmp_path), ["x", "i"]).orderBy("row_no").collect()
    assert [r.x for r in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]] and [r.i for r in got] == [[0], [1], [2]]
    with pytest.raises(Exception, match="lacks"):
        artifacts.read_npz(spark, str(tmp_path), ["y"]).collect()
    np.savez(tmp_path / "odd.npz", x=np.zeros((2, 1)), i=np.zeros(3))
    with pytest.raises(Exception, match="differ"):
        artifacts.read_npz(spark, str(tmp_path), ["x", "i"], "odd.npz").collect()


EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def events():
    hours = [0, 1, 2, 7, 8, 30, 31, 60]
    return [(i, at(h), 1, "click", v) for i, (h, v) in enumerate(zip(hours, [5.0, 9.0, 3.0, 4.0, 0.0, 6.0, 12.0, 1.0]))]


def test_streams_equal_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame(events(), EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = lambda: streams.event_stream(spark, str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in" / "events.parquet"))
    got = streams.run_available(streams.closed_candles(stream()))
    whole = streams.closed_candles(table)
    closed = whole.where(F.col("close_time") <= F.lit(at(54)))
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0 and 0 < got.count() < whole.count()
    first = got.orderBy("open_time").first()
    assert (first.open, first.high, first.low, first.close, first.events) == (5.0, 9.0, 3.0, 3.0, 3)
    assert sorted(r.events for r in streams.run_available(streams.sessions(stream())).collect()) == [2, 5]
    falls = {r.event_id: r.drawdown for r in streams.run_available(streams.running_drawdown(stream())).collect()}
    assert falls == pytest.approx({0: 0, 1: 0, 2: 6 / 9, 3: 5 / 9, 5: 3 / 9, 6: 0, 7: 11 / 12})
