"""The dealt operators: brute force on small fixtures, and nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from tests.helpers import at, ms, rows
from tidewright.functions.times import DAY_US
from tidewright.operators import dedup, grid, intervals, radix, rolling, spikes
from tidewright.operators.scan import carry_scan

READING = "k bigint, t timestamp_ntz, v double, w double, ok boolean, rec bigint, asset string, tick_ms string"
COVER = "k bigint, f timestamp_ntz, l timestamp_ntz, total string"


def reading(k, hours, v=1.0, w=None, ok=True, rec=0):
    return (k, None if hours is None else at(hours), v, w, ok, rec, "clash", "clash")


# carry scan


def test_carry_scan(spark):
    rng = random.Random(3)
    data = [(k, s, rng.choice([None, s * 10])) for k in (1, 2) for s in range(-5, 40) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "k bigint, s bigint, x bigint")
    got = {(r.k, r.s): r for r in carry_scan(df, ["k"], "s", {"b": "x"}, {"a": "x"}, block=4).collect()}
    assert len(got) == len(data)
    for k, s, _ in data:
        back = [(t, x) for j, t, x in data if j == k and x is not None and t < s]
        ahead = [(t, x) for j, t, x in data if j == k and x is not None and t > s]
        assert got[k, s].b == (max(back)[1] if back else None) and got[k, s].a == (min(ahead)[1] if ahead else None)


# 1. rolling totals


def roll(spark, data, cover, **kw):
    r, c = spark.createDataFrame(data, READING), spark.createDataFrame(cover, COVER)
    return rolling.rolling_totals(r, c, ["k"], "t", {"v": "v", "w": "w"}, "f", "l", arrival=["rec"], **kw)


@pytest.mark.parametrize("shard_days", [8, 31, 256])
def test_rolling_totals_brute_force(spark, shard_days):
    rng = random.Random(1)
    data = [reading(rng.choice([1, 2]), 6 * rng.randrange(0, 400), rng.choice([0.0, 1.0, 2.5, None, math.nan]), rng.random(), rec=i) for i in range(300)]
    cover = [(k, at(0), at(24 * 90), "x") for k in (1, 2, 3)]
    got = {(r.k, r.asset, r.activity_day, r.window_days): r for r in roll(spark, data, cover, windows=(3, 7), shard_days=shard_days).collect()}
    assert len(got) == 3 * 91 * 2 * 2
    first = {}
    for d in data:
        first.setdefault((d[0], d[1]), d)
    for (k, label, day, n), r in got.items():
        end = dt.date.fromisoformat(day)
        days = {end - dt.timedelta(i) for i in range(n)}
        i = 2 if label == "v" else 3
        value = lambda d: d[i] if d[i] is not None and not math.isnan(d[i]) else 0.0
        total = sum(value(d) for d in first.values() if d[0] == k and d[1].date() in days)
        assert r.total == pytest.approx(total) and r.daily_average == pytest.approx(total / n)
        assert r.active_readings == sum(1 for d in data if d[0] == k and d[1].date() in days and value(d) > 0)


def test_rolling_totals_defined_cases(spark):
    cover = [(1, at(0), at(24), "x"), (1, at(0), at(24), "x"), (2, None, at(0), "x"), (3, at(48), at(0), "x"), (None, at(0), at(0), "x")]
    got = roll(spark, [reading(1, -24, 5.0), reading(1, None), reading(None, 0, 7.0), reading(9, 0)], cover, windows=(2,))
    assert {(r.k, r.asset, r.activity_day): r.total for r in got.collect() if r.asset == "v"} == {(1, "v", "2024-01-01"): 5.0, (1, "v", "2024-01-02"): 0.0, (None, "v", "2024-01-01"): 7.0}
    assert roll(spark, [], []).count() == 0
    with pytest.raises(ValueError):
        roll(spark, [], [], shard_days=7)


# 2. regular grid


def regular(spark, data, cover, **kw):
    r, c = spark.createDataFrame(data, READING), spark.createDataFrame(cover, COVER)
    return grid.regular_grid(r, c, ["k"], "t", "f", "l", "ok", values=["v"], arrival=["rec"], **kw)


@pytest.mark.parametrize("shard_steps", [1, 3, 512])
@pytest.mark.parametrize("offset", [0, 2])
def test_regular_grid_brute_force(spark, shard_steps, offset):
    rng = random.Random(2)
    data = [reading(k, rng.randrange(-20, 600) / 2, float(i), ok=rng.choice([True, False, None]), rec=i) for i in range(60) for k in (1, 2)]
    data += [(*d[:2], -1.0, *d[3:5], d[5] + 1000, *d[6:]) for d in data[:20]]
    cover = [(1, at(offset), at(offset + 240), "x"), (2, at(offset), at(offset + 120), "x"), (3, at(0), at(12), "x")]
    got = {(r.k, r.tick_ms): r for r in regular(spark, data, cover, shard_steps=shard_steps).collect()}
    seen = 0
    for k, f, l, _ in cover:
        last, ticks = None, []
        t = f
        while t <= l:
            inside = [d for d in data if d[0] == k and t <= d[1] < t + dt.timedelta(hours=6)]
            good = [d for d in inside if d[4]]
            best = min(good, key=lambda d: (-ms(d[1]), d[5])) if good else None
            ticks.append((t, inside, best))
            t += dt.timedelta(hours=6)
        for i, (t, inside, best) in enumerate(ticks):
            r = got[k, ms(t)]
            last = i if best else last
            assert r.is_missing == (best is None) and r.readings == len(inside)
            assert r.v == (best[2] if best else None) and r.reading_ms == (ms(best[1]) if best else None)
            assert r.periods_since_reading == (None if last is None else i - last)
            assert r.v_carried == (None if last is None else ticks[last][2][2])
            nxt = next((j for j in range(i, len(ticks)) if ticks[j][2]), None)
            assert r.periods_to_reading == (None if nxt is None else nxt - i)
            seen += 1
    assert seen == len(got)


def test_regular_grid_defined_cases(spark):
    assert regular(spark, [], []).count() == 0
    got = regular(spark, [reading(1, None), reading(2, 1), reading(None, 1, 4.0)], [(1, None, at(1), "x"), (2, at(6), at(0), "x"), (None, at(0), at(0), "x")])
    assert [(r.k, r.is_missing, r.v) for r in got.collect()] == [(None, False, 4.0)]


# 3. intervals

SPAN = "k bigint, g string, a timestamp_ntz, b timestamp_ntz, period_end_ms string"


def brute_periods(data, tolerance_h):
    out = {}
    for key in {(d[0], d[1]) for d in data}:
        own = sorted((d[2], d[3]) for d in data if (d[0], d[1]) == key and d[2] and d[3] and d[3] >= d[2])
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1] + dt.timedelta(hours=tolerance_h):
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[key] = merged
    return out


@pytest.mark.parametrize("days", [1, 5, 64])
@pytest.mark.parametrize("tolerance", [0, 6])
def test_intervals_brute_force(spark, days, tolerance):
    rng = random.Random(days + tolerance)
    data = []
    for _ in range(250):
        a = rng.randrange(0, 3000)
        data.append((rng.choice([1, 2, None]), rng.choice(["x", "y"]), at(a), at(a + rng.choice([-3, 0, 0, 6, 12, 30, 200])), "clash"))
    data += data[:30] + [(1, "x", None, at(3), "c"), (1, "x", at(3), None, "c")]
    df = spark.createDataFrame(data, SPAN)
    kw = {"tolerance_us": tolerance * 3_600_000_000, "shard_us": days * DAY_US}
    want = brute_periods(data, tolerance)
    periods = rows(intervals.interval_periods(df, ["k", "g"], "a", "b", **kw))
    assert periods == sorted(((k, g, ms(a), ms(b)) for (k, g), m in want.items() for a, b in m), key=lambda r: tuple(map(str, r)))
    gaps = rows(intervals.interval_gaps(df, ["k", "g"], "a", "b", **kw))
    assert gaps == sorted(((k, g, ms(p[1]), ms(n[0])) for (k, g), m in want.items() for p, n in zip(m, m[1:])), key=lambda r: tuple(map(str, r)))


def test_interval_touch_is_exact(spark):
    us = dt.timedelta(microseconds=1)
    data = [(1, "x", at(0), at(1), ""), (1, "x", at(7), at(8), ""), (1, "x", at(14) + us, at(15), "")]
    df = spark.createDataFrame(data, SPAN)
    assert rows(intervals.interval_gaps(df, ["k", "g"], "a", "b")) == [(1, "x", ms(at(8)), ms(at(14)))]
    assert intervals.interval_gaps(df.limit(0), ["k", "g"], "a", "b").count() == 0


def test_interval_keys_keep_their_type_and_value(spark):
    big, us = 2**53 + 1, dt.timedelta(microseconds=1)
    data = [(big, None, at(0), at(1), at(0)), (big + 1, at(0) + us, at(20), at(21), at(0)), (None, at(0) + 2 * us, at(0), at(1), at(0)), (None, None, at(0), at(1), at(0)), (None, at(0) + us, at(0), at(1), at(0))]
    df = spark.createDataFrame(data, "k bigint, t timestamp_ntz, a timestamp_ntz, b timestamp_ntz, __low timestamp_ntz")
    out = intervals.interval_periods(df, ["k", "t"], "a", "b")
    assert [t for _, t in out.dtypes[:2]] == ["bigint", "timestamp_ntz"]
    assert {(r.k, r.t) for r in out.collect()} == {(d[0], d[1]) for d in data}


def test_run_bitmaps_unite_as_sets(spark):
    rng = np.random.default_rng(3)
    for _ in range(50):
        every, bits = set(), None
        for _ in range(4):
            low = rng.integers(0, 60, 6)
            high = low + rng.integers(1, 9, 6)
            one = intervals.RunBitmap.of(low, high)
            bits = one if bits is None else bits | intervals.RunBitmap.from_bytes(one.to_bytes())
            every |= {u for a, b in zip(low, high) for u in range(a, b)}
        assert {u for a, b in bits.runs for u in range(a, b)} == every
        assert (bits.runs[1:, 0] > bits.runs[:-1, 1]).all()


# exact order statistics of large groups

QS = (0.01, 0.05, 0.5, 0.95, 0.99)


def percentile_data():
    rng = np.random.default_rng(5)
    data = [("normal", float(x)) for x in rng.normal(0, 0.1, 5000)] + [("ties", float(x)) for x in rng.integers(-3, 4, 501)]
    data += [("one", -2.5), ("none", None), ("none", math.nan), (None, 4.0), (None, 8.0), ("signs", -0.0), ("signs", 0.0), ("ends", math.inf), ("ends", -math.inf), ("ends", 1.0)]
    return data + [("tiny", 5e-324 * i) for i in range(50)]


@pytest.mark.parametrize("digits", [(16, 16, 32), (8, 24, 32), (64,)])
def test_exact_percentiles(spark, digits):
    df = spark.createDataFrame(percentile_data(), "g string, x double")
    for r in radix.exact_percentiles(df, ["g"], "x", QS, digits).collect():
        xs = [x for g, x in percentile_data() if g == r.g and x is not None and not math.isnan(x)]
        assert r.n_values == len(xs)
        for q in QS:
            got = r[radix.quantile_name(q)]
            if not xs:
                assert got is None
            elif r.g != "ends":
                assert got == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-300)
    assert radix.exact_percentiles(df.limit(0), ["g"], "x", QS).count() == 0


def test_exact_percentiles_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(radix, "BROADCAST_ROWS", 0)
    test_exact_percentiles(spark, (16, 16, 32))


def test_quantile_names():
    assert [radix.quantile_name(q) for q in (0.01, 0.05, 0.5, 0.025, 0.999)] == ["q01", "q05", "q50", "q2_5", "q99_9"]


# 5. copies

MESSAGE = "row_id bigint, m string, rec bigint, __rank int"


def test_keep_first_and_copies(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), rng.choice([1, 2, 3, None]), 0) for i in range(200)]
    df = spark.createDataFrame(data, MESSAGE)
    assert dedup.keep_first(df, ["m"], ["rec", "row_id"]).columns == df.columns
    kept = {r.row_id for r in dedup.keep_first(df, ["m"], ["rec", "row_id"]).collect()}
    want = {d[0] for d in data if d[1] is None}
    for m in {d[1] for d in data} - {None}:
        want.add(min((d for d in data if d[1] == m), key=lambda d: (d[2] is None, d[2] or 0, d[0]))[0])
    assert kept == want
    copies = [r.row_id for r in dedup.further_copies(df, ["m"], ["rec"], "row_id").collect()]
    assert sorted(copies) == sorted({d[0] for d in data} - want)
    assert dedup.keep_first(df.limit(0), ["m"], ["rec"]).count() == 0
    assert dedup.further_copies(df.limit(0), ["m"], ["rec"], "row_id").count() == 0


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 1)], "row_id bigint, m string, rec bigint")
    assert dedup.keep_first(df, ["m"], ["rec", "row_id"]).count() == 1
    assert rows(dedup.further_copies(df, ["m"], ["rec"], "row_id")) == [(2,)]


def test_accept_batch(spark):
    schema = "row_id bigint, m string, rec bigint"
    stored = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "a", 2)], schema)
    batch = spark.createDataFrame([(4, "a", 3), (5, "b", 5), (6, "b", 4), (7, None, 4)], schema)
    got = {r.row_id for r in dedup.accept_batch(batch, stored.where("m is not null"), ["m"], ["rec", "row_id"]).collect()}
    assert got == {6, 7}


def test_symbols(spark):
    instruments = spark.createDataFrame([("BTCUSDT", "BTC"), ("ETHBTC", "ETH"), (None, "x")], "symbol string, out string")
    spelled = ["btc/usdt", "BTC USDT", "Btc_Usdt", " btc-usdt ", None, "eth.btc", "zzz"]
    df = spark.createDataFrame([(s, "clash", "clash") for s in spelled], "symbol string, out string, __canonical string")
    got = {r.symbol: r.out for r in dedup.resolve_symbols(df, instruments, "symbol", "out").collect()}
    assert got == {"btc/usdt": "BTCUSDT", "BTC USDT": "BTCUSDT", "Btc_Usdt": "BTCUSDT", " btc-usdt ": "BTCUSDT", None: None, "eth.btc": "ETHBTC", "zzz": "ZZZ"}


# 6. implausible readings

CANDLE = "k bigint, t timestamp_ntz, o double, h double, l double, c double, v double, ok boolean, rec bigint, measure string"
COLUMNS = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}


def candles(n=400, k=1, seed=4):
    rng = np.random.default_rng(seed)
    out, price = [], 1000.0 * k
    for i in range(n):
        close = price * math.exp(rng.normal(0, 0.01))
        top, bottom = max(price, close), min(price, close)
        out.append([k, at(6 * i), price, top * math.exp(abs(rng.normal(0, 0.004))), bottom * math.exp(-abs(rng.normal(0, 0.004))), close, math.exp(rng.normal(3, 0.3)), True, i, "clash"])
        price = close
    return out


def flagged(spark, data):
    df = spark.createDataFrame([tuple(d) for d in data], CANDLE)
    out = spikes.implausible_readings(df, ["k"], "t", "ok", COLUMNS, ["rec"]).collect()
    return {(r.k, r.open_time_ms, r.measure) for r in out}


def test_ordinary_candles_are_not_flagged(spark):
    data = candles()
    for d in data[200:]:  # a lasting change of level is no case
        d[2], d[3], d[4], d[5], d[6] = d[2] * 2, d[3] * 2, d[4] * 2, d[5] * 2, d[6] * 6
    data[50][6] = data[51][6] = data[52][6]  # nor are three equal readings
    assert flagged(spark, data) == set()


def test_faulty_readings_are_flagged(spark):
    data = candles() + candles(k=2, n=300, seed=9)
    want = set()

    def fault(i, measure, **values):
        for c, v in values.items():
            data[i][{"h": 3, "l": 4, "v": 6}[c]] = v
        want.add((data[i][0], ms(data[i][1]), measure))

    fault(20, "price", h=data[20][3] * 1.5)
    fault(40, "price", l=data[40][4] * 0.7)
    fault(60, "price", h=-1.0)
    fault(70, "price", h=data[70][4] * 0.99)
    fault(80, "volume", v=-5.0)
    fault(90, "volume", v=data[90][6] * 200)
    fault(100, "volume", v=data[100][6] / 300)
    fault(110, "volume", v=math.nan)
    for i in range(120, 127):
        fault(i, "volume", v=7.0)
    peak = max(d[3] for d in data[500:508]) * 1.001
    for i in range(500, 508):
        fault(i, "price", h=peak)
    for i in (*range(180, 183), *range(560, 562), 600):  # all prices of up to three candles move together and come back
        for j in range(2, 6):
            data[i][j] *= 1.4 if i < 500 else 0.1
        want.add((data[i][0], ms(data[i][1]), "price"))
    data[150][3] = None  # unknown is not faulty
    data[160][7], data[160][3] = None, -1.0  # nor does an incomplete reading count
    data.append(list(data[20]))
    assert flagged(spark, data) == want


def test_a_genuine_rise_and_fall_is_not_flagged(spark):
    data = candles()
    for n, i in enumerate(range(100, 116)):  # up and down again over eight candles each, far from the level before
        f = math.exp(0.02 * min(n + 1, 16 - n))
        for j in range(2, 6):
            data[i][j] *= f
    assert flagged(spark, data) == set()


def test_spikes_of_nothing(spark):
    assert flagged(spark, []) == set()
    assert flagged(spark, [[None, at(0), 1.0, 1.0, 1.0, 1.0, None, True, None, "x"], [1, None, 1.0, 0.0, 1.0, 1.0, 1.0, True, 1, "x"]]) == set()


def test_reserved_names_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0)], "n string, x double")
    with pytest.raises(ValueError):
        radix.exact_percentiles(df, ["n"], "x", QS)
