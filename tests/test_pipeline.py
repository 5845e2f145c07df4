"""Candles to windows: the small cases with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import at, ms, rows
from tidewright.functions.times import HOUR_US
from tidewright.operators import generators, panel, windows
from tidewright.plans.pipeline import _split

CANDLE = "e bigint, asset string, t timestamp_ntz, close_t timestamp_ntz, open double, high double, low double, close double, volume double"


def candle(asset, hours, close, length=6.0, e=1):
    return (e, asset, at(hours), at(hours + length) - dt.timedelta(milliseconds=1), close, close + 1, close - 1, close, 1.0)


def built(spark, data):
    return panel.build_panel(spark.createDataFrame(data, CANDLE), "e", "asset", ("a", "b"), "t", "close_t")


def test_panel_gap(spark):
    p = built(spark, [candle(x, h, 10.0) for x in "ab" for h in (0, 12)])
    got = {r.tick_ms: r for r in p.collect()}
    assert len(got) == 3
    gap = got[ms(at(6))]
    assert gap.a_close is None and gap.a_missing and gap.b_missing and not gap.is_complete and not gap.a_duration_valid
    audit = panel.panel_audit(p, "e", ("a", "b")).first()
    assert (audit.calendar_rows, audit.complete_rows, audit.common_missing_rows, audit.one_sided_missing_rows) == (3, 2, 1, 0)


def test_panel_truncated_candle_keeps_values(spark):
    p = built(spark, [candle(x, 0, 10.0, 4.0) for x in "ab"])
    r = p.first()
    assert r.a_close == 10.0 and r.a_source_close_ms == ms(at(4)) - 1 and r.expected_close_ms == ms(at(6)) - 1
    assert not r.a_duration_valid and not r.is_complete
    assert panel.panel_audit(p, "e", ("a", "b")).first().common_invalid_rows == 1


def test_panel_covers_the_intersection(spark):
    data = [candle("a", h, 1.0) for h in (0, 6, 12, 18)] + [candle("b", h, 1.0) for h in (6, 12, 18, 24)] + [candle("a", 0, 1.0, e=2), candle("b", 6, 1.0, e=2), candle("a", 7, 1.0)]
    p = built(spark, data)
    assert sorted(r.tick_ms for r in p.collect()) == [ms(at(h)) for h in (6, 12, 18)]
    have = spark.createDataFrame(data[:1], CANDLE)
    assert panel.panel_gaps(p, have, "e", "asset", ("a", "b"), "t").count() == 6
    with pytest.raises(ValueError):
        panel.build_panel(have, "e", "asset", ("a", "a"), "t", "close_t")
    assert built(spark, []).count() == 0


def test_audit_of_candles(spark):
    data = [(1, at(0), 1.0, 1.0), (1, at(0), 1.0, 1.0), (1, at(12), 0.0, -1.0)]
    df = spark.createDataFrame(data, "s bigint, t timestamp_ntz, p double, v double")
    cols = {n: "p" for n in panel.PRICES} | {"volume": "v"}
    r = panel.candle_audit(df, ["s"], "t", F.lit(6 * HOUR_US).cast("bigint"), cols).first()
    assert (r.observed_rows, r.expected_rows, r.duplicate_open_times, r.missing_open_times, r.non_positive_ohlc_rows, r.negative_volume_rows) == (3, 3, 1, 1, 1, 1)


def simple_panel(spark, data):
    schema = "e bigint, tick_ms bigint, a_close double, b_close double, is_complete boolean"
    return spark.createDataFrame([(1, ms(at(6 * i)), *d) for i, d in enumerate(data)], schema)


def test_log_returns(spark):
    got = panel.log_returns(simple_panel(spark, [(100.0, 50.0, True), (110.0, 40.0, True)]), "e", ("a", "b")).orderBy("tick_ms").collect()
    assert got[0].invalid_reason == "first_observation" and got[0].a_log_return is None and not got[0].returns_valid
    assert got[1].a_log_return == pytest.approx(math.log(1.1)) and got[1].b_log_return == pytest.approx(math.log(0.8)) and got[1].invalid_reason == ""


def test_returns_do_not_bridge_gaps(spark):
    out = panel.log_returns(simple_panel(spark, [(1.0, 1.0, True), (None, None, False), (None, None, False), (1.0, 1.0, True), (2.0, 2.0, True)]), "e", ("a", "b"))
    assert [r.invalid_reason for r in out.orderBy("tick_ms").collect()] == ["first_observation", "current_incomplete", "current_incomplete|previous_incomplete", "previous_incomplete", ""]
    assert rows(panel.return_audit(out, "e")) == rows(spark.createDataFrame([(1, x, 1) for x in ("first_observation", "current_incomplete", "current_incomplete|previous_incomplete", "previous_incomplete", "")], "e bigint, r string, n bigint"))


def simple_returns(spark, n, invalid=(), entity=1):
    data = [(entity, ms(at(6 * i)), i, i / 100, -i / 100, i not in invalid) for i in range(n)]
    return spark.createDataFrame(data, "e bigint, tick_ms bigint, tick_no bigint, a_log_return double, b_log_return double, returns_valid boolean")


def test_windows(spark):
    got = windows.window_index(windows.candidate_windows(simple_returns(spark, 6), "e", 2, 2), "e").orderBy("sample_id").collect()
    assert [(r.start_index, r.sample_id) for r in got] == [(0, 0), (1, 1), (2, 2)]
    assert (got[0].condition_start_ms, got[0].condition_end_ms, got[0].target_start_ms, got[0].target_end_ms) == tuple(ms(at(6 * i)) for i in range(4))


def test_windows_reject_gaps(spark):
    cand = windows.candidate_windows(simple_returns(spark, 10, {4}), "e", 2, 2)
    assert sorted(r.start_index for r in windows.window_index(cand, "e").collect()) == [0, 5, 6]
    audit = windows.window_audit(cand, "e").first()
    assert (audit.candidates, audit.accepted, audit.rejected_condition + audit.rejected_target + audit.rejected_both) == (7, 3, 4)


def test_windows_stride_and_rest(spark):
    cand = windows.candidate_windows(simple_returns(spark, 10), "e", 2, 2, 2)
    assert sorted(r.start_index for r in windows.window_index(cand, "e").collect()) == [0, 2, 4, 6]
    assert windows.candidate_windows(simple_returns(spark, 3), "e", 2, 2).count() == 0
    with pytest.raises(ValueError):
        windows.candidate_windows(simple_returns(spark, 3), "e", 0, 2)


def test_counts_of_the_published_snapshot(spark):
    """A 6-hour calendar with 18 incomplete ticks has known numbers of returns, windows and splits."""
    first, last = dt.datetime(2017, 8, 17), dt.datetime(2026, 7, 31)
    gaps = """2018-02-08T06 2018-02-08T12 2018-02-08T18 2018-02-09T00 2018-06-26T06 2019-05-15T06 2017-09-06T12 2018-02-08T00 2018-06-26T00 2018-07-04T00 2018-11-14T00
    2019-03-12T00 2019-05-15T00 2019-08-15T00 2020-02-19T06 2020-12-21T12 2021-04-25T00 2021-08-13T00""".split()
    broken = {ms(dt.datetime.strptime(g, "%Y-%m-%dT%H")) for g in gaps}
    n = (last - first) // dt.timedelta(hours=6) + 1
    data = [(1, ms(first + dt.timedelta(hours=6 * i)), 1.0 + i, 2.0 + i) for i in range(n)]
    p = spark.createDataFrame([(*d, d[1] not in broken) for d in data], "e bigint, tick_ms bigint, a_close double, b_close double, is_complete boolean")
    ret = panel.log_returns(p, "e", ("a", "b")).cache()
    reasons = {r.invalid_reason: r.n for r in panel.return_audit(ret, "e").collect()}
    assert reasons == {"": 13_050, "first_observation": 1, "current_incomplete": 12, "previous_incomplete": 12, "current_incomplete|previous_incomplete": 6}
    cand = windows.candidate_windows(ret, "e", 240, 120)
    a = windows.window_audit(cand, "e").first()
    assert (a.candidates, a.accepted, a.rejected_condition, a.rejected_target, a.rejected_both) == (12_722, 9_096, 2_379, 1_095, 152)
    cuts = [ms(dt.datetime(*d)) for d in ((2023, 7, 1), (2023, 10, 1), (2025, 1, 1), (2025, 4, 1))]
    windows.check_cuts(cuts, 90 * 86_400_000, 360 * 6 * 3_600_000)
    split = windows.assign_split(windows.window_index(cand, "e"), [F.lit(c) for c in cuts]).cache()
    audit = {r.split: r for r in windows.split_audit(split, "e").collect()}
    assert {k: r.windows for k, r in audit.items()} == {"train": 4_710, "purge_train_validation": 368, "validation": 1_832, "purge_validation_test": 360, "test": 1_826}
    hours = lambda a, b: (audit[b].first_condition_ms - audit[a].last_target_ms) / 3_600_000
    assert hours("train", "validation") == 60 and hours("validation", "test") == 12
    assert windows.covered_returns(ret, split, "e", 240, 120).count() == 8_300
    assert windows.non_overlapping(split.where("split = 'test'").withColumn("sample_id", F.col("sample_id") - 7_270), 120).count() == 16


def test_cuts_are_checked():
    with pytest.raises(ValueError):
        windows.check_cuts([3, 2, 5, 9], 1, 1)
    with pytest.raises(ValueError):
        windows.check_cuts([1, 2, 5, 9], 2, 1)


def test_features(spark):
    r = [0.01, 0.02, -0.01, 0.03]
    data = [(1, ms(at(6 * i)), i, x, 2 * x, True, 110.0 + i, 100.0 + i, 10.0 + i, 55.0 + i, 50.0 + i, 20.0 + i) for i, x in enumerate([*r, 0.0])]
    cols = "e bigint, tick_ms bigint, tick_no bigint, a_log_return double, b_log_return double, returns_valid boolean, a_high double, a_low double, a_volume double, b_high double, b_low double, b_volume double"
    out = windows.condition_features(spark.createDataFrame(data, cols), "e", ("a", "b"), 4, 1, 2, 3, 4).collect()
    assert len(out) == 1
    f = out[0].asDict()
    assert f["a_cumulative_log_return"] == pytest.approx(0.05) and f["b_cumulative_log_return"] == pytest.approx(0.10) and f["correlation"] == pytest.approx(1.0)
    v = [math.log1p(10 + i) for i in range(4)]
    mean, sd = sum(v) / 4, math.sqrt(sum((x - sum(v) / 4) ** 2 for x in v) / 3)
    assert f["a_log_volume_z"] == pytest.approx((sum(v[2:]) / 2 - mean) / sd)
    assert f["a_log_volume_change"] == pytest.approx(sum(v[2:]) / 2 - sum(v[:2]) / 2)
    assert f["a_current_drawdown"] == pytest.approx(0.0) and f["a_mean_log_range"] == pytest.approx((math.log(112 / 102) + math.log(113 / 103)) / 2)
    with pytest.raises(ValueError):
        windows.feature_columns("e", ("a", "b"), 4, 3, 3, 4)


def test_zscore(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 1.0, 4.0)], "e bigint, i bigint, x double, y double")
    fit = windows.zscore_fit(df, ["e"], ["x", "y"])
    got = {r.column: r for r in fit.collect()}
    assert got["x"].scale == 1.0 and got["x"].zero_variance and got["y"].mean == 3.0 and got["y"].scale == 1.0
    z = {(r.i, r.column): r.z for r in windows.zscore_apply(df, fit, ["e"], ["i"], ["x", "y"]).collect()}
    assert z == {(0, "x"): 0.0, (1, "x"): 0.0, (0, "y"): -1.0, (1, "y"): 1.0}


def test_normaliser_counts_each_tick_once(spark):
    r = simple_returns(spark, 6).withColumns({"a_log_return": F.col("tick_no") + 1.0, "b_log_return": (F.col("tick_no") + 1.0) * 10})
    index = windows.window_index(windows.candidate_windows(r, "e", 2, 1), "e").withColumn("split", F.when(F.col("sample_id") < 2, "train").otherwise("test"))
    covered = windows.covered_returns(r, index, "e", 2, 1)
    fit = {x.column: x.mean for x in windows.zscore_fit(covered, ["e"], ["a_log_return", "b_log_return"]).collect()}
    assert covered.count() == 4 and fit == {"a_log_return": 2.5, "b_log_return": 25.0}


def test_steps_for_days():
    assert panel.steps_for_days(60, "6h") == 240 and panel.steps_for_days(0.25, "6h") == 1
    with pytest.raises(ValueError):
        panel.steps_for_days(0.1, "6h")
    with pytest.raises(ValueError):
        panel.interval_us("7h")


def test_split_of_the_plans_is_a_partition(spark):
    r = simple_returns(spark, 60).withColumnRenamed("e", "panel_id")
    index = windows.window_index(windows.candidate_windows(r, "panel_id", 4, 2), "panel_id", ["target_start_ms"])
    assert {x.split for x in _split(index).collect()} == set(windows.SPLITS)


@pytest.mark.parametrize("size", [3, 7])
def test_shards_change_nothing(spark, monkeypatch, size):
    import random

    rng = random.Random(size)
    data = [(e, ms(at(6 * i)), rng.random() + 1, rng.random() + 1, rng.random() < 0.93, 2.0, 1.0, rng.random(), 2.0, 1.0, rng.random()) for e in (1, 2) for i in range(60)]
    cols = "e bigint, tick_ms bigint, a_close double, b_close double, is_complete boolean, a_high double, a_low double, a_volume double, b_high double, b_low double, b_volume double"
    df = spark.createDataFrame(data, cols)

    def everything():
        ret = panel.log_returns(df, "e", ("a", "b"))
        index = windows.condition_features(ret, "e", ("a", "b"), 4, 2, 2, 3, 4)
        split = index.withColumn("split", F.when(F.col("sample_id") % 3 == 0, "train").otherwise("test"))
        frames = ret, index, windows.covered_returns(ret, split, "e", 4, 2), windows.window_audit(windows.candidate_windows(ret, "e", 4, 2), "e"), generators.block_bootstrap(ret, "e", ["a_log_return"], 3, 4, 5)
        kept = [f.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes]) for f in frames]
        return [rows(f.select(*sorted(f.columns))) for f in kept]

    whole = everything()
    monkeypatch.setattr(windows, "SHARD_TICKS", size)
    assert everything() == whole and all(whole)


def test_autocorrelations_of_both_assets_to_lag_60(spark):
    from tidewright.plans.pipeline import segment_correlations

    rng, gap = np.random.default_rng(3), 70
    ticks = [t for t in range(150) if t != gap]
    x = {a: rng.normal(size=150) for a in ("btc", "eth")}
    df = spark.createDataFrame([(1, t, float(x["btc"][t]), float(x["eth"][t])) for t in ticks], "panel_id bigint, tick_no bigint, btc_log_return double, eth_log_return double")
    got = {(r.asset, r.series, r.lag): r.acf for r in segment_correlations(df, 60).collect()}
    assert len(got) == 4 * 60
    for (asset, series, lag), acf in got.items():
        y = x[asset] if series == "return" else abs(x[asset])
        d = y - y[ticks].mean()
        pairs = [(t, t + lag) for t in ticks if t + lag < 150 and not t <= gap <= t + lag]
        assert acf == pytest.approx(sum(d[i] * d[j] for i, j in pairs) / (d[ticks] ** 2).sum(), abs=1e-6)


def test_daily_candles_of_every_shorter_interval(spark):
    from tidewright.plans import pipeline as PP

    got = PP.candle_resample(spark, "/root/testdata/sf0.001")
    there = PP._klines(spark, "/root/testdata/sf0.001").where("candle_interval <> '1d'").select("candle_interval").distinct()
    assert sorted(map(tuple, got.select("candle_interval").distinct().collect())) == sorted(map(tuple, there.collect()))
