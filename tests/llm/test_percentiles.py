"""Percentiles from summaries: error bounds, combination of any days, boundedness, defined cases."""

import math

import numpy as np
import pytest

from tidewright.llm import percentiles as P
from tidewright.operators.radix import quantile_name

QS = (0.01, 0.05, 0.5, 0.95, 0.99)


def data():
    rng = np.random.default_rng(6)
    out = [(g, int(d), float(x)) for g in ("a", "b") for d, x in zip(rng.integers(0, 9, 4000), rng.standard_t(2, 4000))]
    out += [("ties", 1, 2.0)] * 50 + [("none", 1, None), ("none", 2, math.nan), (None, None, 4.0), (None, 1, 8.0), ("zero", 1, -0.0), ("zero", 1, 0.0), ("ends", 1, math.inf), ("ends", 1, -math.inf), ("ends", 2, 1.0), ("one", 3, -2.5)]
    return out


def check(rows, picks):
    for r in rows:
        xs = sorted(x for g, d, x in data() if picks(r, g, d) and x is not None and not math.isnan(x))
        assert r.n_values == len(xs)
        for q in QS:
            got, most = r[quantile_name(q)], r[f"{quantile_name(q)}_error"]
            if not xs:
                assert got is None and most is None and r.relative_error is None
            elif not math.isinf(xs[0]):
                assert abs(got - np.quantile(xs, q)) <= most * (1 + 1e-9) + 1e-15
                assert most <= r.relative_error * 1.01 * max(abs(xs[math.floor((len(xs) - 1) * q)]), abs(xs[math.ceil((len(xs) - 1) * q)])) + 1e-300


def summaries(spark):
    return P.part_summaries(spark.createDataFrame(data(), "g string, d int, x double"), ["g"], "d", "x", QS)


def test_single_days_and_all_days(spark):
    s = summaries(spark).cache()
    for groups, picks in ((["g"], lambda r, g, d: g == r.g), (["g", "d"], lambda r, g, d: g == r.g and d == r.d)):
        found = P.summary_percentiles(s, groups, QS).collect()
        assert len(found) == len({(g, d) if "d" in groups else g for g, d, _ in data()})
        assert {r.relative_error for r in found} <= {2.0**-13, None}
        check(found, picks)


def test_some_days_state_the_error_they_have(spark):
    some = summaries(spark).where("d in (2, 5, 7)")
    check(P.summary_percentiles(some, ["g"], QS).where("g in ('a', 'b')").collect(), lambda r, g, d: g == r.g and d in (2, 5, 7))


def test_stored_summaries_are_bounded_and_read_back(spark):
    s = summaries(spark).cache()
    stored = P.packed(s, ["g"], "d")
    assert sorted(map(str, P.unpacked(stored, ["g"], "d").collect())) == sorted(map(str, s.select("g", "d", "level", "prefix", "digits", "n").collect()))
    assert all(len(r.histogram) <= {1: 4096, 2: 16, 3: 256}[r.level] for r in stored.collect())
    assert stored.where("g = 'a' and d = 3").count() <= 1 + 2 * 4 * len(QS)


def test_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, P.summary_percentiles(summaries(spark), ["g"], QS).collect()))
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert sorted(map(str, P.summary_percentiles(summaries(spark), ["g"], QS).collect())) == want


def test_defined_cases(spark):
    df = spark.createDataFrame(data(), "n string, d int, x double")
    with pytest.raises(ValueError):
        P.part_summaries(df, ["n"], "d", "x", QS)
    empty = spark.createDataFrame([], "g string, d int, x double")
    assert P.summary_percentiles(P.part_summaries(empty, ["g"], "d", "x", QS), ["g"], QS).count() == 0
    clash = spark.createDataFrame([("a", 1, 1.0, "c"), ("a", 2, 3.0, "c")], "key string, value int, x double, __key string")
    r = P.summary_percentiles(P.part_summaries(clash, ["key"], "value", "x", (0.5,)), ["key"], (0.5,)).first()
    assert r.q50 == pytest.approx(2.0, rel=2.0**-12) and r.n_values == 2
