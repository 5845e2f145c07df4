import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions.keys import key_value, with_ordered_key
from tidewright.functions.times import floor_div

HARD = [0.0, -0.0, 1.0, -1.0, 2.0, 0.1, -0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1 - 2**-53, 1 + 2**-52, 3.0, 1e-310]


def bits(x: float) -> int:
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def check(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in with_ordered_key(df, "x", "k").withColumn("y", key_value(F.col("k"))).collect():
        assert r.k == bits(r.x) and r.y == r.x


def test_keys_are_the_bits(spark):
    check(spark, HARD + [s * 2.0**e for e in range(-1074, 1024, 7) for s in (1, -1)] + [2.0**e * (1 - 2**-53) for e in range(-1000, 1024, 11)])


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(allow_nan=False), min_size=200, max_size=200))
def test_keys_of_any_double(spark, values):
    check(spark, values)


def test_no_key_for_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    df = with_ordered_key(df, "x", "k")
    assert [r.k for r in df.collect()] == [None, None]


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_floor_div(spark, n):
    values = [-(2**62), -8, -7, -1, 0, 1, 6, 7, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "x bigint").select(floor_div(F.col("x"), n).alias("y"))
    assert [r.y for r in df.collect()] == [v // n for v in values]
