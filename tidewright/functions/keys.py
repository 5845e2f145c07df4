"""Doubles as 64-bit integers of the same order, in JVM arithmetic alone.

``with_ordered_key`` gives ``sign * bits(|x|)``: the IEEE-754 pattern of the absolute value, negated for
negative values. Its order is the order of the doubles, 0.0 and -0.0 share key 0, infinities come
first and last. NaN and NULL have no key. Powers of two are exact in ``pow``, and scaling by them
is exact, so the key is the exact bit pattern and ``key_value`` its exact inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA_BITS = 52
_BIAS = 1023
_MANTISSA = float(2**MANTISSA_BITS)
_SUBNORMAL_SCALE = float(2**537)


def _two_to(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def with_ordered_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the order-preserving bigint of a double; NULL for NULL and NaN.

    Built in steps, so that logarithm and power are computed once for each row.
    """
    x, size, guess, scaled = F.col(value).cast("double"), F.col("__size"), F.col("__guess"), F.col("__scaled")
    # log2 is off by one at most near a power of two; the scaled mantissa shows it
    steps = df.withColumn("__size", F.abs(x))
    steps = steps.withColumn("__guess", F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int"))
    steps = steps.withColumn("__scaled", size * _two_to(-guess))
    exponent = guess + F.when(scaled >= 2.0, 1).when(scaled < 1.0, -1).otherwise(0)
    mantissa = F.when(scaled >= 2.0, scaled / 2.0).when(scaled < 1.0, scaled * 2.0).otherwise(scaled)
    normal = F.shiftleft((exponent + _BIAS).cast("bigint"), MANTISSA_BITS) + ((mantissa - 1.0) * _MANTISSA).cast("bigint")
    subnormal = (size * _SUBNORMAL_SCALE * _SUBNORMAL_SCALE).cast("bigint")
    bits = (
        F.when(size == 0.0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), F.lit(2047 << MANTISSA_BITS).cast("bigint"))
        .when(size < 2.0**-1022, subnormal)
        .otherwise(normal)
    )
    steps = steps.withColumn("__bits", F.when(size.isNotNull() & ~F.isnan(size), bits))
    return steps.withColumn(out, F.when(x < 0.0, -F.col("__bits")).otherwise(F.col("__bits"))).drop("__size", "__guess", "__scaled", "__bits")


def key_value(key: Column) -> Column:
    """The double of an ordered key."""
    bits = F.abs(key)
    exponent = F.shiftright(bits, MANTISSA_BITS).cast("int")
    mantissa = bits.bitwiseAND(F.lit((1 << MANTISSA_BITS) - 1).cast("bigint")).cast("double")
    size = (
        F.when(exponent == 2047, F.lit(float("inf")))
        .when(exponent == 0, mantissa / _SUBNORMAL_SCALE / _SUBNORMAL_SCALE)
        .otherwise((F.lit(1.0) + mantissa / _MANTISSA) * _two_to(exponent - _BIAS))
    )
    return F.when(key < 0, -size).otherwise(size)
