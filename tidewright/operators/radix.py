"""Exact order statistics of large groups by radix selection.

Values become 64-bit integers of the same order (``functions.keys``). A histogram of their leading digit
shows which digit holds each target rank; the next pass counts the following digit of only those values,
and so on. A histogram is a mergeable summary: counts of partitions, days or batches add up.

``exact_percentiles`` goes down to the last bit by passes over the values, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.keys import key_value, with_ordered_key
from tidewright.operators.scan import join_on
from tidewright.session import cut_lineage

KEY_BITS = 64
#: Targets up to this many rows are sent to all tasks, beyond it the values are joined in a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16
_RESERVED = {"n", "prefix", "targets", "n_values"}


def _free(groups: Sequence[str]) -> None:
    if taken := _RESERVED & set(groups):
        raise ValueError(f"groups may not be named {', '.join(sorted(taken))}")


def quantile_name(q: float) -> str:
    """``q01``, ``q50``, ``q2_5``: whole percents with two digits, else the shortest form."""
    percent = round(q * 100, 10)
    return f"q{percent:02.0f}" if percent == int(percent) else "q" + f"{percent:g}".replace(".", "_")


def _lead(c: Column, bits: int) -> Column:
    """Without its last ``bits`` bits, towards zero, so that buckets of negative values mirror those of positive ones."""
    return F.call_function("div", c, F.lit(1 << bits).cast("bigint")) if bits else c


def _targets(total: Column, quantiles: Sequence[float]) -> Column:
    """The order statistics on both sides of each quantile: rank counted from 0."""
    out = []
    for i, q in enumerate(quantiles):
        low = F.floor((total - 1) * F.lit(float(q))).cast("bigint")
        for side, rank in ((0, low), (1, F.least(low + 1, total - 1))):
            out.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank")))
    return F.array(*out)


def _inside(targets: Column, before: Column, n: Column) -> Column:
    """The targets among the ``n`` values that ``before`` values precede, their ranks counted within these."""
    held = F.filter(targets, lambda t: (t["rank"] >= before) & (t["rank"] < before + n))
    return F.transform(held, lambda t: F.struct(t["i"].alias("i"), t["side"].alias("side"), (t["rank"] - before).alias("rank")))


def _hit(counts: DataFrame, groups: Sequence[str], prefix: Sequence[str], digit: str, targets: str) -> DataFrame:
    """Which digit holds each target: groups, ``n_values``, ``prefix`` (the digit) and the targets within it."""
    along = W.partitionBy(*groups, *prefix).orderBy(F.col(digit).asc_nulls_first())
    at = counts.withColumn("__before", F.sum("n").over(along) - F.col("n"))
    moved = _inside(F.col(targets), F.col("__before"), F.col("n"))
    at = at.select(*groups, "n_values", F.col(digit).alias("prefix"), moved.alias("targets"))
    return at.where((F.size("targets") > 0) | (F.col("n_values") == 0))


def _read(found: DataFrame, groups: Sequence[str], quantiles: Sequence[float], value: Column) -> DataFrame:
    """Linear interpolation between the two order statistics of each quantile; one row per group."""
    single = found.select(*groups, "n_values", F.explode_outer("targets").alias("__t"), value.alias("__x"))
    pick = lambda i, side: F.max(F.when((F.col("__t.i") == i) & (F.col("__t.side") == side), F.col("__x")))
    picked = [pick(i, side).alias(f"__{i}_{side}") for i in range(len(quantiles)) for side in (0, 1)]
    wide = single.groupBy(*groups).agg(F.max("n_values").alias("n_values"), *picked)
    out = []
    for i, q in enumerate(quantiles):
        a, b, at = F.col(f"__{i}_0"), F.col(f"__{i}_1"), (F.col("n_values") - 1) * F.lit(float(q))
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at))).alias(quantile_name(q)))
    return wide.select(*groups, "n_values", *out)


def exact_percentiles(values: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float], digits: Sequence[int] = (16, 16, 32)) -> DataFrame:
    """Percentiles per group without error, by radix selection over the values: one pass for each of ``digits``.

    After a pass only values that share the digits of some target rank are counted on. The targets of a pass (two
    for each group and quantile) are written once and sent to all tasks if their counted number allows it;
    otherwise the values meet them in a salted shuffle join. Defined results: NULL and NaN values do not count; a group
    without values has n_values 0 and NULL percentiles; -0.0 counts as 0.0; infinities are the extreme values.
    """
    _free(groups)
    if sum(digits) != KEY_BITS:
        raise ValueError("the digits must add up to 64 bits")
    keyed = with_ordered_key(values.select(*groups, F.col(value).alias("__value")), "__value", "__key").drop("__value")
    shift = lambda left: _lead(F.col("__key"), left)
    left = KEY_BITS - digits[0]
    counts = keyed.groupBy(*groups, shift(left).alias("__digit")).agg(F.count("__key").alias("n"))
    total = F.sum("n").over(W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0)))
    counts = counts.withColumn("n_values", total).withColumn("__targets", _targets(total, quantiles))
    targets = cut_lineage(_hit(counts, groups, [], "__digit", "__targets"))
    for bits in digits[1:]:
        rows = keyed.withColumn("prefix", shift(left))  # a filter on it would make the key several times over
        wanted = targets.where("n_values > 0").select(*groups, "prefix")
        if wanted.count() <= BROADCAST_ROWS:
            rows = join_on(rows, F.broadcast(wanted), [*groups, "prefix"], "inner")
        else:
            salted = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            rows = join_on(rows, salted, [*groups, "prefix", "__salt"], "inner")
        left -= bits
        counts = rows.groupBy(*groups, "prefix", shift(left).alias("__digit")).agg(F.count(F.lit(1)).alias("n"))
        joined = join_on(targets, counts, [*groups, "prefix"], "left")
        targets = cut_lineage(_hit(joined.withColumn("n", F.coalesce("n", F.lit(0))), groups, ["prefix"], "__digit", "targets"))
    return _read(targets, groups, quantiles, key_value(F.col("prefix")))
