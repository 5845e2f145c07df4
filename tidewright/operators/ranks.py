"""Ranks within groups without gathering a group in one task, and what is built on them.

Values fall into order-preserving buckets (leading bits of their key); counts per bucket give each bucket its base
rank, and only ties and neighbours within a bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.keys import with_ordered_key
from tidewright.operators.scan import join_on
from tidewright.session import few

_LOW_BITS = 40
_SLICE = 16_384


def _bucketed(df: DataFrame, value: str) -> DataFrame:
    keyed = with_ordered_key(df, value, "__key")
    return keyed.withColumn("__bucket", F.call_function("div", F.col("__key"), F.lit(1 << _LOW_BITS).cast("bigint"))).drop("__key")


def ranked(df: DataFrame, groups: Sequence[str], value: str, ties: Sequence[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the rank of each row in its group, from 0, by value and then by ``ties``. Rows without value have no rank.

    ``total`` names a column for the number of ranks in the group, added up from the buckets.
    """
    rows = _bucketed(df, value)
    counts = rows.where(F.col("__bucket").isNotNull()).groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = [F.sum("__n").over(W.partitionBy(*groups)).alias(total)] if total else []  # a row for each bucket
    bases = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), *whole)
    placed = join_on(rows, bases, [*groups, "__bucket"])
    inside = W.partitionBy(*groups, "__bucket").orderBy(value, *ties)
    return placed.withColumn(out, F.col("__base") + F.row_number().over(inside) - 1).drop("__base", "__bucket")


def ecdf_at(points: DataFrame, sample: DataFrame, groups: Sequence[str], value: str, out: str = "ecdf") -> DataFrame:
    """Adds to each point the share of the group's sample that is at most its value; NULL if the sample is empty."""
    both = points.withColumn("__s", F.lit(0)).unionByName(sample.select(*groups, value).withColumn("__s", F.lit(1)), allowMissingColumns=True)
    rows = _bucketed(both.where(F.col(value).isNotNull() & ~F.isnan(value)), value)
    counts = rows.groupBy(*groups, "__bucket").agg(F.sum("__s").alias("__n"))
    order = W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"), F.sum("__n").over(W.partitionBy(*groups)).alias("__total"))
    placed = join_on(rows, bases, [*groups, "__bucket"])
    inside = W.partitionBy(*groups, "__bucket").orderBy(value).rangeBetween(W.unboundedPreceding, 0)
    at_most = F.col("__base") + F.sum("__s").over(inside)
    return placed.withColumn(out, F.try_divide(at_most.cast("double"), F.col("__total").cast("double"))).where("__s = 0").select(*points.columns, out)


def ks_to_uniform(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of values in [0, 1] to the uniform distribution, per group."""
    rows = ranked(df.where(F.col(value).isNotNull() & ~F.isnan(value)), groups, value, [], total="__n")
    x = F.col(value)
    return rows.groupBy(*groups).agg(F.max(F.greatest((F.col("rank") + 1) / F.col("__n") - x, x - F.col("rank") / F.col("__n"))).alias("ks"))


def sorted_wasserstein(a: DataFrame, b: DataFrame, groups: Sequence[str], value: str, ties: Sequence[str] = ()) -> DataFrame:  # noqa: ARG001
    """Wasserstein-1 of two samples per group: the mean distance of their quantiles at as many equally spaced levels as the larger
    sample has values, so of the values of equal rank for two samples of one size. Groups that one side lacks are left out.

    A level between two ranks takes both, weighted by nearness. Every value goes to the slices of levels that its rank reaches, and
    levels are laid out only there: no task holds a sample, and no table of levels is joined, which Spark would take for a few rows
    and send to all tasks. ``ties`` changes nothing: values that tie are equal.
    """

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("__x"), F.lit(sign).alias("__sign"))

    rows = side(a, 1).unionByName(side(b, -1))
    sizes = rows.groupBy(*groups).agg(F.count_if(F.col("__sign") > 0).alias("__a"), F.count_if(F.col("__sign") < 0).alias("__b")).where("__a > 0 and __b > 0")
    sizes = few(sizes.withColumn("__g", F.monotonically_increasing_id()))
    own = F.when(F.col("__sign") > 0, F.col("__a")).otherwise(F.col("__b"))
    rows = join_on(rows, sizes, groups, "inner").select("__g", "__sign", "__x", own.alias("__n"), F.greatest("__a", "__b").alias("__m"))

    # a bucket's base and ones add up to ranks: one shuffle, and no join on keys that are never NULL
    rows, keys = _bucketed(rows, "__x"), ["__g", "__sign", "__bucket"]
    before = W.partitionBy("__g", "__sign").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    bases = counts.select(*keys, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c"))
    along = W.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("__c", F.lit(1).cast("bigint")).unionByName(bases, allowMissingColumns=True)
    placed = placed.withColumn("__rank", F.sum("__c").over(along) - 1).where(F.col("__x").isNotNull())

    rank, n, m, i, s = (F.col(c) for c in ("__rank", "__n", "__m", "__i", "__s"))
    apart = (m - 1).cast("double") / F.greatest(n - 1, F.lit(1))  # levels from one rank to the next
    first = F.when(n == m, rank).otherwise(F.greatest(F.floor((rank - 1) * apart), F.lit(0))).cast("bigint")
    last = F.when(n == m, rank).otherwise(F.least(F.ceil((rank + 1) * apart), m - 1)).cast("bigint")
    slice_of = lambda c: F.call_function("div", F.col(c), F.lit(_SLICE))
    sent = placed.select("__g", "__sign", "__x", "__rank", "__n", "__m", first.alias("__first"), last.alias("__last"))
    sent = sent.withColumn("__s", F.explode(F.sequence(slice_of("__first"), slice_of("__last")))).repartition("__g", "__s")
    levels = sent.withColumn("__i", F.explode(F.sequence(F.greatest("__first", s * _SLICE), F.least("__last", (s + 1) * _SLICE - 1))))
    place = F.when(n == m, i.cast("double")).otherwise((n - 1).cast("double") * i / F.greatest(m - 1, F.lit(1)))
    near = levels.withColumn("__weight", 1 - F.abs(place - rank)).where("__weight > 0")
    gaps = near.groupBy("__g", "__s", "__i").agg(F.abs(F.sum(F.col("__sign") * F.col("__x") * F.col("__weight"))).alias("__d"))
    return sizes.join(gaps.groupBy("__g").agg(F.avg("__d").alias("wasserstein_1")), "__g").select(*groups, "wasserstein_1")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str = "average_rank") -> DataFrame:
    """Rank from 1 in its group, ties sharing the mean of their ranks."""
    by = W.partitionBy(*groups)
    return df.withColumn(out, F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*groups, value)) - 1) / 2)
