"""Statistics as aggregate columns, with the degenerate values that reports define."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.radix import exact_percentiles, quantile_name
from tidewright.operators.ranks import ranked
from tidewright.operators.scan import join_on

QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
#: Estimated input from which exact quantiles are selected in passes over the data; below it one aggregate holds a group's values.
LARGE_BYTES = 64 << 20


def known(df: DataFrame, *values: str) -> DataFrame:
    """NaN as NULL, which no quantile counts, whichever way it is taken."""
    return df.withColumns({v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in values})


def sample_sd(x: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def skew(x: Column) -> Column:
    """Population skewness, 0 without variance."""
    return F.coalesce(F.skewness(x), F.lit(0.0))


def excess_kurtosis(x: Column) -> Column:
    """Population excess kurtosis, 0 without variance."""
    return F.coalesce(F.kurtosis(x), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, NULL if either side has no variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quantile(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(float(q)))


def quantile_columns(x: Column, quantiles: Sequence[float] = QUANTILES, prefix: str = "") -> list[Column]:
    return [quantile(x, q).alias(prefix + quantile_name(q)) for q in quantiles]


def quantile_grid(x: Column, points: int = 1001) -> Column:
    """Quantiles at equally spaced levels from 0 to 1."""
    return F.percentile(x, F.lit(np.arange(points) / (points - 1)))  # one literal, not a thousand


def is_large(df: DataFrame) -> bool:
    """By the optimizer's own estimate of the input; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE_BYTES  # noqa: SLF001


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float], like: DataFrame | None = None) -> DataFrame:
    """Exact quantiles per group: ``groups`` and one column for each. NULL and NaN do not count; same result by either way.

    The way is chosen by the size of ``like``, where estimates of ``df`` itself mislead (joins multiply them).
    """
    if is_large(df if like is None else like):
        return exact_percentiles(df, groups, value, quantiles).drop("n_values")
    return known(df.select(*groups, value), value).groupBy(*groups).agg(*quantile_columns(F.col(value), quantiles))


def quantiles_of(df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]], like: DataFrame | None = None) -> DataFrame:
    """One quantile of each of several columns per group: ``wanted`` maps a name to its column and level."""
    if not is_large(df if like is None else like):
        rows = known(df, *{c for c, _ in wanted.values()})
        return rows.groupBy(*groups).agg(*[quantile(F.col(c), q).alias(n) for n, (c, q) in wanted.items()])
    out = None
    for n, (c, q) in wanted.items():
        one = exact_percentiles(df, groups, c, [q]).drop("n_values").toDF(*groups, n)
        out = one if out is None else join_on(out, one, groups, "inner") if groups else out.crossJoin(F.broadcast(one))  # one row
    return out


def grouped_grid(df: DataFrame, groups: Sequence[str], value: str, points: int = 1001, like: DataFrame | None = None) -> DataFrame:
    """``groups`` and ``grid``, the quantile grid of each group that has values; ``like`` as in ``grouped_quantiles``."""
    if not is_large(df if like is None else like):
        return known(df.select(*groups, value), value).groupBy(*groups).agg(quantile_grid(F.col(value), points).alias("grid")).where("grid is not null")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("__x"))
    placed = ranked(rows, groups, "__x", [], "__rank").select(*groups, "__rank", "__x")
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    at = (F.col("__n") - 1) * F.col("__i") / F.lit(points - 1)
    wanted = sizes.select(*groups, "__n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i")).withColumn("__at", at)
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("__at").cast("bigint"), F.ceil("__at").cast("bigint")))).alias("__rank"))
    # an order statistic weighs by how near its rank is to the level's; a level that meets a rank has that one alone
    near = join_on(wanted, placed, [*groups, "__rank"], "inner").withColumn("__y", F.col("__x") * (1 - F.abs(F.col("__at") - F.col("__rank"))))
    each = near.groupBy(*groups, "__i").agg(F.sum("__y").alias("__y"))
    lists = each.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("__i", "__y"))).alias("__l"))
    return lists.select(*groups, F.col("__l").getField("__y").alias("grid"))


def grid_distance(a: Column, b: Column) -> Column:
    """Wasserstein-1 of two distributions by their quantile grids of one size."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d) / F.size(a)


def summary(x: Column, prefix: str = "", quantiles: Sequence[float] = QUANTILES) -> list[Column]:
    """Mean, standard deviation and quantiles under their report names."""
    return [F.avg(x).alias(f"{prefix}mean"), sample_sd(x).alias(f"{prefix}standard_deviation"), *quantile_columns(x, quantiles, prefix)]
