"""Simulated paths: validity, metrics of single paths, and dependence within paths.

Paths are long: one row per path and step with the returns of both assets, or per path, asset and step. Windows are
partitioned by path (and asset), so nothing pairs observations of different paths and no path is larger than its horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.session import few

UNDERWATER = 1e-12


def valid_paths(paths: DataFrame, returns: Sequence[str], path: str = "path_id") -> DataFrame:
    """Rows of the paths whose returns are all finite; a path with a missing return is not judged in part."""
    bad = F.lit(False)
    for r in returns:
        x = F.col(r)
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    broken = F.max(bad).over(W.partitionBy(path))
    return paths.withColumn("__broken", broken).where(~F.col("__broken")).drop("__broken")


def by_asset(paths: DataFrame, returns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per path, step and asset: ``asset`` and its return ``x``."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.col(c).alias("x")) for a, c in returns.items()])).alias("__a")
    return paths.select(*keep, each).select(*keep, "__a.asset", "__a.x")


def along(path: Sequence[str], step: str = "step_no"):
    return W.partitionBy(*path).orderBy(step)


def path_metrics(long: DataFrame, path: Sequence[str], x: str = "x", step: str = "step_no", periods_per_year: float = 1460.0, keep: Sequence[str] = ()) -> DataFrame:
    """Final return, volatility, drawdown and its duration, extremes and time to the minimum, of each path and asset.

    Wealth starts at 1, which counts as the first peak but not among the extremes.
    """
    w = along(path, step)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = long.withColumn("__wealth", F.exp(F.sum(x).over(so_far)))
    rows = rows.withColumn("__dd", 1 - F.col("__wealth") / F.greatest(F.lit(1.0), F.max("__wealth").over(so_far)))
    rows = rows.withColumns({"__no": F.row_number().over(w), "__wet": F.col("__dd") > UNDERWATER})
    rows = rows.withColumn("__dry", F.coalesce(F.max(F.when(~F.col("__wet"), F.col("__no"))).over(so_far), F.lit(0)))
    return rows.groupBy(*path, *keep).agg(
        (F.exp(F.sum(x)) - 1).alias("final_cumulative_return"),
        (stats.sample_sd(F.col(x)) * float(periods_per_year) ** 0.5).alias("realized_volatility"),
        F.max("__dd").alias("maximum_drawdown"),
        F.max(F.when(F.col("__wet"), F.col("__no") - F.col("__dry")).otherwise(F.lit(0))).cast("double").alias("maximum_drawdown_duration_steps"),
        (F.max("__wealth") - 1).alias("intrahorizon_maximum_return"),
        (F.min("__wealth") - 1).alias("intrahorizon_minimum_return"),
        F.min(F.struct("__wealth", "__no"))["__no"].cast("double").alias("time_to_minimum_value_steps"),
    )


METRICS = (
    "final_cumulative_return",
    "realized_volatility",
    "maximum_drawdown",
    "maximum_drawdown_duration_steps",
    "intrahorizon_maximum_return",
    "intrahorizon_minimum_return",
    "time_to_minimum_value_steps",
)


def rolling_sd(long: DataFrame, path: Sequence[str], window: int, x: str = "x", step: str = "step_no", out: str = "volatility") -> DataFrame:
    """Sample deviation over full windows within a path."""
    w = along(path, step)
    rows = long.withColumns({out: F.stddev_samp(x).over(w.rowsBetween(1 - window, 0)), "__no": F.row_number().over(w)})
    return rows.where(F.col("__no") >= window).drop("__no")


def rolling_correlation(paths: DataFrame, path: Sequence[str], window: int, x: str, y: str, step: str = "step_no") -> DataFrame:
    """Correlation over full windows within a path; NULL where a side has no variance."""
    w = along(path, step)
    frame = w.rowsBetween(1 - window, 0)
    value = F.try_divide(F.covar_samp(x, y).over(frame), F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame))
    return paths.withColumns({"correlation": value, "__no": F.row_number().over(w)}).where(F.col("__no") >= window).drop("__no")


def true_runs(flags: DataFrame, path: Sequence[str], flag: str, step: str = "step_no", keep: Sequence[str] = ()) -> DataFrame:
    """Length of every run of successive true steps; runs end with their path."""
    hits = flags.where(F.col(flag)).withColumn("__run", F.col(step) - F.row_number().over(along(path, step)))
    return hits.groupBy(*path, *keep, "__run").agg(F.count(F.lit(1)).alias("length")).drop("__run")


def pooled_acf(long: DataFrame, groups: Sequence[str], path: Sequence[str], lags: int, transforms: dict[str, Column], step: str = "step_no") -> DataFrame:
    """Autocorrelations pooled over the paths of a group, centred by the mean of the whole group.

    Returns groups, ``series``, ``lag`` and ``acf`` (0 where a side has no variance).
    """
    names = list(transforms)
    d = [f"__d{i}" for i in range(len(names))]
    rows = long.select(*dict.fromkeys([*groups, *path]), step, *[transforms[n].alias(c) for n, c in zip(names, d)])
    means = few(rows.groupBy(*groups).agg(*[F.avg(c).alias(f"{c}_m") for c in d]))
    rows = rows.join(means, list(groups)).withColumns({c: F.col(c) - F.col(f"{c}_m") for c in d})
    # every step beside those up to ``lags`` before it in its path
    near = rows.withColumn("__near", F.collect_list(F.struct(step, *d)).over(along(path, step).rowsBetween(-lags, -1)))
    pairs = near.select(*groups, F.size("__near").alias("__n"), *d, F.posexplode("__near").alias("__i", "__e"))
    pairs = pairs.withColumn("lag", (F.col("__n") - F.col("__i")).cast("bigint"))
    sums = []
    for i, c in enumerate(d):
        here, there = F.col(c), F.col("__e").getField(c)
        sums += [F.sum(here * there).alias(f"__a{i}"), F.sum(F.when(here.isNotNull(), there * there)).alias(f"__b{i}"), F.sum(F.when(there.isNotNull(), here * here)).alias(f"__c{i}")]
    wide = pairs.groupBy(*groups, "lag").agg(*sums)
    spread = lambda i: F.sqrt(F.col(f"__b{i}") * F.col(f"__c{i}"))
    each = [F.struct(F.lit(n).alias("series"), F.when(F.col(f"__b{i}") * F.col(f"__c{i}") > 0, F.col(f"__a{i}") / spread(i)).otherwise(F.lit(0.0)).alias("acf")) for i, n in enumerate(names)]
    return wide.select(*groups, "lag", F.explode(F.array(*each)).alias("__e")).select(*groups, "__e.series", "lag", "__e.acf")


def path_features(paths: DataFrame, assets: dict[str, str], path: str = "path_id", step: str = "step_no", keep: Sequence[str] = ()) -> DataFrame:
    """Ten features of each path and asset, and the correlation within the path (0 if degenerate): a wide row per path."""
    long = by_asset(paths, assets, [path, step, *keep])
    steps = F.count(F.lit(1))
    basic = long.groupBy(path, "asset", *keep).agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("standard_deviation"),
        F.avg(F.abs("x")).alias("mean_absolute"),
        stats.quantile(F.col("x"), 0.05).alias("q05"),
        stats.quantile(F.col("x"), 0.95).alias("q95"),
        steps.alias("steps"),
    )
    metrics = path_metrics(long, [path, "asset"], step=step)
    joined = basic.join(metrics, [path, "asset"])
    values = {
        "mean": F.col("mean"),
        "standard_deviation": F.col("standard_deviation"),
        "mean_absolute": F.col("mean_absolute"),
        "q05": F.col("q05"),
        "q95": F.col("q95"),
        "final_return": F.col("final_cumulative_return"),
        "maximum_drawdown": F.col("maximum_drawdown"),
        "drawdown_share": F.col("maximum_drawdown_duration_steps") / F.col("steps"),
        "maximum_return": F.col("intrahorizon_maximum_return"),
        "minimum_return": F.col("intrahorizon_minimum_return"),
    }
    wide = joined.groupBy(path, *keep).agg(*[F.max(F.when(F.col("asset") == a, v)).alias(f"{a}_{n}") for a in assets for n, v in values.items()])
    x, y = (F.col(c) for c in assets.values())
    corr = paths.groupBy(path).agg(F.coalesce(stats.pearson(x, y), F.lit(0.0)).alias("correlation"))
    return wide.join(corr, path)
