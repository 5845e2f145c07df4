"""Comparison of candidate paths with reference paths: marginal, temporal, cross-asset, trajectory and regime reports.

Thresholds are fitted on the reference alone and applied to both sides; one row for each of the assets, whose names are an
argument of the caller, so they are sent to all tasks. ``long`` frames have a row per path, step and
asset with the return ``x``; ``side`` is the reference or the name of a candidate, so one pass serves all candidates.
Thresholds and group means are one row per asset or side: joins with them are as small as the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import paths as P
from tidewright.session import few

REFERENCE = "reference"
PATH = ["path_id", "asset"]


def against_reference(summary: DataFrame, on: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Each candidate's row beside the reference's: columns with the prefixes reference_ and candidate_."""
    values = [c for c in summary.columns if c not in ("side", *on, *shared)]
    reference = summary.where(F.col("side") == REFERENCE).select(*on, *[F.col(c).alias(f"reference_{c}") for c in values])
    candidates = summary.where(F.col("side") != REFERENCE).select(F.col("side").alias("candidate"), *on, *shared, *[F.col(c).alias(f"candidate_{c}") for c in values])
    return candidates.join(reference, list(on)) if on else candidates.crossJoin(F.broadcast(reference))  # one reference row


def errors(report: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Absolute differences of candidate and reference; NULL where either is."""
    return {f"{n}_error": F.abs(F.col(f"candidate_{n}") - F.col(f"reference_{n}")) for n in names}


def reference_threshold(rows: DataFrame, on: Sequence[str], value: Column, q: float, out: str) -> DataFrame:
    ref = rows.where(F.col("side") == REFERENCE).select(*on, value.alias("__v"))
    return stats.grouped_quantiles(ref, on, "__v", [q]).toDF(*on, out)


def wasserstein(rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Wasserstein-1 of every candidate to the reference by quantile grids, plain and over the reference's deviation."""
    grids = stats.grouped_grid(rows.select("side", *on, value), ["side", *on], value)
    sds = rows.where(F.col("side") == REFERENCE).groupBy(*on).agg(stats.sample_sd(F.col(value)).alias("__sd"))
    both = against_reference(grids, on).join(sds, list(on))
    w = stats.grid_distance(F.col("candidate_grid"), F.col("reference_grid"))
    both = both.withColumn("wasserstein_1", w)
    return both.select("candidate", *on, "wasserstein_1", F.when(F.col("__sd") > 0, F.col("wasserstein_1") / F.col("__sd")).alias("normalized_wasserstein_1"))


def marginal_report(long: DataFrame, extreme_quantile: float = 0.99, quantiles: Sequence[float] = stats.QUANTILES) -> DataFrame:
    """Moments, quantiles and extremes of the pooled returns of each candidate and asset against the reference."""
    x = F.col("x")
    limits = reference_threshold(long, ["asset"], F.abs(x), extreme_quantile, "extreme_threshold")
    rows = long.join(F.broadcast(limits), "asset")
    extreme = F.abs(x) >= F.col("extreme_threshold")
    summary = rows.groupBy("side", "asset").agg(
        F.first("extreme_threshold").alias("extreme_threshold"),
        F.avg(x).alias("mean"),
        stats.sample_sd(x).alias("standard_deviation"),
        stats.skew(x).alias("skewness"),
        stats.excess_kurtosis(x).alias("excess_kurtosis"),
        F.avg(extreme.cast("double")).alias("extreme_frequency"),
        F.avg(F.when(extreme, F.abs(x))).alias("mean_absolute_extreme"),
    )
    summary = summary.join(stats.grouped_quantiles(long, ["side", "asset"], "x", quantiles), ["side", "asset"])
    report = against_reference(summary, ["asset"], ["extreme_threshold"])
    return report.join(wasserstein(long, ["asset"], "x"), ["candidate", "asset"])


def trajectory_report(metrics: DataFrame) -> DataFrame:
    """Distribution of each path metric of each candidate and asset against the reference."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in P.METRICS])).alias("__m")
    rows = metrics.select("side", "asset", each).select("side", "asset", "__m.metric", "__m.x")
    on = ["asset", "metric"]
    summary = rows.groupBy("side", *on).agg(F.avg("x").alias("mean"), stats.sample_sd(F.col("x")).alias("standard_deviation"))
    summary = summary.join(stats.grouped_quantiles(rows, ["side", *on], "x", stats.QUANTILES), ["side", *on])
    return against_reference(summary, on).join(wasserstein(rows, on, "x"), ["candidate", *on])


def volatility_runs(long: DataFrame, window: int, high_quantile: float) -> DataFrame:
    """Frequency of high rolling volatility and the length of its runs: mean and 95 % quantile, 0 without runs."""
    vol = P.rolling_sd(long, PATH, window)
    limits = reference_threshold(vol, ["asset"], F.col("volatility"), high_quantile, "high_volatility_threshold")
    flags = vol.join(F.broadcast(limits), "asset").withColumn("__high", F.col("volatility") >= F.col("high_volatility_threshold"))
    share = flags.groupBy("side", "asset").agg(F.first("high_volatility_threshold").alias("high_volatility_threshold"), F.avg(F.col("__high").cast("double")).alias("high_volatility_frequency"))
    runs = P.true_runs(flags, PATH, "__high", keep=["side"])
    lengths = runs.groupBy("side", "asset").agg(F.avg("length").alias("__mean"), stats.quantile(F.col("length"), 0.95).alias("__p95"))
    joined = share.join(lengths, ["side", "asset"], "left")
    return joined.select(
        "side",
        "asset",
        "high_volatility_threshold",
        "high_volatility_frequency",
        F.coalesce("__mean", F.lit(0.0)).alias("run_length_mean"),
        F.coalesce("__p95", F.lit(0.0)).alias("run_length_p95"),
    )


def extreme_clustering(long: DataFrame, k: int, extreme_quantile: float) -> DataFrame:
    """Probability of an extreme return after one in the last ``k`` steps, over that of any; NULL if either has no case."""
    limits = reference_threshold(long, ["asset"], F.abs("x"), extreme_quantile, "extreme_threshold")
    w = P.along(PATH)
    rows = long.join(F.broadcast(limits), "asset").withColumn("__e", F.abs("x") >= F.col("extreme_threshold"))
    rows = rows.withColumns({"__prior": F.max("__e").over(w.rowsBetween(-k, -1)), "__no": F.row_number().over(w)}).where(F.col("__no") > k)
    e = F.col("__e").cast("double")
    agg = rows.groupBy("side", "asset").agg(F.first("extreme_threshold").alias("extreme_threshold"), F.avg(e).alias("__base"), F.avg(F.when(F.col("__prior"), e)).alias("__after"))
    return agg.select("side", "asset", "extreme_threshold", F.when(F.col("__base") > 0, F.col("__after") / F.col("__base")).alias("extreme_clustering"))


def acf(long: DataFrame, lags: int) -> DataFrame:
    x = F.col("x")
    return P.pooled_acf(long, ["side", "asset"], PATH, lags, {"return": x, "absolute": F.abs(x), "squared": x * x})


def temporal_report(long: DataFrame, lags: int = 20, window: int = 20, high_quantile: float = 0.9, extreme_quantile: float = 0.99, k: int = 4) -> DataFrame:
    """Errors of autocorrelations, volatility clustering and extreme clustering of each candidate and asset."""
    corr = acf(long, lags)
    pairs = against_reference(corr, ["asset", "series", "lag"])
    gap = F.pow(F.col("candidate_acf") - F.col("reference_acf"), F.lit(2.0))
    rmse = pairs.groupBy("candidate", "asset").agg(*[F.sqrt(F.avg(F.when(F.col("series") == s, gap))).alias(f"{s}_acf_rmse") for s in ("return", "absolute", "squared")])
    persistence = corr.where("series = 'absolute'").groupBy("side", "asset").agg(F.sum(F.greatest("acf", F.lit(0.0))).alias("volatility_persistence"))
    shared = ["high_volatility_threshold", "extreme_threshold"]
    summary = volatility_runs(long, window, high_quantile).join(extreme_clustering(long, k, extreme_quantile), ["side", "asset"]).join(persistence, ["side", "asset"])
    report = against_reference(summary, ["asset"], shared)
    names = ["volatility_persistence", "high_volatility_frequency", "run_length_mean", "run_length_p95", "extreme_clustering"]
    return report.withColumns(errors(report, names)).join(rmse, ["candidate", "asset"])


def stress_flags(paths: DataFrame, assets: dict[str, str], window: int, stress_quantile: float) -> DataFrame:
    """Steps with full windows: rolling correlation, and whether the stress score is beyond the reference's quantile.

    The score is the mean over assets of rolling volatility relative to the reference's median (1 if that is 0).
    """
    w = P.along(["path_id"])
    frame = w.rowsBetween(1 - window, 0)
    x, y = assets.values()
    sds = {f"__v_{a}": F.stddev_samp(c).over(frame) for a, c in assets.items()}
    corr = F.try_divide(F.covar_samp(x, y).over(frame), F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame))
    rows = paths.withColumns({**sds, "correlation": corr, "__no": F.row_number().over(w)}).where(F.col("__no") >= window)
    ref = rows.where(F.col("side") == REFERENCE)
    medians = stats.quantiles_of(ref, [], {f"__m_{a}": (f"__v_{a}", 0.5) for a in assets}, paths)
    rows = rows.crossJoin(F.broadcast(medians))  # one row
    parts = [F.col(f"__v_{a}") / F.when(F.col(f"__m_{a}") == 0, F.lit(1.0)).otherwise(F.col(f"__m_{a}")) for a in assets]
    rows = rows.withColumn("stress_score", (parts[0] + parts[1]) / 2)
    limit = stats.grouped_quantiles(rows.where(F.col("side") == REFERENCE), [], "stress_score", [stress_quantile], paths).toDF("stress_threshold")
    rows = rows.crossJoin(F.broadcast(limit))  # one row
    return rows.withColumn("stressed", F.col("stress_score") >= F.col("stress_threshold"))


def rolling_correlation_summary(flags: DataFrame, paths: DataFrame) -> DataFrame:
    c = F.col("correlation")
    cuts = stats.grouped_quantiles(flags, ["side"], "correlation", (0.05, 0.5, 0.95), paths).toDF("side", "rolling_q05", "rolling_q50", "rolling_q95")
    base = flags.groupBy("side").agg(
        F.avg(c).alias("rolling_mean"),
        F.when(F.count(c) > 0, stats.sample_sd(c)).alias("rolling_standard_deviation"),
        (F.count(c) / F.count(F.lit(1))).alias("valid_fraction"),
        F.avg(F.when(~F.col("stressed"), c)).alias("calm_correlation"),
        F.avg(F.when(F.col("stressed"), c)).alias("stress_correlation"),
        F.avg(F.col("stressed").cast("double")).alias("stress_frequency"),
    )
    return base.join(cuts, "side")


def joint_drops(paths: DataFrame, assets: dict[str, str], drop_quantile: float, tail_quantile: float) -> DataFrame:
    """Contemporaneous correlation, joint drops below the reference's quantiles, and lower-tail dependence by each side's own."""
    x, y = assets.values()
    limits = stats.quantiles_of(paths.where(F.col("side") == REFERENCE), [], {f"joint_drop_threshold_{a}": (c, drop_quantile) for a, c in assets.items()})
    own = stats.quantiles_of(paths, ["side"], {f"__t_{a}": (c, tail_quantile) for a, c in assets.items()})
    rows = paths.join(few(own), "side").crossJoin(F.broadcast(limits))  # one row
    below = lambda prefix: (F.col(x) <= F.col(f"{prefix}{list(assets)[0]}")) & (F.col(y) <= F.col(f"{prefix}{list(assets)[1]}"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("side").agg(
        *[F.first(f"joint_drop_threshold_{a}").alias(f"joint_drop_threshold_{a}") for a in assets],
        stats.pearson(F.col(x), F.col(y)).alias("correlation"),
        share(below("joint_drop_threshold_")).alias("joint_drop_probability"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), share(below("__t_")) / F.lit(tail_quantile))).alias("lower_tail_dependence"),
    )


def cross_asset_report(paths: DataFrame, assets: dict[str, str], window: int = 20, stress_quantile: float = 0.9, drop_quantile: float = 0.05, tail_quantile: float = 0.05) -> DataFrame:
    """Dependence between the two assets of each candidate against the reference."""
    flags = stress_flags(paths, assets, window, stress_quantile)
    summary = joint_drops(paths, assets, drop_quantile, tail_quantile).join(rolling_correlation_summary(flags, paths), "side")
    shared = [f"joint_drop_threshold_{a}" for a in assets]
    report = against_reference(summary, [], shared)
    names = ["correlation", "joint_drop_probability", "lower_tail_dependence", "rolling_mean", "calm_correlation", "stress_correlation", "stress_frequency"]
    grids = stats.grouped_grid(flags.where("correlation is not null").select("side", "correlation"), ["side"], "correlation", like=paths)
    w = against_reference(grids, []).select("candidate", stats.grid_distance(F.col("candidate_grid"), F.col("reference_grid")).alias("rolling_correlation_wasserstein_1"))
    report = report.withColumns(errors(report, names)).join(w, "candidate", "left")
    return report.withColumn("asset_pair", F.lit("-".join(assets)))


def volatility_levels(long: DataFrame) -> DataFrame:
    """Each path's volatility: the mean over assets of its deviation relative to the reference's median (1 if that is 0)."""
    sds = long.groupBy("side", "path_id", "asset").agg(stats.sample_sd(F.col("x")).alias("sd"))
    med = stats.grouped_quantiles(sds.where(F.col("side") == REFERENCE), ["asset"], "sd", [0.5], long).toDF("asset", "__m")
    relative = F.col("sd") / F.when(F.col("__m") == 0, F.lit(1.0)).otherwise(F.col("__m"))
    return sds.join(F.broadcast(med), "asset").groupBy("side", "path_id").agg(F.avg(relative).alias("level"))


def volatility_quartiles(long: DataFrame) -> DataFrame:
    """Paths of each side by the quartiles of the reference's volatility: bin 0 to 3, a path at a quartile in the upper one."""
    level = volatility_levels(long)
    cuts = stats.grouped_quantiles(level.where(F.col("side") == REFERENCE), [], "level", [0.25, 0.5, 0.75], long).toDF("__a", "__b", "__c")
    rows = level.crossJoin(F.broadcast(cuts))  # one row
    where = sum(((F.col("level") >= F.col(c)).cast("bigint") for c in ("__a", "__b", "__c")), F.lit(0).cast("bigint"))
    return rows.groupBy("side", where.alias("bin")).agg(F.count(F.lit(1)).alias("paths"), F.avg("level").alias("mean_level"))


def regimes(long: DataFrame) -> DataFrame:
    """Shares of low, medium and high volatility paths by the reference's terciles, and the distance to its shares."""
    level = volatility_levels(long)
    cuts = stats.grouped_quantiles(level.where(F.col("side") == REFERENCE), [], "level", [1 / 3, 2 / 3], long).toDF("__a", "__b")
    rows = level.crossJoin(F.broadcast(cuts))  # one row
    low, high = F.col("level") <= F.col("__a"), F.col("level") > F.col("__b")
    share = lambda c: F.avg(c.cast("double"))
    summary = rows.groupBy("side").agg(F.count(F.lit(1)).alias("paths"), share(low).alias("low"), share(~low & ~high).alias("medium"), share(high).alias("high"))
    report = against_reference(summary, [])
    gaps = [F.abs(F.col(f"candidate_{n}") - F.col(f"reference_{n}")) for n in ("low", "medium", "high")]
    return report.withColumn("total_variation_distance", (gaps[0] + gaps[1] + gaps[2]) / 2)
