"""Risk of simulated losses: value at risk, expected shortfall, exceptions, calibration and stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.functions.prng import draw
from tidewright.operators.evaluator import REFERENCE
from tidewright.operators.ranks import ecdf_at, ks_to_uniform, ranked
from tidewright.operators.scan import join_on
from tidewright.session import few

LEVELS = (0.95, 0.99)


def portfolio_losses(paths: DataFrame, assets: dict[str, str], weights: dict[str, float], keep: Sequence[str], path: str = "path_id", name: str = "portfolio") -> DataFrame:
    """Loss of each asset and of the buy-and-hold portfolio over each path: 1 minus final wealth."""
    if abs(sum(weights.values()) - 1) > 1e-9 or min(weights.values()) < 0:
        raise ValueError("weights must be non-negative and add up to 1")
    wealth = paths.groupBy(path, *keep).agg(*[F.exp(F.sum(c)).alias(f"__w_{a}") for a, c in assets.items()])
    whole = F.lit(0.0)
    for a, w in weights.items():
        whole = whole + F.lit(w) * F.col(f"__w_{a}")
    each = [F.struct(F.lit(a).alias("target"), (1 - F.col(f"__w_{a}")).alias("loss")) for a in assets]
    each.append(F.struct(F.lit(name).alias("target"), (1 - whole).alias("loss")))
    return wealth.select(path, *keep, F.explode(F.array(*each)).alias("__t")).select(path, *keep, "__t.target", "__t.loss")


def var_es(losses: DataFrame, groups: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """Value at risk (quantile) and expected shortfall (mean of the losses at or beyond it) per group and level."""
    wide = stats.grouped_quantiles(losses, groups, "loss", levels).toDF(*groups, *[f"__q{i}" for i in range(len(levels))])
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col(f"__q{i}").alias("var")) for i, q in enumerate(levels)])).alias("__l")
    limits = wide.select(*groups, each).select(*groups, "__l.level", "__l.var").where("var is not null")
    tail = join_on(losses.select(*groups, "loss"), few(limits), groups, "inner").where(F.col("loss") >= F.col("var"))
    return tail.groupBy(*groups, "level").agg(F.first("var").alias("var"), F.avg("loss").alias("es"))


def loss_summary(losses: DataFrame, groups: Sequence[str]) -> DataFrame:
    x = F.col("loss")
    base = losses.groupBy(*groups).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        stats.sample_sd(x).alias("standard_deviation"),
        F.max(x).alias("worst"),
        F.avg((x < 0).cast("double")).alias("profit_probability"),
    )
    return join_on(base, stats.grouped_quantiles(losses, groups, "loss", stats.QUANTILES), groups)


def unconditional_report(losses: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Per candidate, target and level: both sides' risk, and the reference losses beyond the candidate's value at risk."""
    measured = var_es(losses, ["side", "target"], levels)
    ref = measured.where(F.col("side") == REFERENCE).select("target", "level", F.col("var").alias("reference_var"), F.col("es").alias("reference_es"))
    cand = measured.where(F.col("side") != REFERENCE).select(F.col("side").alias("candidate"), "target", "level", F.col("var").alias("candidate_var"), F.col("es").alias("candidate_es"))
    both = cand.join(ref, ["target", "level"])
    real = losses.where(F.col("side") == REFERENCE).select("target", "loss")
    both = few(both)
    hits = real.join(both.select("candidate", "target", "level", "candidate_var"), "target")
    hits = hits.groupBy("candidate", "target", "level").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("loss") > F.col("candidate_var")).alias("exceptions"))
    out = both.join(hits, ["candidate", "target", "level"])
    rate = F.col("exceptions") / F.col("observations")
    expected = F.lit(1.0) - F.col("level")
    return out.withColumns(
        {
            "var_error": F.abs(F.col("candidate_var") - F.col("reference_var")),
            "es_error": F.abs(F.col("candidate_es") - F.col("reference_es")),
            "exception_rate": rate,
            "expected_rate": expected,
            "coverage_error": F.abs(rate - expected),
        }
    )


def conditional_report(losses: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Forecasts per condition: each reference loss against the value at risk of the candidate's draws for its condition."""
    known = losses.where(F.col("condition_id").isNotNull())
    forecasts = var_es(known.where(F.col("side") != REFERENCE), ["side", "target", "condition_id"], levels)
    real = known.where(F.col("side") == REFERENCE).select("target", "condition_id", "loss")
    joined = forecasts.join(real, ["target", "condition_id"])
    out = joined.groupBy(F.col("side").alias("candidate"), "target", "level").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("loss") > F.col("var")).alias("exceptions"),
        F.avg("var").alias("mean_forecast_var"),
        F.avg("es").alias("mean_forecast_es"),
    )
    rate = F.col("exceptions") / F.col("observations")
    return out.withColumns({"exception_rate": rate, "coverage_error": F.abs(rate - (F.lit(1.0) - F.col("level")))})


def percentile_points(losses: DataFrame) -> DataFrame:
    """For each reference loss and candidate the share of the candidate's losses at most as large."""
    cands = losses.where(F.col("side") != REFERENCE).select(F.col("side").alias("candidate"), "target", "loss")
    names = few(cands.select("candidate", "target").distinct())
    points = losses.where(F.col("side") == REFERENCE).select("path_id", "target", "loss").join(names, "target")
    return ecdf_at(points, cands, ["candidate", "target"], "loss", "percentile")


def conditional_percentile_report(losses: DataFrame) -> DataFrame:
    """As ``percentile_report``, each reference loss among the candidate's losses of the same condition. Conditions that either
    side lacks are left out."""
    known = losses.where(F.col("condition_id").isNotNull())
    cands = known.where(F.col("side") != REFERENCE).select(F.col("side").alias("candidate"), "target", "condition_id", "loss")
    names = cands.select("candidate", "target", "condition_id").distinct()
    points = known.where(F.col("side") == REFERENCE).select("path_id", "target", "condition_id", "loss").join(names, ["target", "condition_id"])
    return _calibration(ecdf_at(points, cands, ["candidate", "target", "condition_id"], "loss", "percentile"))


def percentile_report(losses: DataFrame) -> DataFrame:
    return _calibration(percentile_points(losses))


def _calibration(points: DataFrame) -> DataFrame:
    p = F.col("percentile")
    base = points.groupBy("candidate", "target").agg(F.count(p).alias("n"), *stats.summary(p, quantiles=(0.05, 0.5, 0.95)))
    return base.join(ks_to_uniform(points, ["candidate", "target"], "percentile"), ["candidate", "target"])


def _beyond(limit: str):
    return lambda x: x >= F.col(limit)


def es_stability(losses: DataFrame, levels: Sequence[float] = LEVELS, repetitions: int = 100, size: int = 1_000, seed: int = 42) -> DataFrame:
    """Spread of the expected shortfall at each level over resamples with replacement of at most ``size`` losses.

    Resampled rows are picked by portable random numbers, so every engine draws the same ones; all levels share them.
    """
    groups = ["side", "target"]
    numbered = ranked(losses.select(*groups, "path_id", "loss"), groups, "loss", ["path_id"], "no")
    counts = numbered.groupBy(*groups).agg(F.count("no").alias("n"))
    draws = counts.select(*groups, "n", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(size), F.col("n")) - 1)).alias("i"))
    draws = draws.select(*groups, "rep", F.pmod(draw(seed, F.col("rep"), F.col("i")), F.col("n")).alias("no"))
    sample = draws.join(numbered.select(*groups, "no", "loss"), [*groups, "no"]).select(*groups, "rep", "loss")
    # a resample has at most ``size`` losses, so it is read in one pass as a whole
    each = sample.groupBy(*groups, "rep").agg(*[stats.quantile(F.col("loss"), q).alias(f"__q{i}") for i, q in enumerate(levels)], F.collect_list("loss").alias("all"))
    tails = each.select(*groups, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("level"), F.filter("all", _beyond(f"__q{i}")).alias("tail")) for i, q in enumerate(levels)])).alias("__t"))
    tail = F.col("__t.tail")
    each = tails.select(*groups, "__t.level", (F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)).alias("es"))
    out = each.groupBy(*groups, "level").agg(F.avg("es").alias("es_mean"), stats.sample_sd(F.col("es")).alias("es_deviation"))
    return out.withColumn("es_relative_deviation", F.when(F.col("es_mean") != 0, F.col("es_deviation") / F.abs("es_mean")))
