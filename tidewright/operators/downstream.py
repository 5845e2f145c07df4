"""Downstream use of paths: regression on augmented training sets, its metrics, and the search for a flow's settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators.generators import CouplingFlow, fit_flows
from tidewright.operators.scan import join_on
from tidewright.session import cut_lineage, few


def regression_scores(scored: DataFrame, groups: Sequence[str], actual: str = "y", predicted: str = "p") -> DataFrame:
    """Errors of predictions per group: mean absolute and root mean square error, R2 (0 without variance), correlation (0 if
    degenerate), and the mean absolute error over the worst tenth and twentieth by actual value."""
    rows = scored.select(*groups, F.col(actual).alias("__y"), F.col(predicted).alias("__p"))
    y, p = F.col("__y"), F.col("__p")
    cuts = stats.grouped_quantiles(rows, groups, "__y", (0.9, 0.95)).toDF(*groups, "__q90", "__q95")
    ends = few(join_on(cuts, rows.groupBy(*groups).agg(F.avg(y).alias("__m")), groups))
    both = join_on(rows, ends, groups, "inner")
    e = F.abs(p - y)
    sst = F.sum(F.pow(y - F.col("__m"), F.lit(2.0)))
    return both.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).otherwise(F.lit(0.0)).alias("r2"),
        F.coalesce(F.try_divide(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y)), F.lit(0.0)).alias("correlation"),
        F.avg(F.when(y >= F.col("__q90"), e)).alias("mae_worst_10"),
        F.avg(F.when(y >= F.col("__q95"), e)).alias("mae_worst_5"),
    )


def augmentation_comparison(rows: DataFrame, datasets: DataFrame, columns: Sequence[str], label: str, ridge: float = 1e-4) -> DataFrame:
    """A ridge regression for each training set, all scored on the same held-out real rows.

    ``rows`` has ``path_id``, ``held_out`` and the features; ``datasets`` names the training paths of each ``dataset``. A linear
    model fitted in one distributed pass stands for the neural regressor of the original study.
    """
    data = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip").transform(rows)
    # written once, as every model reads them; features cost far more than what is kept of them
    data = cut_lineage(data.select("path_id", "held_out", "__x", F.col(label).cast("double").alias("y")))
    datasets = cut_lineage(datasets.select("path_id", "dataset"))
    train = data.where(~F.col("held_out")).join(datasets, "path_id")
    held = data.where("held_out")
    names = sorted(r.dataset for r in datasets.select("dataset").distinct().collect())  # a handful
    model = LinearRegression(featuresCol="__x", labelCol="y", predictionCol="p", regParam=ridge, solver="normal")
    scored = None
    for name in names:
        part = model.fit(train.where(F.col("dataset") == name)).transform(held).select(F.lit(name).alias("dataset"), "y", "p")
        scored = part if scored is None else scored.unionByName(part)
    return regression_scores(scored, ["dataset"])


def tune_flow(rows: DataFrame, key: str, vector: str, condition: str, dim: int, condition_dim: int, candidates: Sequence[dict], rounds: int = 50, passes: int = 1) -> DataFrame:
    """Held-out negative log-likelihood of each candidate's flow, all fitted side by side on all rows: ``trial``, ``settings``, ``nll``.

    A candidate's ``rate`` is its learning rate.
    """
    settings = [dict(c) for c in candidates]
    rates = [c.pop("rate", 1e-3) for c in settings]
    flows = [CouplingFlow(dim=dim, condition_dim=condition_dim, **c) for c in settings]
    fit_flows(flows, rates, rows, key, vector, condition, rounds=rounds, passes=passes)
    made = [(i, str(sorted(c.items())), float(min(f.history))) for i, (c, f) in enumerate(zip(candidates, flows))]
    return rows.sparkSession.createDataFrame(made, "trial int, settings string, nll double")
