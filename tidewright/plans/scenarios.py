"""Queries of risk, diversity, generators and downstream metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.functions.prng import draw, draw_sql
from tidewright.functions.times import to_us
from tidewright.operators import diversity as D
from tidewright.operators import evaluator as E
from tidewright.operators import generators as G
from tidewright.operators import ranks
from tidewright.operators import risk as R
from tidewright.operators import windows
from tidewright.operators.downstream import augmentation_comparison, regression_scores, tune_flow
from tidewright.operators.paths import path_features
from tidewright.plans import evaluator as PE
from tidewright.plans import pipeline as PP
from tidewright.session import cut_lineage, few
from tidewright.sources.tables import table

ASSETS, WEIGHTS = PE.ASSETS, {"BTC": 0.6, "ETH": 0.4}
#: Block lengths that are compared, the one of ``block_bootstrap``, paths of each panel, and steps of a path.
LENGTHS, LENGTH, PATHS, HORIZON = (1, 4, 12, 20, 28, 40, 60, 120), 4, 100, PP.T
_rounded = PE._rounded  # noqa: SLF001
_Q = "id % 20 = 0"  # the stated query set of searches


def portfolio_var_es(spark: SparkSession, sf: str) -> DataFrame:
    """Value at risk and expected shortfall of each asset and the 60/40 portfolio over the paths of each side."""
    rows = R.portfolio_losses(PE.paths(spark, sf), ASSETS, WEIGHTS, ["side"])
    return _rounded(R.var_es(rows, ["side", "target"]))


def portfolio_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Final return and greatest fall of the buy-and-hold portfolio of each path, from an initial value of 100."""
    from pyspark.sql import Window as W

    w = W.partitionBy("path_id").orderBy("step_no").rowsBetween(W.unboundedPreceding, 0)
    value = F.lit(0.0)
    for a, c in ASSETS.items():
        value = value + F.lit(WEIGHTS[a]) * F.exp(F.sum(c).over(w))
    rows = PE.paths(spark, sf).withColumn("value", value * 100)
    rows = rows.withColumn("fall", F.col("value") / F.greatest(F.lit(100.0), F.max("value").over(w)) - 1)
    out = rows.groupBy("path_id", "side").agg(F.max(F.struct("step_no", "value"))["value"].alias("final_value"), F.min("fall").alias("maximum_drawdown"))
    return _rounded(out.withColumn("final_return", F.col("final_value") / 100 - 1))


def risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.unconditional_report(PE.losses(spark, sf)))


def loss_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.loss_summary(PE.losses(spark, sf), ["side", "target"]))


def conditional_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.conditional_report(PE.losses(spark, sf)))


def pit_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.percentile_report(PE.losses(spark, sf)))


def conditional_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference loss's percentile among the candidate's losses of its own condition, summarised per candidate and target."""
    return _rounded(R.conditional_percentile_report(PE.losses(spark, sf)))


def es_stability(spark: SparkSession, sf: str) -> DataFrame:
    """100 resamples of up to 1,000 losses at every level."""
    return _rounded(R.es_stability(PE.losses(spark, sf)))


def wasserstein_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Losses against maximum drawdowns of the same paths: two samples of one size, compared rank by rank."""
    rows = PE.losses(spark, sf).where(F.col("maximum_drawdown").isNotNull())
    a = rows.select("side", "target", F.col("loss").alias("x"))
    b = rows.select("side", "target", F.col("maximum_drawdown").alias("x"))
    return _rounded(ranks.sorted_wasserstein(a, b, ["side", "target"], "x"))


def wasserstein_unequal(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of each generator against the historical ones, samples of different sizes, at as many levels as the larger has losses."""
    rows = PE.losses(spark, sf).select("side", "target", F.col("loss").alias("x"))
    names = few(rows.where(F.col("side") != E.REFERENCE).select("side", "target").distinct().withColumnRenamed("side", "candidate"))
    made = rows.where(F.col("side") != E.REFERENCE).withColumnRenamed("side", "candidate")
    real = rows.where(F.col("side") == E.REFERENCE).drop("side").join(names, "target")
    return _rounded(ranks.sorted_wasserstein(made, real, ["candidate", "target"], "x"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Density of the losses in 50 bins from -1 to 1; losses outside fall into bins 0 and 51."""
    rows = PE.losses(spark, sf)
    bins = rows.groupBy("side", "target", F.width_bucket("loss", F.lit(-1.0), F.lit(1.0), F.lit(50)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.withColumn("bin", F.col("bin").cast("bigint"))


def grouped_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Price distribution of the orders of each priority."""
    rows = table(spark, sf, "orders")
    return _rounded(rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), stats.skew(F.col("o_totalprice")).alias("skewness"), *stats.quantile_columns(F.col("o_totalprice"))), 4)


def bottom_k_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """The ten least plausible paths by the normal density of their final log returns (a top-k report)."""
    final = PE.paths(spark, sf).groupBy("path_id").agg(F.sum("btc_log_return").alias("x"), F.sum("eth_log_return").alias("y"))
    fit = final.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    rows = final.crossJoin(F.broadcast(fit))  # one row
    density = -F.pow((F.col("x") - F.col("mx")) / F.col("sx"), F.lit(2.0)) / 2 - F.pow((F.col("y") - F.col("my")) / F.col("sy"), F.lit(2.0)) / 2 - F.ln(F.col("sx")) - F.ln(F.col("sy"))
    return _rounded(rows.select("path_id", density.alias("log_density")).orderBy("log_density", "path_id").limit(10))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return D.path_vectors(PE.paths(spark, sf), list(ASSETS.values()), ["side"])


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest embeddings of every embedding whose id is divisible by 20."""
    rows = _embeddings(spark, sf)
    return _rounded(D.nearest(rows.where(_Q), rows, k=5, exclude_self=True), 6)


def knn_projected(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf)
    return _rounded(D.nearest(rows.where(_Q), rows, k=1, exclude_self=True, project=24, keep=64), 6)


def distance_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distances to the nearest other embedding, summarised by the label of the asking one."""
    rows = _embeddings(spark, sf)
    found = D.nearest(rows.where(_Q), rows, k=1, exclude_self=True).join(rows.select(F.col("id").alias("query_id"), "label"), "query_id")
    return _rounded(found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *stats.summary(F.col("distance"))), 5)


def _trained(spark: SparkSession, sf: str) -> DataFrame:
    """Paths over the deviations of their asset's returns in training; three in ten historical paths are the reference, the others training."""
    rows = PE.paths(spark, sf)
    training = (F.col("side") == E.REFERENCE) & (F.pmod(draw(9, F.col("path_id")), F.lit(10)) >= 3)
    rows = rows.withColumn("side", F.when(training, F.lit("training")).otherwise(F.col("side")))
    sds = rows.where("side = 'training'").agg(*[F.stddev_pop(c).alias(f"__s_{c}") for c in ASSETS.values()])
    rows = rows.crossJoin(F.broadcast(sds))  # one row
    return rows.withColumns({c: F.col(c) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(F.lit(1.0)) for c in ASSETS.values()})


def neighbour_report(spark: SparkSession, sf: str) -> DataFrame:
    """Near duplicates, near memorisation and coverage of the candidates' standardised paths: near is as near as the closest hundredth
    of training paths are to each other, covered within what 95 % of reference paths have to their own nearest."""
    v = cut_lineage(D.path_vectors(_trained(spark, sf), list(ASSETS.values()), ["side"]).withColumnRenamed("path_id", "id"))
    training, ref = v.where("side = 'training'"), v.where(F.col("side") == E.REFERENCE)
    level = lambda rows, q, name: D.nearest(rows.where(_Q), rows, exclude_self=True).agg(F.percentile("distance", F.lit(q)).alias(name))
    own = cut_lineage(level(training, 0.01, "near").crossJoin(F.broadcast(level(ref, 0.95, "radius"))))  # one row each
    out = None
    for name in sorted(r.side for r in v.select("side").distinct().collect() if r.side not in (E.REFERENCE, "training")):
        cand = v.where(F.col("side") == name)
        asked = cand.where(_Q)
        parts = {"near_duplicate_fraction": ("near", D.nearest(asked, cand, exclude_self=True)), "near_memorization_fraction": ("near", D.nearest(asked, training)), "coverage": ("radius", D.nearest(ref.where(_Q), cand))}
        for metric, (limit, found) in parts.items():
            row = found.crossJoin(F.broadcast(own)).agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("distance") <= F.col(limit)).cast("double")).alias("value"))
            row = row.select(F.lit(name).alias("candidate"), F.lit(metric).alias("metric"), "queries", "value")
            out = row if out is None else out.unionByName(row)
    return _rounded(out)


def unique_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.unique_fraction(_vectors(spark, sf), ["side"], decimals=8))


def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _rounded(D.exact_matches(v.where(F.col("side") != E.REFERENCE), v.where(F.col("side") == E.REFERENCE), ["side"]))


def discriminator(spark: SparkSession, sf: str) -> DataFrame:
    features = path_features(PE.paths(spark, sf), ASSETS, keep=["side"])
    columns = [c for c in features.columns if c not in ("path_id", "side")]
    return D.discriminator(features, columns, ["block_bootstrap", "conditional_flow", "student_cvae", "gaussian_walk", "frozen_last_value"])


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Every tick with its returns; those that a training window covers are the valid ones, so no block has any other."""
    covered = windows.mark_covered(PP.returns(spark, sf), PP._split(PP._index(spark, sf)), "panel_id", PP.C, PP.T)  # noqa: SLF001
    return covered.select("panel_id", "tick_no", F.col("covered").alias("returns_valid"), *PP.RETURNS)


def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = G.block_bootstrap(_training(spark, sf), "panel_id", PP.RETURNS, LENGTH, PATHS, HORIZON)
    return _rounded(out, 9)


def block_length_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Block lengths by mean rank over the errors of five statistics of paths bootstrapped from training returns against the targets
    of the validation windows, and the one chosen: the least rank, then the shortest. Lengths that no training segment has are left out."""
    along = windows.frames("panel_id").rowsBetween(1, PP.T)
    extra = {f"target_{a}": F.collect_list(f"{a}_log_return").over(along) for a in PP.ASSETS}
    index = windows.window_index(windows.candidate_windows(PP.returns(spark, sf), "panel_id", PP.C, PP.T, 1, extra), "panel_id", PP.SPAN)
    held = PP._split(index).where("split = 'validation'")  # noqa: SLF001
    held = held.select(F.concat_ws("-", "panel_id", "sample_id").alias("path"), F.explode(F.arrays_zip(*[f"target_{a}" for a in PP.ASSETS])).alias("v"))
    actual = _pair_statistics(held.select("path", *[F.col(f"v.target_{a}").alias(r) for a, r in zip(PP.ASSETS, PP.RETURNS)]), "actual")
    out, source = None, cut_lineage(_training(spark, sf))
    for length in LENGTHS:
        rows = G.block_bootstrap(source, "panel_id", PP.RETURNS, length, PATHS, HORIZON)
        one = _pair_statistics(rows.select(F.concat_ws("-", "panel_id", "path_no").alias("path"), *PP.RETURNS), "made").withColumn("length", F.lit(length).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    errors = out.where("made is not null").join(actual, "metric").select("length", "metric", F.abs(F.col("made") - F.col("actual")).alias("error"))
    scored = ranks.average_ranks(errors, ["metric"], "error").groupBy("length").agg(F.avg("average_rank").alias("mean_rank"))  # a row for each length
    best = scored.agg(F.min(F.struct("mean_rank", "length"))["length"].alias("best"))
    return _rounded(scored.crossJoin(F.broadcast(best)).select("length", "mean_rank", (F.col("length") == F.col("best")).alias("chosen")))  # one row


def _pair_statistics(rows: DataFrame, name: str) -> DataFrame:
    """Five statistics of single paths, averaged over all of them: metric and value."""
    per = rows.groupBy("path").agg(
        *[F.sum(c).alias(f"s_{c}") for c in PP.RETURNS], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"v_{c}") for c in PP.RETURNS], F.coalesce(F.try_divide(F.covar_pop(*PP.RETURNS), F.stddev_pop(PP.RETURNS[0]) * F.stddev_pop(PP.RETURNS[1])), F.lit(0.0)).alias("c")
    )
    wide = per.agg(
        *[F.stddev_pop(f"s_{c}").alias(f"a{i}") for i, c in enumerate(PP.RETURNS)], *[F.avg(f"v_{c}").alias(f"b{i}") for i, c in enumerate(PP.RETURNS)], F.avg("c").alias("c0")
    )
    names = {"btc_spread": "a0", "eth_spread": "a1", "btc_volatility": "b0", "eth_volatility": "b1", "correlation": "c0"}
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias(name)) for n, c in names.items()])).alias("m")).select("m.*")


def nested_subsets(spark: SparkSession, sf: str) -> DataFrame:
    pool = PE.paths(spark, sf).where(F.col("side") != E.REFERENCE).select("side", "path_id").distinct()
    return G.nested_subsets(pool, ["side"], "path_id", (0.25, 0.5, 1.0))


def augmented_train(spark: SparkSession, sf: str) -> DataFrame:
    """Real paths and each nested share of the bootstrapped ones, with their origin."""
    paths = PE.paths(spark, sf).select("path_id", "side").distinct()
    real = paths.where(F.col("side") == E.REFERENCE).select("path_id", F.lit(0).cast("bigint").alias("synthetic"))
    subsets = G.nested_subsets(paths.where("side = 'block_bootstrap'"), [], "path_id", (0.25, 0.5, 1.0))
    labels = F.explode(F.array(*[F.lit(x) for x in ("000pct", "025pct", "050pct", "100pct")])).alias("dataset")
    made = subsets.select("path_id", F.lit(1).cast("bigint").alias("synthetic"), F.col("subset").alias("dataset"))
    return real.select("path_id", "synthetic", labels).unionByName(made)


#: Draws for each condition, candidate and target.
DRAWS = 1_000


def conditional_draws(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 draws for every condition of every candidate and target."""
    return condition_draws(PE.losses(spark, sf).where(F.col("condition_id").isNotNull() & (F.col("side") != E.REFERENCE)), DRAWS)


def condition_draws(pool: DataFrame, draws: int) -> DataFrame:
    """``draws`` paths of each side, target and condition of ``pool``, with replacement, picked by portable random numbers.

    Targets whose condition has the same paths get the same draws.
    """
    keys = ["side", "target", "condition_id"]
    each = pool.groupBy(*keys).agg(F.array_sort(F.collect_list("path_id")).alias("paths"))
    each = each.select(*keys, "paths", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("draw_no"))
    no = F.pmod(draw(12, F.col("side"), F.col("condition_id"), F.col("draw_no")), F.size("paths")).cast("int")
    return each.select(*keys, "draw_no", F.col("paths")[no].alias("path_id"))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A line fitted on the reference predicts maximum drawdown from loss; errors per side and target, tails included."""
    rows = PE.losses(spark, sf).where(F.col("maximum_drawdown").isNotNull()).select("side", "target", F.col("loss").alias("x"), F.col("maximum_drawdown").alias("y"))
    fit = rows.where(F.col("side") == E.REFERENCE).groupBy("target").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    scored = rows.join(fit, "target").withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    return _rounded(regression_scores(scored, ["side", "target"]), 6)


def downstream_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """Drawdown of the portfolio predicted from path features: real paths alone and with growing shares of bootstrapped ones.

    Three in ten real paths, by portable random numbers, are held out of every training set.
    """
    paths = PE.paths(spark, sf)
    features = path_features(paths, ASSETS, keep=["side"])
    columns = [c for c in features.columns if c not in ("path_id", "side")]
    labels = portfolio_paths(spark, sf).select("path_id", (-F.col("maximum_drawdown")).alias("label"))
    held = (F.col("side") == E.REFERENCE) & (F.pmod(draw(9, F.col("path_id")), F.lit(10)) < 3)
    rows = features.join(labels, "path_id").withColumn("held_out", held)
    return _rounded(augmentation_comparison(rows, augmented_train(spark, sf).select("path_id", "dataset"), columns, "label"), 6)


#: The flow's coordinates are the inverse hyperbolic sine of this times a return: linear for ordinary returns, logarithmic for extremes.
FLOW_SCALE = 50.0
#: Passes over the rows at most, the workers' weights averaged after each.
FLOW_ROUNDS = 60


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Each path's condition: whether its window is known, and both assets' volatility, trend and correlation over that window.

    The window of ``condition_id`` ends before the path begins; ticks without a valid return are left out of it. Paths without a
    window that has two returns get zeros.
    """
    at = lambda c: F.call_function("div", to_us(F.col(c)), F.lit(1_000))
    spans = table(spark, sf, "window_index").where("panel_id is not null and condition_start_utc <= condition_end_utc").select("sample_id", "panel_id", at("condition_start_utc").alias("lo"), at("condition_end_utc").alias("hi"), "loaded_at_utc")
    spans = spans.groupBy("sample_id").agg(F.min(F.struct("loaded_at_utc", "panel_id", "lo", "hi")).alias("w"))  # the first copy of repeated rows
    asked = table(spark, sf, "path_losses").where("condition_id is not null").groupBy("path_id").agg(F.max("condition_id").alias("condition_id"))
    spans = spans.join(asked.select(F.col("condition_id").alias("sample_id")).distinct(), "sample_id", "left_semi")
    ticks = spans.select("sample_id", "w.panel_id", F.explode(F.sequence("w.lo", "w.hi", F.lit(PP._STEP // 1_000))).alias("tick_ms"))  # noqa: SLF001
    r = PP.returns(spark, sf).where("returns_valid").select("panel_id", "tick_ms", *PP.RETURNS)
    state = ticks.join(r, ["panel_id", "tick_ms"]).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.asinh(F.stddev_samp(c) * FLOW_SCALE).alias(f"v_{c}") for c in PP.RETURNS], *[F.asinh(F.sum(c) * 5).alias(f"s_{c}") for c in PP.RETURNS],
        F.coalesce(F.try_divide(F.covar_pop(*PP.RETURNS), F.stddev_pop(PP.RETURNS[0]) * F.stddev_pop(PP.RETURNS[1])), F.lit(0.0)).alias("c")
    ).where("n > 1")
    columns = [c for c in state.columns if c not in ("sample_id", "n")]
    known = F.array(F.lit(1.0), *columns).alias("c")
    return asked.join(state.select(F.col("sample_id").alias("condition_id"), known), "condition_id").select("path_id", "c")


def _flow_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All steps of both assets given the state of the market before the path."""
    v = _vectors(spark, sf).where(F.size("vector") == _FLOW_DIM)
    v = v.select("path_id", "side", F.transform("vector", lambda x: F.asinh(x * FLOW_SCALE)).alias("x")).join(_conditions(spark, sf), "path_id", "left")
    return cut_lineage(v.withColumn("c", F.coalesce("c", F.array(*[F.lit(0.0)] * _FLOW_CONDITIONS))))


def _flow(spark: SparkSession, sf: str) -> tuple[G.CouplingFlow, DataFrame]:
    """A flow fitted on all reference paths but the tenth held out."""
    v = _flow_rows(spark, sf)
    flow = G.CouplingFlow(dim=_FLOW_DIM, condition_dim=_FLOW_CONDITIONS, couplings=8, hidden=256)
    G.fit_flows([flow], [1e-3], v.where(F.col("side") == E.REFERENCE), "path_id", "x", "c", rounds=FLOW_ROUNDS)
    return flow, v


_FLOW_DIM, _FLOW_CONDITIONS = 48, 6
FLOW_CANDIDATES = [{"couplings": c, "hidden": h, "rate": r} for c, h, r in ((4, 128, 5e-4), (6, 128, 5e-4), (8, 128, 1e-3), (10, 128, 1e-3), (8, 256, 1e-3))]


def flow_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Five settings of the flow by held-out likelihood, and which is best."""
    rows = _flow_rows(spark, sf).where(F.col("side") == E.REFERENCE)
    trials = tune_flow(rows, "path_id", "x", "c", _FLOW_DIM, _FLOW_CONDITIONS, FLOW_CANDIDATES, rounds=50)
    best = trials.agg(F.min(F.struct("nll", "trial"))["trial"].alias("best"))
    return trials.crossJoin(F.broadcast(best)).select("trial", "settings", "nll", (F.col("trial") == F.col("best")).alias("chosen"))  # one row


def flow_log_prob(spark: SparkSession, sf: str) -> DataFrame:
    """Log density of each whole path, in the flow's coordinates."""
    flow, v = _flow(spark, sf)
    return flow.score(v, "path_id", "x", "c")


def flow_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Whole paths as log returns, four for the condition of each reference path: all steps of BTC, then of ETH."""
    flow, v = _flow(spark, sf)
    made = flow.sample(v.where(F.col("side") == E.REFERENCE), "path_id", 4, "c")
    return made.withColumn("vector", F.transform("vector", lambda x: F.sinh(x) / FLOW_SCALE))


def student_t_sampler(spark: SparkSession, sf: str) -> DataFrame:
    """Draws around every step of every path."""
    rows = PE.paths(spark, sf).select("path_id", "step_no", F.col("btc_log_return").alias("m0"), F.col("eth_log_return").alias("m1"), *[F.lit(x).alias(n) for n, x in (("s0", -4.0), ("s1", -3.5), ("c", 1.0))])
    return G.student_t_pairs(rows, ids=("path_id", "step_no"))


QUERIES = {
    f.__name__: f
    for f in (
        portfolio_var_es,
        portfolio_paths,
        risk_report,
        loss_summary,
        conditional_risk,
        pit_percentiles,
        conditional_percentiles,
        es_stability,
        wasserstein_sorted,
        wasserstein_unequal,
        histogram,
        grouped_orders,
        bottom_k_scenarios,
        knn_exact,
        knn_projected,
        distance_summary,
        neighbour_report,
        unique_fraction,
        exact_match,
        discriminator,
        block_bootstrap,
        block_length_selection,
        nested_subsets,
        augmented_train,
        conditional_draws,
        regression_metrics,
        downstream_drawdown,
        flow_tuning,
        flow_log_prob,
        flow_sample,
        student_t_sampler,
    )
}

# SQL

_PORTFOLIO = PE.PATHS_SQL + """, wl as (select side, path_id, exp(sum(btc_log_return)) wb, exp(sum(eth_log_return)) we from p group by 1, 2),
pl as (select side, path_id, 'BTC' target, 1 - wb loss from wl union all select side, path_id, 'ETH', 1 - we from wl union all select side, path_id, 'portfolio', 1 - (0.6 * wb + 0.4 * we) from wl)
"""


def _var_es(source: str, groups: str) -> str:
    using = ", ".join(g.strip() for g in groups.split(","))
    return f"""(select {groups}, level, any_value(v) var, avg(loss) es from {source} join (
  select {groups}, 0.95::double level, quantile_cont(loss, 0.95) v from {source} group by {groups} union all select {groups}, 0.99, quantile_cont(loss, 0.99) from {source} group by {groups}) q using ({using})
  where loss >= v group by {groups}, level)"""


_VECTORS = PE.PATHS_SQL + """, vs as (select path_id, side, list(btc_log_return order by step_no) || list(eth_log_return order by step_no) vec from p group by 1, 2)
"""
_rmse = lambda a, b: f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len({a}))"
_BLOCKS = lambda length: f"""st as (select *, sum(returns_valid::int) over (partition by panel_id order by tick_no rows between current row and {length - 1} following) ok from trn),
bl as (select panel_id, tick_no, row_number() over (partition by panel_id order by tick_no) - 1 block_no from st where ok = {length}),
bc as (select panel_id, count(*) n from bl group by 1),
dr as (select panel_id, n, path_no, j, {draw_sql("5042", "panel_id", "path_no", "j")} % n block_no from bc, range({PATHS}) a(path_no), range({-(-HORIZON // length)}) b(j)),
bs as (select dr.panel_id, dr.path_no, j * {length} + (r.tick_no - bl.tick_no) step_no, r.btc_log_return, r.eth_log_return
  from dr join bl using (panel_id, block_no) join ret r on r.panel_id = dr.panel_id and r.tick_no between bl.tick_no and bl.tick_no + {length - 1})"""  # noqa: E731


def _statistics(source: str, path: str) -> str:
    b, e = PP.RETURNS
    return f"""(select stddev_pop(sb) btc_spread, stddev_pop(se) eth_spread, avg(vb) btc_volatility, avg(ve) eth_volatility, avg(c) correlation from (
  select sum({b}) sb, sum({e}) se, coalesce(stddev_samp({b}), 0) vb, coalesce(stddev_samp({e}), 0) ve, case when stddev_pop({b}) * stddev_pop({e}) <> 0 then covar_pop({b}, {e}) / (stddev_pop({b}) * stddev_pop({e})) else 0 end c
  from {source} group by {path}))"""


def _renamed(cte: str, suffix: str) -> str:
    import re

    return re.sub(r"\b(st|bl|bc|dr|bs)\b", rf"\1_{suffix}", cte)


_TRAIN_SQL = PP._UNION_SQL + ", trn as (select r.panel_id, r.tick_no, r.btc_log_return, r.eth_log_return, coalesce(v.c, false) returns_valid from ret r left join cov v using (panel_id, tick_no))"  # noqa: SLF001
_FIVE = ("btc_spread", "eth_spread", "btc_volatility", "eth_volatility", "correlation")
_SELECTION = (
    _TRAIN_SQL
    + """, act as (select s.panel_id, s.sample_id, r.btc_log_return, r.eth_log_return from split s join ret r on s.split = 'validation' and r.panel_id = s.panel_id and r.tick_no between s.tick_no + 1 and s.tick_no + 12)"""
    + "".join(f", {_renamed(_BLOCKS(x), str(x))}" for x in LENGTHS)
    + ", allst as ("
    + " union all ".join(f"select {x} length, * from {_statistics(f'(select * from bs_{x} where step_no < {HORIZON})', 'panel_id, path_no')}" for x in LENGTHS)
    + f"), a as (select * from {_statistics('act', 'panel_id, sample_id')}), er as ("
    + " union all ".join(f"select length, '{m}' metric, abs(allst.{m} - a.{m}) error from allst, a where allst.{m} is not null" for m in _FIVE)
    + "), rk as (select *, rank() over (partition by metric order by error) + (count(*) over (partition by metric, error) - 1) / 2.0 r from er), mr as (select cast(length as bigint) length, avg(r) m from rk group by 1)"
    + " select length, round(m, 7) mean_rank, row_number() over (order by m, length) = 1 chosen from mr"
)
_SUBSETS = f"""(select side, path_id, row_number() over (partition by side order by {draw_sql("42", "path_id")}, path_id) rk, count(*) over (partition by side) n from (select distinct side, path_id from p where side <> 'reference'))"""
_SHARES = "(values ('025pct', 0.25::double), ('050pct', 0.5), ('100pct', 1.0)) s(subset, ratio)"
_r = PE._r  # noqa: SLF001

ORACLE = {
    "portfolio_var_es": _PORTFOLIO + f"select side, target, level, round(var, 7) + 0.0 var, round(es, 7) + 0.0 es from {_var_es('pl', 'side, target')}",
    "portfolio_paths": PE.PATHS_SQL
    + """, v as (select *, 100 * (0.6 * exp(sum(btc_log_return) over w) + 0.4 * exp(sum(eth_log_return) over w)) as val from p window w as (partition by path_id order by step_no)),
f as (select *, val / greatest(100.0, max(val) over (partition by path_id order by step_no)) - 1 fall from v)
select path_id, side, round(arg_max(val, step_no), 7) + 0.0 final_value, round(min(fall), 7) + 0.0 maximum_drawdown, round(arg_max(val, step_no) / 100 - 1, 7) + 0.0 final_return from f group by 1, 2""",
    "risk_report": PE.LOSSES_SQL
    + f""", m as {_var_es("lo", "side, target")},
b as (select c.side candidate, c.target, c.level, c.var cv, c.es ce, r.var rv, r.es re from m c join m r on c.side <> 'reference' and r.side = 'reference' and c.target = r.target and c.level = r.level),
h as (select candidate, b.target, level, any_value(cv) cv, any_value(ce) ce, any_value(rv) rv, any_value(re) re, count(*) observations, count(*) filter (loss > cv) exceptions from b join lo on lo.side = 'reference' and lo.target = b.target group by 1, 2, 3)
select candidate, target, level, round(rv, 7) + 0.0 reference_var, round(re, 7) + 0.0 reference_es, round(cv, 7) + 0.0 candidate_var, round(ce, 7) + 0.0 candidate_es, observations, exceptions, round(abs(cv - rv), 7) + 0.0 var_error, round(abs(ce - re), 7) + 0.0 es_error,
  round(exceptions / observations, 7) + 0.0 exception_rate, round(1 - level, 7) expected_rate, round(abs(exceptions / observations - (1 - level)), 7) + 0.0 coverage_error from h""",
    "loss_summary": PE.LOSSES_SQL
    + f", s as (select side, target, count(*) n, avg(loss) mean, coalesce(stddev_samp(loss), 0) standard_deviation, max(loss) worst, avg((loss < 0)::int) profit_probability, {PE._q('loss')} from lo group by 1, 2) select side, target, n, {_r(['mean', 'standard_deviation', 'worst', 'profit_probability', 'q01', 'q05', 'q50', 'q95', 'q99'])} from s",  # noqa: SLF001
    "conditional_risk": PE.LOSSES_SQL
    + f""", k as (select * from lo where condition_id is not null and side <> 'reference'), m as {_var_es("k", "side, target, condition_id")},
j as (select m.*, r.loss rl from m join lo r on r.side = 'reference' and r.target = m.target and r.condition_id = m.condition_id)
select side candidate, target, level, count(*) observations, count(*) filter (rl > var) exceptions, round(avg(var), 7) + 0.0 mean_forecast_var, round(avg(es), 7) + 0.0 mean_forecast_es,
  round(count(*) filter (rl > var) / count(*), 7) + 0.0 exception_rate, round(abs(count(*) filter (rl > var) / count(*) - (1 - level)), 7) + 0.0 coverage_error from j group by 1, 2, 3""",
    "pit_percentiles": PE.LOSSES_SQL
    + f""", c as (select distinct side candidate, target from lo where side <> 'reference'), r as (select * from lo where side = 'reference'),
srt as (select side, target, list(loss order by loss) ls from lo where side <> 'reference' group by 1, 2),
u as (
  select candidate, target, path_id, loss, 0 s from c join r using (target) union all select side, target, null, loss, 1 from lo where side <> 'reference'),
e as (select *, sum(s) over (partition by candidate, target order by loss range unbounded preceding) / sum(s) over (partition by candidate, target) percentile from u),
k as (select candidate, target, percentile, row_number() over (partition by candidate, target order by percentile) i, count(*) over (partition by candidate, target) nn from e where s = 0),
s as (select candidate, target, count(*) n, avg(percentile) mean, coalesce(stddev_samp(percentile), 0) standard_deviation, {PE._q("percentile", [(0.05, "q05"), (0.5, "q50"), (0.95, "q95")])}, max(greatest(i / nn - percentile, percentile - (i - 1) / nn)) ks from k group by 1, 2)
select candidate, target, n, {_r(["mean", "standard_deviation", "q05", "q50", "q95", "ks"])} from s""",  # noqa: SLF001
    "conditional_percentiles": PE.LOSSES_SQL
    + f""", k as (select * from lo where condition_id is not null), e as (
  select c.side candidate, r.target, r.path_id, avg((c.loss <= r.loss)::int) percentile from k r join k c on r.side = 'reference' and c.side <> 'reference' and c.target = r.target and c.condition_id = r.condition_id group by 1, 2, 3),
o as (select *, row_number() over (partition by candidate, target order by percentile) i, count(*) over (partition by candidate, target) nn from e),
s as (select candidate, target, count(*) n, avg(percentile) mean, coalesce(stddev_samp(percentile), 0) standard_deviation, {PE._q("percentile", [(0.05, "q05"), (0.5, "q50"), (0.95, "q95")])}, max(greatest(i / nn - percentile, percentile - (i - 1) / nn)) ks from o group by 1, 2)
select candidate, target, n, {_r(["mean", "standard_deviation", "q05", "q50", "q95", "ks"])} from s""",  # noqa: SLF001
    "es_stability": PE.LOSSES_SQL
    + f""", nm as (select side, target, loss, row_number() over (partition by side, target order by loss, path_id) - 1 no from lo), ct as (select side, target, count(*) n from nm group by 1, 2),
dw as (select side, target, rep, {draw_sql("42", "rep", "i")} % n no from ct, range(100) a(rep), range(1000) b(i) where i < n),
sm as (select dw.side, dw.target, dw.rep, loss from dw join nm using (side, target, no)), m as {_var_es("sm", "side, target, rep")},
s as (select side, target, level, avg(es) es_mean, coalesce(stddev_samp(es), 0) es_deviation from m group by 1, 2, 3)
select side, target, level, round(es_mean, 7) + 0.0 es_mean, round(es_deviation, 7) + 0.0 es_deviation, case when es_mean <> 0 then round(es_deviation / abs(es_mean), 7) + 0.0 end es_relative_deviation from s""",
    "wasserstein_sorted": PE.LOSSES_SQL
    + """, a as (select side, target, loss, row_number() over (partition by side, target order by loss) i from lo where maximum_drawdown is not null), b as (select side, target, maximum_drawdown m, row_number() over (partition by side, target order by maximum_drawdown) i from lo where maximum_drawdown is not null)
select side, target, round(avg(abs(loss - m)), 7) + 0.0 wasserstein_1 from a join b using (side, target, i) group by 1, 2""",
    "wasserstein_unequal": PE.LOSSES_SQL
    + """, k as (select side, target, list(loss order by loss) s, count(*) n from lo group by 1, 2), j as (select c.side candidate, c.target, c.s a, r.s b, c.n n, r.n m, greatest(c.n, r.n) g from k c join k r on c.side <> 'reference' and r.side = 'reference' and c.target = r.target),
i as (select candidate, target, a, b, n, m, g, unnest(range(g)) i from j), l as (select *, case when g > 1 then (n - 1) * i / (g - 1)::double else 0 end u, case when g > 1 then (m - 1) * i / (g - 1)::double else 0 end w from i),
d as (select candidate, target, a[floor(u)::bigint + 1] + (a[ceil(u)::bigint + 1] - a[floor(u)::bigint + 1]) * (u - floor(u)) x, b[floor(w)::bigint + 1] + (b[ceil(w)::bigint + 1] - b[floor(w)::bigint + 1]) * (w - floor(w)) y from l)
select candidate, target, round(avg(abs(x - y)), 7) + 0.0 wasserstein_1 from d group by 1, 2""",
    "histogram": PE.LOSSES_SQL
    + " select side, target, cast(case when loss < -1 then 0 when loss >= 1 then 51 else floor(50 * (loss + 1) / 2) + 1 end as bigint) bin, count(*) n from lo group by 1, 2, 3",
    "grouped_orders": f"""with z as (select *, avg(o_totalprice) over (partition by o_orderpriority) mu, stddev_pop(o_totalprice) over (partition by o_orderpriority) sp from orders),
s as (select o_orderpriority, count(*) n, avg(o_totalprice) mean, case when max(sp) > 0 then avg(power((o_totalprice - mu) / nullif(sp, 0), 3)) else 0 end skewness, {PE._q("o_totalprice")} from z group by 1)
select o_orderpriority, n, {_r(["mean", "skewness", "q01", "q05", "q50", "q95", "q99"], 4)} from s""",  # noqa: SLF001
    "bottom_k_scenarios": PE.PATHS_SQL
    + """, f as (select path_id, sum(btc_log_return) x, sum(eth_log_return) y from p group by 1), g as (select avg(x) mx, avg(y) my, stddev_pop(x) sx, stddev_pop(y) sy from f),
d as (select path_id, -power((x - mx) / sx, 2) / 2 - power((y - my) / sy, 2) / 2 - ln(sx) - ln(sy) log_density from f, g) select path_id, round(log_density, 7) + 0.0 log_density from d order by d.log_density, path_id limit 10""",
    "knn_exact": f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
d as (select a.vec_id query_id, b.vec_id neighbour_id, {_rmse("a.v", "b.v")} distance from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, neighbour_id, round(distance, 6) distance from (select *, row_number() over (partition by query_id order by distance, neighbour_id) rn from d) where rn <= 5""",
    "distance_summary": f"""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
d as (select a.vec_id, any_value(a.label) label, min({_rmse("a.v", "b.v")}) d from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id group by 1),
s as (select label, count(*) n, avg(d) mean, coalesce(stddev_samp(d), 0) standard_deviation, {PE._q("d")} from d group by 1)
select label, n, {_r(["mean", "standard_deviation", "q01", "q05", "q50", "q95", "q99"], 5)} from s""",  # noqa: SLF001
    "neighbour_report": PE.PATHS_SQL
    + f""", p1 as (select * replace (case when side = 'reference' and {draw_sql("9", "path_id")} % 10 >= 3 then 'training' else side end as side) from p),
sd as (select stddev_pop(btc_log_return) sb, stddev_pop(eth_log_return) se from p1 where side = 'training'),
vs as (select path_id, side, list(btc_log_return / case when sb > 0 then sb else 1 end order by step_no) || list(eth_log_return / case when se > 0 then se else 1 end order by step_no) vec from p1, sd group by 1, 2),
tt as (select a.path_id, min({_rmse("a.vec", "b.vec")}) d from vs a join vs b on a.side = 'training' and b.side = 'training' and a.path_id <> b.path_id and a.path_id % 20 = 0 group by 1),
rr as (select a.path_id, min({_rmse("a.vec", "b.vec")}) d from vs a join vs b on a.side = 'reference' and b.side = 'reference' and a.path_id <> b.path_id and a.path_id % 20 = 0 group by 1),
t as (select (select quantile_cont(d, 0.01) from tt) near, (select quantile_cont(d, 0.95) from rr) radius),
nd as (select a.side, a.path_id, min({_rmse("a.vec", "b.vec")}) d from vs a join vs b on a.side not in ('reference', 'training') and a.side = b.side and a.path_id <> b.path_id and a.path_id % 20 = 0 group by 1, 2),
nm as (select a.side, a.path_id, min({_rmse("a.vec", "b.vec")}) d from vs a join vs b on a.side not in ('reference', 'training') and b.side = 'training' and a.path_id % 20 = 0 group by 1, 2),
cv as (select b.side, a.path_id, min({_rmse("a.vec", "b.vec")}) d from vs a join vs b on a.side = 'reference' and b.side not in ('reference', 'training') and a.path_id % 20 = 0 group by 1, 2),
names as (select distinct side candidate from vs where side not in ('reference', 'training')),
u as (select side, 'near_duplicate_fraction' metric, d, near lim from nd, t union all select side, 'near_memorization_fraction', d, near from nm, t union all select side, 'coverage', d, radius from cv, t)
select candidate, m.metric, count(u.d) queries, round(avg((u.d <= u.lim)::int), 7) + 0.0 as value
from names cross join (values ('near_duplicate_fraction'), ('near_memorization_fraction'), ('coverage')) m(metric) left join u on u.side = candidate and u.metric = m.metric group by 1, 2""",
    "unique_fraction": _VECTORS
    + """, k as (select side, list_transform(vec, lambda x: round_even(x, 8) + 0.0) v from vs), s as (select side, count(*) n, count(distinct v) distinct_n from k group by 1)
select side, n, distinct_n, round(distinct_n / n, 7) + 0.0 unique_fraction, round(1 - distinct_n / n, 7) + 0.0 redundant_fraction from s""",
    "exact_match": _VECTORS
    + """, k as (select side, list_transform(vec, lambda x: round_even(x, 12) + 0.0) v from vs)
select side, count(*) n, count(*) filter (v in (select v from k where side = 'reference')) matches, round(count(*) filter (v in (select v from k where side = 'reference')) / count(*), 7) + 0.0 exact_match_fraction from k where side <> 'reference' group by 1""",
    "block_bootstrap": _TRAIN_SQL + ", " + _BLOCKS(LENGTH) + f" select panel_id, path_no, step_no, round(btc_log_return, 9) + 0.0 btc_log_return, round(eth_log_return, 9) + 0.0 eth_log_return from bs where step_no < {HORIZON}",
    "block_length_selection": _SELECTION,
    "nested_subsets": PE.PATHS_SQL + f" select side, path_id, subset from {_SUBSETS}, {_SHARES} where rk <= round_even(n * ratio, 0)",
    "augmented_train": PE.PATHS_SQL
    + f""" select distinct path_id, 0::bigint synthetic, dataset from p, (values ('000pct'), ('025pct'), ('050pct'), ('100pct')) d(dataset) where side = 'reference'
union all select path_id, 1, subset from {_SUBSETS}, {_SHARES} where side = 'block_bootstrap' and rk <= round_even(n * ratio, 0)""",
    "conditional_draws": PE.LOSSES_SQL
    + f""", pool as (select * from lo where condition_id is not null and side <> 'reference'),
nm as (select side, target, condition_id, path_id, row_number() over (partition by side, target, condition_id order by path_id) - 1 no from pool), ct as (select side, target, condition_id, count(*) n from nm group by 1, 2, 3),
dw as (select side, target, condition_id, i draw_no, {draw_sql("12", "side", "condition_id", "i")} % n no from ct, range({DRAWS}) a(i)) select side, target, condition_id, draw_no, path_id from dw join nm using (side, target, condition_id, no)""",
    "regression_metrics": PE.LOSSES_SQL
    + """, d as (select side, target, loss x, maximum_drawdown y from lo where maximum_drawdown is not null), f as (select target, regr_slope(y, x) b, regr_intercept(y, x) a from d where side = 'reference' group by 1),
t as (select side, target, quantile_cont(y, 0.9) q90, quantile_cont(y, 0.95) q95, avg(y) my from d group by 1, 2), z as (select d.*, a + b * x p, q90, q95, my from d join f using (target) join t using (side, target)),
s as (select side, target, count(*) n, avg(abs(p - y)) mae, sqrt(avg((p - y) * (p - y))) rmse, case when sum((y - my) * (y - my)) > 0 then 1 - sum((p - y) * (p - y)) / sum((y - my) * (y - my)) else 0 end r2,
  case when stddev_pop(p) * stddev_pop(y) <> 0 then covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)) else 0 end correlation, avg(abs(p - y)) filter (y >= q90) mae_worst_10, avg(abs(p - y)) filter (y >= q95) mae_worst_5 from z group by 1, 2)
select side, target, n, """
    + _r(["mae", "rmse", "r2", "correlation", "mae_worst_10", "mae_worst_5"], 6)
    + " from s",
}
