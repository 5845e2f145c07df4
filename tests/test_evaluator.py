"""Comparison of paths: identities, shifts, boundaries of paths, degenerate input, and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import diversity, downstream, evaluator, generators, paths, ranks, risk, windows
from tidewright.operators.evaluator import REFERENCE

ASSETS = {"A": "a", "B": "b"}


def frame(spark, batches):
    """batches: side -> array of paths, steps and two assets."""
    data, n = [], 0
    for side, x in batches.items():
        for p in np.asarray(x, float):
            data += [(n, t, side, float(r[0]), float(r[1])) for t, r in enumerate(p)]
            n += 1
    return spark.createDataFrame(data, "path_id bigint, step_no int, side string, a double, b double")


def long(spark, batches):
    return paths.by_asset(frame(spark, batches), ASSETS, ["path_id", "step_no", "side"])


def noise(n=40, t=20, seed=1):
    return np.random.default_rng(seed).normal(0, 0.02, (n, t, 2))


def test_marginal_identity_and_shift(spark):
    x = noise()
    got = {(r.candidate, r.asset): r for r in evaluator.marginal_report(long(spark, {REFERENCE: x, "same": x, "moved": x + 0.01})).collect()}
    assert len(got) == 4
    assert got["same", "A"].wasserstein_1 == pytest.approx(0, abs=1e-12) and got["moved", "B"].wasserstein_1 == pytest.approx(0.01)
    flat = x[:, :, 0].ravel()
    r = got["same", "A"]
    assert r.candidate_mean == pytest.approx(flat.mean()) and r.candidate_standard_deviation == pytest.approx(flat.std(ddof=1))
    z = (flat - flat.mean()) / flat.std()
    assert r.reference_skewness == pytest.approx((z**3).mean()) and r.reference_excess_kurtosis == pytest.approx((z**4).mean() - 3)
    assert r.extreme_threshold == pytest.approx(np.quantile(abs(flat), 0.99)) and r.candidate_q05 == pytest.approx(np.quantile(flat, 0.05))


def test_marginal_degenerate(spark):
    r = evaluator.marginal_report(long(spark, {REFERENCE: np.zeros((3, 4, 2)), "ones": np.ones((3, 4, 2))})).first()
    assert r.normalized_wasserstein_1 is None and r.wasserstein_1 == pytest.approx(1.0) and r.reference_skewness == 0.0


def test_path_metrics_by_hand(spark):
    wealth = np.array([1.10, 0.88, 0.968])
    r = np.diff(np.log(np.concatenate([[1.0], wealth])))
    m = paths.path_metrics(long(spark, {"x": [np.stack([r, r], axis=1)]}), ["path_id", "asset"]).first()
    assert m.final_cumulative_return == pytest.approx(-0.032) and m.maximum_drawdown == pytest.approx(0.20)
    assert m.maximum_drawdown_duration_steps == 2 and m.time_to_minimum_value_steps == 2
    assert m.intrahorizon_maximum_return == pytest.approx(0.10) and m.intrahorizon_minimum_return == pytest.approx(-0.12)


def test_drawdown_duration_resets(spark):
    r = np.diff(np.log([1.0, 1.10, 0.88, 1.20]))
    m = paths.path_metrics(long(spark, {"x": [np.stack([r, r], axis=1)]}), ["path_id", "asset"]).first()
    assert m.maximum_drawdown_duration_steps == 1


def test_paths_are_isolated(spark):
    up, down = np.full((4, 2), math.log(1.01)), np.full((4, 2), math.log(0.99))
    m = paths.path_metrics(long(spark, {"x": [up, down]}), ["path_id", "asset"], keep=["side"])
    assert m.agg(F.avg("final_cumulative_return")).first()[0] == pytest.approx((1.01**4 - 1 + 0.99**4 - 1) / 2)


def test_acf_does_not_cross_paths(spark):
    x = np.stack([np.ones((8, 2)), -np.ones((8, 2))])
    got = paths.pooled_acf(long(spark, {"x": x}), ["side", "asset"], ["path_id", "asset"], 2, {"return": F.col("x")})
    assert [r.acf for r in got.collect()] == pytest.approx([1.0] * 4)


def test_temporal_identity_and_shuffle(spark):
    rng = np.random.default_rng(3)
    x = np.zeros((80, 40, 2))
    for t in range(1, 40):
        x[:, t] = 0.75 * x[:, t - 1] + rng.normal(0, 0.01, (80, 2))
    mixed = x[:, rng.permutation(40)]
    got = {(r.candidate, r.asset): r for r in evaluator.temporal_report(long(spark, {REFERENCE: x, "same": x, "mixed": mixed})).collect()}
    assert got["same", "A"].return_acf_rmse == pytest.approx(0, abs=1e-9) and got["same", "A"].volatility_persistence_error == pytest.approx(0, abs=1e-9)
    assert got["mixed", "A"].return_acf_rmse > 0.1


def test_rolling_windows_are_full(spark):
    x = noise(2, 6)
    got = paths.rolling_sd(long(spark, {"x": x}), ["path_id", "asset"], 4).collect()
    assert len(got) == 2 * 2 * 3
    for r in got:
        want = x[r.path_id, r.step_no - 3 : r.step_no + 1, 0 if r.asset == "A" else 1].std(ddof=1)
        assert r.volatility == pytest.approx(want)


def test_rolling_correlation_stays_in_its_path(spark):
    t = np.arange(8.0)
    x = np.stack([np.stack([t, t], axis=1), np.stack([t, -t], axis=1)])
    got = paths.rolling_correlation(frame(spark, {"x": x}), ["path_id"], 4, "a", "b").collect()
    assert sorted(round(r.correlation) for r in got) == [-1] * 5 + [1] * 5


def test_cross_asset_constant_candidate(spark):
    got = {r.candidate: r for r in evaluator.cross_asset_report(frame(spark, {REFERENCE: noise(), "flat": np.zeros((5, 20, 2)), "same": noise()}), ASSETS, 5).collect()}
    flat = got["flat"]
    assert flat.candidate_correlation is None and flat.candidate_valid_fraction == 0.0 and flat.rolling_correlation_wasserstein_1 is None and flat.candidate_rolling_mean is None
    assert got["same"].correlation_error == pytest.approx(0) and got["same"].rolling_correlation_wasserstein_1 == pytest.approx(0, abs=1e-12) and got["same"].asset_pair == "A-B"


def test_true_runs(spark):
    flags = spark.createDataFrame([(1, t, t in (0, 1, 3, 5, 6, 7)) for t in range(8)] + [(2, 0, True)], "p bigint, step_no int, f boolean")
    assert sorted(r.length for r in paths.true_runs(flags, ["p"], "f").collect()) == [1, 1, 2, 3]


def test_incomplete_paths_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, None, 2.0), (2, 0, 1.0, 1.0), (3, 0, math.nan, 1.0)], "path_id bigint, step_no int, a double, b double")
    assert [r.path_id for r in paths.valid_paths(df, ["a", "b"]).collect()] == [2]


def losses(spark, ref, cand, conditions=False):
    data = [(i, i if conditions else None, "t", REFERENCE, float(x)) for i, x in enumerate(ref)] + [(1000 + i, c, "t", "c", float(x)) for i, (c, x) in enumerate(cand)]
    return spark.createDataFrame(data, "path_id bigint, condition_id bigint, target string, side string, loss double")


def test_risk_identity(spark):
    x = np.linspace(-0.2, 0.4, 1000)
    for r in risk.unconditional_report(losses(spark, x, [(None, v) for v in x])).collect():
        q = np.quantile(x, r.level)
        assert r.var_error == 0 and r.es_error == 0 and r.coverage_error <= 0.001
        assert r.candidate_var == pytest.approx(q) and r.candidate_es == pytest.approx(x[x >= q].mean())


def test_portfolio_loss(spark):
    x = np.log([[1.10, 0.90]])
    got = {r.target: r.loss for r in risk.portfolio_losses(frame(spark, {"s": [x]}), ASSETS, {"A": 0.6, "B": 0.4}, ["side"]).collect()}
    assert got["portfolio"] == pytest.approx(-0.02) and got["A"] == pytest.approx(-0.10)
    with pytest.raises(ValueError):
        risk.portfolio_losses(frame(spark, {"s": [x]}), ASSETS, {"A": 0.6, "B": 0.6}, ["side"])


def test_conditional_risk(spark):
    real = [0.05, 0.15, 0.25, 0.35]
    draws = [(c, real[c] + d) for c in range(4) for d in np.linspace(-0.1, 0.1, 200)]
    got = {r.level: r for r in risk.conditional_report(losses(spark, real, draws, True)).collect()}
    assert got[0.95].exceptions == 0 and got[0.95].mean_forecast_var == pytest.approx(0.29, abs=0.005) and got[0.95].observations == 4


def test_percentiles_and_ks(spark):
    ref, cand = [0.1, 0.2, 0.2, 0.9], [0.0, 0.1, 0.2, 0.2, 0.5]
    df = losses(spark, ref, [(None, v) for v in cand])
    got = sorted(r.percentile for r in risk.percentile_points(df).collect())
    assert got == pytest.approx(sorted(sum(c <= v for c in cand) / 5 for v in ref))
    n = len(got)
    want = max(max((i + 1) / n - x, x - i / n) for i, x in enumerate(got))
    assert risk.percentile_report(df).first().ks == pytest.approx(want)


def test_es_stability_resamples_a_thousand_losses_at_every_level(spark):
    x = np.random.default_rng(8).normal(size=4000)
    df = spark.createDataFrame([(i, "x", "BTC", float(v)) for i, v in enumerate(x)], "path_id bigint, side string, target string, loss double")
    got = {r.level: r for r in risk.es_stability(df).collect()}
    assert set(got) == {0.95, 0.99}
    rng = np.random.default_rng(9)
    for level, r in got.items():
        picks = [rng.choice(x, 1000) for _ in range(400)]
        es = np.array([p[p >= np.quantile(p, level)].mean() for p in picks])
        assert r.es_mean == pytest.approx(es.mean(), rel=0.03) and r.es_deviation == pytest.approx(es.std(ddof=1), rel=0.35)


def test_es_stability_is_small_for_constant_losses(spark):
    r = [x for x in risk.es_stability(losses(spark, [0.5] * 30, [(None, 0.1), (None, 0.3)])).collect() if x.side == REFERENCE][0]
    assert r.es_mean == pytest.approx(0.5) and r.es_deviation == pytest.approx(0)


def test_ranks(spark):
    rng = np.random.default_rng(1)
    data = [(g, i, float(x)) for g in ("p", "q") for i, x in enumerate(rng.integers(-3, 3, 60) / 4)]
    df = spark.createDataFrame(data, "g string, i bigint, x double")
    got = {(r.g, r.i): r.rank for r in ranks.ranked(df, ["g"], "x", ["i"]).collect()}
    for g in ("p", "q"):
        order = sorted((x, i) for h, i, x in data if h == g)
        assert all(got[g, i] == n for n, (_, i) in enumerate(order))
    avg = ranks.average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double").withColumn("g", F.lit(1)), ["g"], "x")
    assert sorted(r.average_rank for r in avg.collect()) == [1.0, 2.5, 2.5, 4.0]


def vectors(spark, x, side="s", start=0):
    return spark.createDataFrame([(start + i, side, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, side string, vector array<double>")


@pytest.mark.parametrize("rows_at_once", [7, 2048])
@pytest.mark.parametrize("query_bytes", [400, 32 << 20])
def test_nearest_brute_force(spark, monkeypatch, rows_at_once, query_bytes):
    monkeypatch.setattr(diversity, "ROWS_AT_ONCE", rows_at_once)
    monkeypatch.setattr(diversity, "QUERY_BYTES", query_bytes)
    x = np.random.default_rng(2).normal(size=(60, 5))
    df = vectors(spark, x)
    got = {}
    for r in diversity.nearest(df.where("id % 20 = 0"), df, k=3, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbour_id))
    for q in (0, 20, 40):
        want = sorted((math.sqrt(((x[q] - x[j]) ** 2).mean()), j) for j in range(60) if j != q)[:3]
        assert [j for _, j in sorted(got[q])] == [j for _, j in want] and [d for d, _ in sorted(got[q])] == pytest.approx([d for d, _ in want])
    assert diversity.nearest(df.limit(0), df).count() == 0


def test_projected_search_recalls(spark):
    x = np.random.default_rng(4).normal(size=(400, 64))
    df = vectors(spark, x)
    asked = df.where("id % 20 = 0")
    exact = {r.query_id: r.neighbour_id for r in diversity.nearest(asked, df, exclude_self=True).collect()}
    near = {r.query_id: r.neighbour_id for r in diversity.nearest(asked, df, exclude_self=True, project=24, keep=64).collect()}
    assert sum(exact[q] == near[q] for q in exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("k", [1, 3])
def test_projected_search_is_exact_on_full_chunks(spark, k):
    x = np.random.default_rng(4).normal(size=(3000, 64))
    df = vectors(spark, x).coalesce(1)  # a full chunk of a single task, and part of another
    asked = df.where("id % 20 = 0")
    exact = sorted(map(tuple, diversity.nearest(asked, df, k=k, exclude_self=True).collect()))
    near = sorted(map(tuple, diversity.nearest(asked, df, k=k, exclude_self=True, project=24, keep=64).collect()))
    assert [r[:2] for r in near] == [r[:2] for r in exact] and [r[2] for r in near] == pytest.approx([r[2] for r in exact])


def test_unique_and_exact(spark):
    x = [[1.0, 2.0], [1.0, 2.0 + 1e-14], [-0.0, 1.0], [0.0, 1.0]]
    r = diversity.unique_fraction(vectors(spark, x), ["side"]).first()
    assert (r.n, r.distinct_n, r.unique_fraction) == (4, 2, 0.5)
    m = diversity.exact_matches(vectors(spark, x), vectors(spark, x[:1]), ["side"]).first()
    assert m.matches == 2


def test_discriminator_and_regimes(spark):
    x = noise(80, 20)
    df = frame(spark, {REFERENCE: x, "same": noise(80, 20, 9), "moved": x + 0.10})
    features = paths.path_features(df, ASSETS, keep=["side"])
    columns = [c for c in features.columns if c not in ("path_id", "side")]
    got = {r.candidate: r for r in diversity.discriminator(features, columns, ["same", "moved"]).collect()}
    assert got["moved"].accuracy_mean > 0.95 and got["same"].accuracy_mean < 0.65 and len(columns) == 21
    reg = {r.candidate: r for r in evaluator.regimes(paths.by_asset(df, ASSETS, ["path_id", "step_no", "side"])).collect()}
    assert reg["moved"].total_variation_distance == pytest.approx(0) and reg["same"].candidate_paths == 80


def test_block_bootstrap(spark):
    data = [(1, i, float(i), float(-i), i not in (0, 5)) for i in range(12)]
    df = spark.createDataFrame(data, "e bigint, tick_no bigint, a double, b double, returns_valid boolean")
    starts = sorted((r.tick_no, r.block_no) for r in generators.block_starts(df, "e", 3).collect())
    assert starts == [(1, 0), (2, 1), (6, 2), (7, 3), (8, 4), (9, 5)]
    out = generators.block_bootstrap(df, "e", ["a", "b"], 3, 7, 8)
    assert out.count() == 7 * 8 and out.where("a <> -b").count() == 0
    again = generators.block_bootstrap(df.repartition(5), "e", ["a", "b"], 3, 7, 8)
    assert out.exceptAll(again).count() == 0


def test_draws_for_every_condition_side_and_target(spark):
    from tidewright.plans import scenarios as S

    pool = [(side, target, c, 100 * c + i) for side in ("x", "y") for target in ("BTC", "portfolio") for c in range(30) for i in range(1 + c % 4)]
    got = S.condition_draws(spark.createDataFrame(pool, "side string, target string, condition_id bigint, path_id bigint"), 50).toPandas()
    sizes = got.groupby(["side", "target", "condition_id"]).draw_no.nunique()
    assert len(sizes) == 120 and (sizes == 50).all() and len(got) == 6000
    assert (got.path_id // 100 == got.condition_id).all() and set(got.path_id) == {p for *_, p in pool}


def test_nested_subsets(spark):
    pool = spark.createDataFrame([(1, i) for i in range(10)], "g bigint, i bigint")
    got = generators.nested_subsets(pool, ["g"], "i", (0.25, 0.5, 1.0))
    sets = {s: {r.i for r in got.where(F.col("subset") == s).collect()} for s in ("025pct", "050pct", "100pct")}
    assert [len(sets[s]) for s in sorted(sets)] == [2, 5, 10] and sets["025pct"] < sets["050pct"] < sets["100pct"]
    with pytest.raises(ValueError):
        generators.nested_subsets(pool, ["g"], "i", (0.0,))


def test_flow_inverts_trains_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(0)
    cond = rng.normal(size=(600, 2))
    x = np.hstack([cond[:, :1] * 2 + rng.normal(size=(600, 4)) * 0.3, rng.normal(size=(600, 4))])
    flow = generators.CouplingFlow(dim=8, condition_dim=2, couplings=4, hidden=16)
    z, _ = flow.forward(x, cond)
    assert np.abs(flow.inverse(z, cond) - x).max() < 1e-8
    before = flow.log_prob(x, cond).mean()
    flow.fit(x, cond, epochs=25, rate=5e-3)
    assert flow.log_prob(x, cond).mean() > before + 0.5
    z, logdet = flow.forward(x[:1], cond[:1])
    jac = np.array([(flow.forward(x[:1] + 1e-6 * e, cond[:1])[0] - z)[0] / 1e-6 for e in np.eye(8)])
    assert np.log(abs(np.linalg.det(jac))) == pytest.approx(logdet[0], abs=1e-3)
    flow.save(str(tmp_path / "flow.npz"))
    loaded = generators.CouplingFlow.load(str(tmp_path / "flow.npz"))
    assert np.allclose(loaded.log_prob(x, cond), flow.log_prob(x, cond))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], [float(v) for v in cond[i]]) for i in range(20)], "k bigint, x array<double>, c array<double>")
    scores = {r.k: r.log_prob for r in flow.score(df, "k", "x", "c").collect()}
    assert scores[3] == pytest.approx(flow.log_prob(x[3:4], cond[3:4])[0])
    one = sorted(map(str, flow.sample(df, "k", 3, "c").collect()))
    assert len(one) == 60 and one == sorted(map(str, flow.sample(df.repartition(3), "k", 3, "c").collect()))


def test_flow_queries_cover_whole_paths(spark):
    from tidewright.plans import scenarios as S

    sf = "/root/testdata/sf0.001"
    flow, rows = S._flow(spark, sf)
    data = rows.toPandas()
    x, c = np.vstack(data["x"].to_numpy()), np.vstack(data["c"].to_numpy())
    assert x.shape[1] == 48 and len(data) == S._vectors(spark, sf).count() and 0 < c[:, 0].mean() < 1
    for at in (23, 24, 47):  # the last step of BTC, the first and last of ETH
        moved = x.copy()
        moved[:, at] += 10
        assert (np.abs(flow.log_prob(moved, c) - flow.log_prob(x, c)) > 1).all()
    assert all(len(r.vector) == 48 for r in S.flow_sample(spark, sf).collect())


def test_flow_gradient():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(12, 4)), rng.normal(size=(12, 1))
    flow = generators.CouplingFlow(dim=4, condition_dim=1, couplings=2, hidden=5)
    for w in flow.weights:
        w["w2"] = rng.normal(size=w["w2"].shape) * 0.3
    loss, grads = flow._gradients(x, c)
    assert loss == pytest.approx(-flow.log_prob(x, c).mean())
    for i, w in enumerate(flow.weights):
        for k in w:
            at = tuple(0 for _ in w[k].shape)
            w[k][at] += 1e-6
            up = -flow.log_prob(x, c).mean()
            w[k][at] -= 1e-6
            assert grads[i][k][at] == pytest.approx((up - loss) / 1e-6, abs=1e-4)


def test_student_t(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), *[F.lit(v).alias(n) for n, v in (("m0", 1.0), ("m1", -1.0), ("s0", 0.0), ("s1", 0.0), ("c", 5.0))])
    got = generators.student_t_pairs(df).toPandas()
    assert got.x.median() == pytest.approx(1.0, abs=0.1) and got.y.median() == pytest.approx(-1.0, abs=0.1) and got.x.corr(got.y) > 0.9
    again = generators.student_t_pairs(df.repartition(3)).toPandas()
    assert got.sort_values("row_id").x.tolist() == again.sort_values("row_id").x.tolist()


def test_student_t_query_draws_every_step(spark):
    from tidewright.plans import evaluator as PE
    from tidewright.plans import scenarios as S

    sf = "/root/testdata/sf0.001"
    got = S.student_t_sampler(spark, sf).toPandas()
    steps = {(r.path_id, r.step_no) for r in PE.paths(spark, sf).collect()}
    assert set(zip(got.path_id, got.step_no)) == steps and len(got) == len(steps) and got.step_no.max() == 23


def test_quantiles_by_passes_equal_the_aggregate(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(x)) for g in ("u", "v") for x in np.random.default_rng(7).normal(size=101)], "g string, x double")
    plain = sorted(map(tuple, stats.grouped_quantiles(df, ["g"], "x", [0.1, 0.5]).collect()))
    grid = {r.g: r.grid for r in stats.grouped_grid(df, ["g"], "x", 11).collect()}
    monkeypatch.setattr(stats, "LARGE_BYTES", 0)
    for a, b in zip(plain, sorted(map(tuple, stats.grouped_quantiles(df, ["g"], "x", [0.1, 0.5]).collect()))):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    for r in stats.grouped_grid(df, ["g"], "x", 11).collect():
        assert r.grid == pytest.approx(grid[r.g])


def test_regression_scores(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=50)
    p = y + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(y, p)] + [("flat", 1.0, 2.0)] * 3, "g string, y double, p double")
    got = {r.g: r for r in downstream.regression_scores(df, ["g"]).collect()}
    e = abs(p - y)
    r = got["g"]
    assert r.mae == pytest.approx(e.mean()) and r.rmse == pytest.approx(math.sqrt((e**2).mean())) and r.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert r.correlation == pytest.approx(np.corrcoef(y, p)[0, 1]) and r.mae_worst_10 == pytest.approx(e[y >= np.quantile(y, 0.9)].mean())
    assert got["flat"].r2 == 0.0 and got["flat"].correlation == 0.0 and got["flat"].mae == 1.0


def test_augmentation_comparison(spark):
    rng = np.random.default_rng(4)
    data = [(i, i % 4 == 0, float(a), float(b), float(2 * a - b + 1)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    rows = spark.createDataFrame(data, "path_id bigint, held_out boolean, a double, b double, label double")
    sets = spark.createDataFrame([(i, d) for i in range(200) for d in ("000pct", "100pct") if d == "100pct" or i < 100], "path_id bigint, dataset string")
    got = {r.dataset: r for r in downstream.augmentation_comparison(rows, sets, ["a", "b"], "label").collect()}
    assert set(got) == {"000pct", "100pct"} and all(r.n == 50 and r.r2 > 0.999 for r in got.values())


def test_tuning_prefers_a_flow_that_can_learn(spark):
    rng = np.random.default_rng(5)
    cond = rng.normal(size=(300, 1))
    x = np.hstack([cond * 3, cond * 3]) + rng.normal(size=(300, 2)) * 0.2
    rows = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, cond))], "k bigint, x array<double>, c array<double>")
    trials = downstream.tune_flow(rows, "k", "x", "c", 2, 1, [{"couplings": 1, "hidden": 1}, {"couplings": 4, "hidden": 16}], rounds=6, passes=10).collect()
    nll = {r.trial: r.nll for r in trials}
    assert set(nll) == {0, 1} and nll[1] < nll[0]


def test_averaged_training_over_workers(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cond = rng.normal(size=(4000, 1))
    x = np.hstack([cond * 2, cond]) + rng.normal(size=(4000, 2)) * 0.3
    rows = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, cond))], "k bigint, x array<double>, c array<double>")
    monkeypatch.setattr(generators, "ROWS_A_WORKER", 800)
    made = []
    for shape, reducers in ((rows, 16), (rows.repartition(7), 16), (rows, 2)):  # the last one has fewer than the five workers
        monkeypatch.setattr(generators, "REDUCERS", reducers)
        flow = generators.CouplingFlow(dim=2, condition_dim=1, couplings=2, hidden=16)
        before = -flow.log_prob(x, cond).mean()
        generators.fit_flows([flow], [5e-3], shape, "k", "x", "c", rounds=12, passes=1)
        made.append(-flow.log_prob(x, cond).mean())
        assert made[-1] < before - 0.1 and made[-1] < 0.97 * before
    assert max(made) - min(made) < 0.1


def test_wasserstein_of_unequal_samples(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=37), rng.normal(1, 2, size=90)
    frame = lambda xs: spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(xs)] + [("g", -1, math.nan), ("g", -2, None)], "g string, i int, x double")
    q = np.linspace(0, 1, 90)
    got = ranks.sorted_wasserstein(frame(a), frame(b), ["g"], "x", ["i"]).collect()
    assert [(r.g, r.wasserstein_1) for r in got] == [("g", pytest.approx(np.abs(np.quantile(a, q) - np.quantile(b, q)).mean()))]
    same = ranks.sorted_wasserstein(frame(a), frame(b[:37]), ["g"], "x", ["i"]).first()
    assert same.wasserstein_1 == pytest.approx(np.abs(np.sort(a) - np.sort(b[:37])).mean())
    one = ranks.sorted_wasserstein(frame(a[:1]), frame(b[:1]), ["g"], "x", ["i"]).first()
    assert one.wasserstein_1 == pytest.approx(abs(a[0] - b[0]))


def sent_to_all(df):
    """The parts of the plan that ran whose rows went to the driver and to all tasks."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    ends = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in range(len(lines))]
    return ["\n".join(lines[i : ends[i]]) for i, x in enumerate(lines) if "BroadcastExchange" in x]


def test_wasserstein_sends_no_levels_to_all_tasks(spark):
    frame = lambda n, by: spark.range(n).selectExpr("id % 2 g", f"cast(id * {by} as double) x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # samples are larger, as they seem to Spark
    try:
        for n, m in ((3000, 3000), (40, 3000), (3000, 40)):
            got = ranks.sorted_wasserstein(frame(n, 1), frame(m, 2), ["g"], "x", [])
            assert got.count() == 2 and not [x for x in sent_to_all(got) if "Generate" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wasserstein_sorted_sends_no_levels_to_all_tasks(spark):
    from tidewright.plans import scenarios

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        got = scenarios.wasserstein_sorted(spark, "/root/testdata/sf0.001")
        assert got.count() > 0 and not [x for x in sent_to_all(got) if "Generate" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wasserstein_in_slices(spark, monkeypatch):
    from tidewright import session

    rng = np.random.default_rng(4)
    sizes = {"few": (1, 90), "many": (90, 1), "two": (2, 57), "odd": (31, 70), "even": (64, 64), "one": (1, 1), None: (5, 8)}
    draws = lambda n: np.round(rng.normal(size=n), 1)  # noqa: E731  # ties within and across
    data = {g: (draws(n), draws(m)) for g, (n, m) in sizes.items()}
    frame = lambda k, more: spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v[k]] + [(more, 1.0), ("empty", math.nan if k else 1.0)], "g string, x double")
    want = {}
    for g, (a, b) in data.items():
        q = np.linspace(0, 1, max(len(a), len(b)))
        want[g] = pytest.approx(np.abs(np.quantile(a, q) - np.quantile(b, q)).mean())
    for size, most in ((1, 100_000), (8, 100_000), (16_384, 0)):  # the last one's groups are too many to be sent to all tasks
        monkeypatch.setattr(ranks, "_SLICE", size)
        monkeypatch.setattr(session, "FEW_ROWS", most)
        got = ranks.sorted_wasserstein(frame(0, "left"), frame(1, "right"), ["g"], "x", []).collect()
        assert len(got) == len(want) and {r.g: r.wasserstein_1 for r in got} == want


def test_quantiles_leave_out_nan_either_way(spark, monkeypatch):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, math.nan, math.nan, None)] + [("b", math.nan)], "g string, x double")
    small = sorted(map(tuple, stats.grouped_quantiles(df, ["g"], "x", (0.5, 0.95)).collect()))
    grid = stats.grouped_grid(df, ["g"], "x", 5).collect()
    monkeypatch.setattr(stats, "LARGE_BYTES", 0)
    assert small == sorted(map(tuple, stats.grouped_quantiles(df, ["g"], "x", (0.5, 0.95)).collect())) == [("a", 2.0, pytest.approx(2.9)), ("b", None, None)]
    assert [(r.g, r.grid) for r in grid] == [(r.g, r.grid) for r in stats.grouped_grid(df, ["g"], "x", 5).collect()] == [("a", [1.0, 1.5, 2.0, 2.5, 3.0])]


def test_separation_of_splits(spark):
    rows = [(1, "train", 0, 10), (1, "train", 5, 20), (1, "purge_train_validation", 15, 30), (1, "validation", 25, 40), (1, "test", 40, 60), (2, "train", 0, 9), (2, "test", 9, 12)]
    df = spark.createDataFrame(rows, "e int, split string, condition_start_ms bigint, target_end_ms bigint")
    got = sorted(map(tuple, windows.split_separation(df, "e").collect()))
    assert got == [(1, "train", "validation", 5, True), (1, "validation", "test", 0, False), (2, "train", "test", 0, False)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidewright.session import ensure_checkpoint_dir

    made = []
    conf = SimpleNamespace(get=lambda k, d: d)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=made.append))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session("spark://host:7077"))
    ensure_checkpoint_dir(session("local[4]"))
    assert len(made) == 1


def test_numbers_by_counter():
    keys = np.column_stack([np.arange(20_000), np.full(20_000, 3)])
    u = generators.uniforms(keys, 4, 7)
    assert (u > 0).all() and (u < 1).all() and len(np.unique(u)) == u.size and (u[5:9] == generators.uniforms(keys[5:9], 4, 7)).all()
    assert abs(u.mean(axis=0) - 0.5).max() < 0.01 and abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.03
    z = generators.normals(u[:, :2])
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    c = generators.chi_square(u[:, 2], 5.0)
    assert c.mean() == pytest.approx(5, rel=0.02) and c.var() == pytest.approx(10, rel=0.05) and np.quantile(c, 0.95) == pytest.approx(11.0705, rel=0.02)
