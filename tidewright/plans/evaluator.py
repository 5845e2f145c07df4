"""Queries of the path evaluator over path_returns and path_losses, and their SQL.

The historical paths are the reference, each other generator a candidate. Paths with a missing return are left out whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import evaluator as E
from tidewright.operators import paths as P
from tidewright.sources.tables import table

ASSETS = {"BTC": "btc_log_return", "ETH": "eth_log_return"}
LAGS, VOL_WINDOW, CORR_WINDOW, K = 20, 20, 20, 4


def _rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.valid_paths(table(spark, sf, "path_returns"), list(ASSETS.values()))
    side = F.when(F.col("batch") == "reference", F.lit(E.REFERENCE)).otherwise(F.col("generator"))
    return rows.select("path_id", "step_no", side.alias("side"), *ASSETS.values())


def long(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_asset(paths(spark, sf), ASSETS, ["path_id", "step_no", "side"])


def marginal_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.marginal_report(long(spark, sf)))


def wasserstein_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of each generator against the historical ones, by quantile grids."""
    rows = losses(spark, sf).select("side", "target", "loss")
    return _rounded(E.wasserstein(rows, ["target"], "loss"))


def path_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(P.path_metrics(long(spark, sf), E.PATH, keep=["side"]))


def trajectory_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.trajectory_report(P.path_metrics(long(spark, sf), E.PATH, keep=["side"])))


def pooled_acf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.acf(long(spark, sf), LAGS))


def rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    out = P.rolling_sd(long(spark, sf), E.PATH, VOL_WINDOW)
    return _rounded(out.select("path_id", "asset", "step_no", "volatility"), 9)


def vol_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.volatility_runs(long(spark, sf), VOL_WINDOW, 0.9))


def extreme_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.extreme_clustering(long(spark, sf), K, 0.99))


def temporal_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.temporal_report(long(spark, sf), LAGS, VOL_WINDOW, 0.9, 0.99, K))


def rolling_correlation(spark: SparkSession, sf: str) -> DataFrame:
    out = P.rolling_correlation(paths(spark, sf), ["path_id"], CORR_WINDOW, *ASSETS.values())
    return _rounded(out.select("path_id", "step_no", "correlation"), 6)


def stress_calm_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths(spark, sf)
    return _rounded(E.rolling_correlation_summary(E.stress_flags(rows, ASSETS, CORR_WINDOW, 0.9), rows), 6)


def tail_dependence(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.joint_drops(paths(spark, sf), ASSETS, 0.05, 0.05))


def cross_asset_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.cross_asset_report(paths(spark, sf), ASSETS, CORR_WINDOW), 6)


def regime_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.regimes(long(spark, sf)))


def volatility_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.volatility_quartiles(long(spark, sf)))


def path_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(P.path_features(paths(spark, sf), ASSETS, keep=["side"]))


def losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "path_losses").where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    side = F.when(F.col("batch") == "reference", F.lit(E.REFERENCE)).otherwise(F.col("generator"))
    return rows.select("path_id", "condition_id", "target", side.alias("side"), "loss", "maximum_drawdown")


def describe_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of final portfolio returns of each side beside the reference, with differences."""
    weights = {"BTC": 0.6, "ETH": 0.4}
    final = paths(spark, sf).groupBy("side", "path_id").agg(*[F.exp(F.sum(c)).alias(a) for a, c in ASSETS.items()])
    final = final.select("side", (F.col("BTC") * weights["BTC"] + F.col("ETH") * weights["ETH"] - 1).alias("x"))
    summary = final.groupBy("side").agg(F.count("x").alias("paths"), *stats.summary(F.col("x")), stats.skew(F.col("x")).alias("skewness"), stats.excess_kurtosis(F.col("x")).alias("excess_kurtosis"))
    report = E.against_reference(summary, [])
    return _rounded(report.withColumns(E.errors(report, ["mean", "standard_deviation", "skewness", "excess_kurtosis", "q01", "q05", "q50", "q95", "q99"])))


QUERIES = {
    f.__name__: f
    for f in (
        marginal_report,
        wasserstein_grid,
        path_metrics,
        trajectory_report,
        pooled_acf,
        rolling_volatility,
        vol_runs,
        extreme_clustering,
        temporal_report,
        rolling_correlation,
        stress_calm_correlation,
        tail_dependence,
        cross_asset_report,
        regime_proportions,
        volatility_quartiles,
        path_features,
        describe_compare,
    )
}

# SQL

PATHS_SQL = """
with fine as (select path_id from path_returns group by 1 having count(*) = count(btc_log_return) and count(*) = count(eth_log_return)),
p as (select path_id, step_no, case when batch = 'reference' then 'reference' else generator end side, btc_log_return, eth_log_return from path_returns where path_id in (select path_id from fine)),
l as (select path_id, step_no, side, 'BTC' asset, btc_log_return x from p union all select path_id, step_no, side, 'ETH', eth_log_return from p)
"""
LOSSES_SQL = "with lo as (select path_id, condition_id, target, case when batch = 'reference' then 'reference' else generator end side, loss, maximum_drawdown from path_losses where loss is not null)"
_GRID = "[" + ", ".join(f"{i}/1000.0::double" for i in range(1001)) + "]"
_W1 = "list_sum(list_transform(list_zip(c.grid, r.grid), lambda z: abs(z[1] - z[2]))) / 1001"
_QS = [(q, stats.quantile_name(q)) for q in stats.QUANTILES]


def _q(x: str, quantiles=_QS, prefix: str = "") -> str:
    return ", ".join(f"quantile_cont({x}, {q}) {prefix}{n}" for q, n in quantiles)


def _moments(x: str, m: str, s: str) -> str:
    return f"case when max({s}) > 0 then avg(power(({x} - {m}) / nullif({s}, 0), 3)) else 0 end skewness, case when max({s}) > 0 then avg(power(({x} - {m}) / nullif({s}, 0), 4)) - 3 else 0 end excess_kurtosis"


def _sides(on: list[str], values: list[str], extra: str = "", digits: int = 7, source: str = "s") -> str:
    """Candidates of a summary beside the reference, rounded."""
    cols = ", ".join(f"round(c.{v}, {digits}) + 0.0 candidate_{v}, round(r.{v}, {digits}) + 0.0 reference_{v}" for v in values)
    join = " and ".join(["c.side <> 'reference'", "r.side = 'reference'", *[f"c.{k} = r.{k}" for k in on]])
    return f"select c.side candidate{''.join(f', c.{k}' for k in on)}, {cols}{extra} from {source} c join {source} r on {join}"


def _err(names: list[str], digits: int = 7) -> str:
    return "".join(f", round(abs(c.{n} - r.{n}), {digits}) + 0.0 {n}_error" for n in names)


_METRICS_SQL = """, w as (select *, exp(sum(x) over o) wealth, row_number() over o no from l window o as (partition by path_id, asset order by step_no)),
d as (select *, 1 - wealth / greatest(1.0, max(wealth) over o) dd from w window o as (partition by path_id, asset order by no)),
e as (select *, coalesce(max(case when dd <= 1e-12 then no end) over (partition by path_id, asset order by no), 0) dry from d),
m as (
  select path_id, asset, side, exp(sum(x)) - 1 final_cumulative_return, coalesce(stddev_samp(x), 0) * sqrt(1460.0) realized_volatility, max(dd) maximum_drawdown,
    cast(max(case when dd > 1e-12 then no - dry else 0 end) as double) maximum_drawdown_duration_steps, max(wealth) - 1 intrahorizon_maximum_return, min(wealth) - 1 intrahorizon_minimum_return,
    cast(arg_min(no, (wealth, no)) as double) time_to_minimum_value_steps
  from e group by 1, 2, 3)
"""
_ACF_SQL = f""", t as (select *, 'return' series, x y from l union all select *, 'absolute', abs(x) from l union all select *, 'squared', x * x from l),
c0 as (select *, y - avg(y) over (partition by side, asset, series) d from t),
pr as (select a.side, a.asset, a.series, b.step_no - a.step_no lag, a.d u, b.d v from c0 a join c0 b on a.path_id = b.path_id and a.asset = b.asset and a.series = b.series and b.step_no - a.step_no between 1 and {LAGS}),
acf as (select side, asset, series, lag, case when sum(u * u) * sum(v * v) > 0 then sum(u * v) / sqrt(sum(u * u) * sum(v * v)) else 0 end acf from pr group by 1, 2, 3, 4)
"""
_VOL_SQL = f""", vo as (
  select * from (select *, stddev_samp(x) over (o rows between {VOL_WINDOW - 1} preceding and current row) volatility, row_number() over o no from l window o as (partition by path_id, asset order by step_no)) where no >= {VOL_WINDOW})
"""
_RUNS_SQL = (
    _VOL_SQL
    + """, vt as (select asset, quantile_cont(volatility, 0.9) thr from vo where side = 'reference' group by 1),
vf as (select vo.*, volatility >= thr high, thr from vo join vt using (asset)),
vh as (select side, asset, any_value(thr) high_volatility_threshold, avg(high::int) high_volatility_frequency from vf group by 1, 2),
vr as (select side, asset, path_id, step_no - row_number() over (partition by path_id, asset order by step_no) run from vf where high),
vl as (select side, asset, path_id, run, count(*) n from vr group by 1, 2, 3, 4),
vs as (select side, asset, avg(n) a, quantile_cont(n, 0.95) b from vl group by 1, 2),
runs as (select vh.*, coalesce(a, 0)::double run_length_mean, coalesce(b, 0)::double run_length_p95 from vh left join vs using (side, asset))
"""
)
_EXTREME_SQL = f""", xt as (select asset, quantile_cont(abs(x), 0.99) thr from l where side = 'reference' group by 1),
xe as (select l.*, abs(x) >= thr e, thr from l join xt using (asset)),
xp as (select *, bool_or(e) over (o rows between {K} preceding and 1 preceding) prior, row_number() over o no from xe window o as (partition by path_id, asset order by step_no)),
ec as (select side, asset, any_value(thr) extreme_threshold, case when avg(e::int) > 0 then avg(e::int) filter (prior) / avg(e::int) end extreme_clustering from xp where no > {K} group by 1, 2)
"""
_STRESS_SQL = f""", f0 as (
  select *, stddev_samp(btc_log_return) over f vb, stddev_samp(eth_log_return) over f ve, covar_samp(btc_log_return, eth_log_return) over f cv, row_number() over (partition by path_id order by step_no) no
  from p window f as (partition by path_id order by step_no rows between {CORR_WINDOW - 1} preceding and current row)),
f1 as (select *, case when vb * ve <> 0 then cv / (vb * ve) end correlation from f0 where no >= {CORR_WINDOW}),
md as (select quantile_cont(vb, 0.5) mb, quantile_cont(ve, 0.5) me from f1 where side = 'reference'),
f2 as (select f1.*, (vb / case when mb = 0 then 1 else mb end + ve / case when me = 0 then 1 else me end) / 2 score from f1, md),
fl as (select *, score >= (select quantile_cont(score, 0.9) from f2 where side = 'reference') stressed from f2),
rc as (
  select side, avg(correlation) rolling_mean, case when count(correlation) > 0 then coalesce(stddev_samp(correlation), 0) end rolling_standard_deviation, {_q("correlation", [(0.05, "q05"), (0.5, "q50"), (0.95, "q95")], "rolling_")},
    count(correlation) / count(*) valid_fraction, avg(correlation) filter (not stressed) calm_correlation, avg(correlation) filter (stressed) stress_correlation, avg(stressed::int) stress_frequency
  from fl group by 1)
"""
_DROPS_SQL = """, rt as (select quantile_cont(btc_log_return, 0.05) tb, quantile_cont(eth_log_return, 0.05) te from p where side = 'reference'),
ot as (select side, quantile_cont(btc_log_return, 0.05) ob, quantile_cont(eth_log_return, 0.05) oe from p group by 1),
jd as (
  select side, any_value(tb) joint_drop_threshold_BTC, any_value(te) joint_drop_threshold_ETH,
    case when stddev_pop(btc_log_return) * stddev_pop(eth_log_return) <> 0 then covar_pop(btc_log_return, eth_log_return) / (stddev_pop(btc_log_return) * stddev_pop(eth_log_return)) end correlation,
    avg((btc_log_return <= tb and eth_log_return <= te)::int) joint_drop_probability, least(1.0, greatest(0.0, avg((btc_log_return <= ob and eth_log_return <= oe)::int) / 0.05)) lower_tail_dependence
  from p join ot using (side), rt group by 1)
"""
_LEVELS_SQL = """, sd as (select side, path_id, asset, coalesce(stddev_samp(x), 0) sd from l group by 1, 2, 3), md as (select asset, quantile_cont(sd, 0.5) m from sd where side = 'reference' group by 1),
lv as (select side, path_id, avg(sd / case when m = 0 then 1 else m end) v from sd join md using (asset) group by 1, 2)"""
_FEATURES_SQL = (
    _METRICS_SQL
    + """, ba as (select path_id, asset, avg(x) mean, stddev_pop(x) standard_deviation, avg(abs(x)) mean_absolute, quantile_cont(x, 0.05) q05, quantile_cont(x, 0.95) q95, count(*) n from l group by 1, 2),
fa as (select m.*, ba.* exclude (path_id, asset) from m join ba using (path_id, asset)),
co as (select path_id, case when stddev_pop(btc_log_return) * stddev_pop(eth_log_return) <> 0 then covar_pop(btc_log_return, eth_log_return) / (stddev_pop(btc_log_return) * stddev_pop(eth_log_return)) else 0 end correlation from p group by 1)
"""
)
_FEATURE = {
    "mean": "mean",
    "standard_deviation": "standard_deviation",
    "mean_absolute": "mean_absolute",
    "q05": "q05",
    "q95": "q95",
    "final_return": "final_cumulative_return",
    "maximum_drawdown": "maximum_drawdown",
    "drawdown_share": "maximum_drawdown_duration_steps / n",
    "maximum_return": "intrahorizon_maximum_return",
    "minimum_return": "intrahorizon_minimum_return",
}
_MARGINAL = ["mean", "standard_deviation", "skewness", "excess_kurtosis", "extreme_frequency", "mean_absolute_extreme", *[n for _, n in _QS]]
_TRAJECTORY = ["mean", "standard_deviation", *[n for _, n in _QS]]
_TEMPORAL = ["high_volatility_frequency", "run_length_mean", "run_length_p95", "extreme_clustering", "volatility_persistence"]
_CROSS = [
    *["correlation", "joint_drop_probability", "lower_tail_dependence", "rolling_mean", "rolling_standard_deviation", "rolling_q05", "rolling_q50", "rolling_q95"],
    *["valid_fraction", "calm_correlation", "stress_correlation", "stress_frequency"],
]
_CROSS_ERRORS = ["correlation", "joint_drop_probability", "lower_tail_dependence", "rolling_mean", "calm_correlation", "stress_correlation", "stress_frequency"]
_DESCRIBE = ["mean", "standard_deviation", *[n for _, n in _QS], "skewness", "excess_kurtosis"]
_r = lambda cols, d=7: ", ".join(f"round({c}, {d}) + 0.0 {c}" for c in cols)
_unpivot = " union all ".join(f"select side, asset, '{m}' metric, {m} x from m" for m in P.METRICS)

ORACLE = {
    "marginal_report": PATHS_SQL
    + f""", thr as (select asset, quantile_cont(abs(x), 0.99) thr from l where side = 'reference' group by 1),
z as (select l.*, thr, avg(x) over (partition by side, asset) mu, stddev_pop(x) over (partition by side, asset) sp from l join thr using (asset)),
s as (select side, asset, any_value(thr) extreme_threshold, avg(x) mean, coalesce(stddev_samp(x), 0) standard_deviation, {_moments("x", "mu", "sp")}, avg((abs(x) >= thr)::int) extreme_frequency,
  avg(abs(x)) filter (abs(x) >= thr) mean_absolute_extreme, {_q("x")}, quantile_cont(x, {_GRID}) grid from z group by 1, 2)
"""
    + _sides(["asset"], _MARGINAL, f", round(c.extreme_threshold, 7) extreme_threshold, round({_W1}, 7) wasserstein_1, case when r.standard_deviation > 0 then round({_W1} / r.standard_deviation, 7) end normalized_wasserstein_1"),
    "wasserstein_grid": LOSSES_SQL
    + f""", s as (select side, target, coalesce(stddev_samp(loss), 0) sd, quantile_cont(loss, {_GRID}) grid from lo group by 1, 2)
select c.side candidate, c.target, round({_W1}, 7) wasserstein_1, case when r.sd > 0 then round({_W1} / r.sd, 7) end normalized_wasserstein_1 from s c join s r on c.side <> 'reference' and r.side = 'reference' and c.target = r.target""",
    "path_metrics": PATHS_SQL + _METRICS_SQL + f"select path_id, asset, side, {_r(P.METRICS)} from m",
    "trajectory_report": PATHS_SQL
    + _METRICS_SQL
    + f""", u as ({_unpivot}), s as (select side, asset, metric, avg(x) mean, coalesce(stddev_samp(x), 0) standard_deviation, {_q("x")}, quantile_cont(x, {_GRID}) grid from u group by 1, 2, 3)
"""
    + _sides(["asset", "metric"], _TRAJECTORY, f", round({_W1}, 7) wasserstein_1, case when r.standard_deviation > 0 then round({_W1} / r.standard_deviation, 7) end normalized_wasserstein_1"),
    "pooled_acf": PATHS_SQL + _ACF_SQL + "select side, asset, series, cast(lag as bigint) lag, round(acf, 7) + 0.0 acf from acf",
    "rolling_volatility": PATHS_SQL + _VOL_SQL + "select path_id, asset, step_no, round(volatility, 9) + 0.0 volatility from vo",
    "vol_runs": PATHS_SQL + _RUNS_SQL + f"select side, asset, {_r(['high_volatility_threshold', 'high_volatility_frequency', 'run_length_mean', 'run_length_p95'])} from runs",
    "extreme_clustering": PATHS_SQL + _EXTREME_SQL + f"select side, asset, {_r(['extreme_threshold', 'extreme_clustering'])} from ec",
    "temporal_report": PATHS_SQL
    + _ACF_SQL
    + _RUNS_SQL
    + _EXTREME_SQL
    + """, pe as (select side, asset, sum(greatest(acf, 0)) volatility_persistence from acf where series = 'absolute' group by 1, 2),
s as (select * from runs join ec using (side, asset) join pe using (side, asset)),
g as (select c.side, c.asset, sqrt(avg(power(c.acf - r.acf, 2)) filter (c.series = 'return')) a, sqrt(avg(power(c.acf - r.acf, 2)) filter (c.series = 'absolute')) b, sqrt(avg(power(c.acf - r.acf, 2)) filter (c.series = 'squared')) d
  from acf c join acf r on r.side = 'reference' and c.asset = r.asset and c.series = r.series and c.lag = r.lag group by 1, 2)
"""
    + _sides(
        ["asset"],
        _TEMPORAL,
        _err(_TEMPORAL)
        + ", round(c.high_volatility_threshold, 7) high_volatility_threshold, round(c.extreme_threshold, 7) extreme_threshold, round(g.a, 7) return_acf_rmse, round(g.b, 7) absolute_acf_rmse, round(g.d, 7) squared_acf_rmse",
    )
    + " join g on g.side = c.side and g.asset = c.asset",
    "rolling_correlation": PATHS_SQL + _STRESS_SQL + "select path_id, step_no, round(correlation, 6) + 0.0 correlation from fl",
    "stress_calm_correlation": PATHS_SQL
    + _STRESS_SQL
    + f"select side, {_r(['rolling_mean', 'rolling_standard_deviation', 'rolling_q05', 'rolling_q50', 'rolling_q95', 'valid_fraction', 'calm_correlation', 'stress_correlation', 'stress_frequency'], 6)} from rc",
    "tail_dependence": PATHS_SQL
    + _DROPS_SQL
    + f"select side, {_r(['joint_drop_threshold_BTC', 'joint_drop_threshold_ETH', 'correlation', 'joint_drop_probability', 'lower_tail_dependence'])} from jd",
    "cross_asset_report": PATHS_SQL
    + _STRESS_SQL
    + _DROPS_SQL
    + f", s as (select * from jd join rc using (side)), gr as (select side, quantile_cont(correlation, {_GRID}) grid from fl where correlation is not null group by 1)\n"
    + _sides(
        [],
        _CROSS,
        _err(_CROSS_ERRORS, 6)
        + ", 'BTC-ETH' asset_pair, round(c.joint_drop_threshold_BTC, 6) joint_drop_threshold_BTC, round(c.joint_drop_threshold_ETH, 6) joint_drop_threshold_ETH"
        + f", (select round({_W1.replace('c.grid', 'ga.grid').replace('r.grid', 'gb.grid')}, 6) from gr ga, gr gb where ga.side = c.side and gb.side = 'reference') rolling_correlation_wasserstein_1",
        6,
    ),
    "volatility_quartiles": PATHS_SQL
    + _LEVELS_SQL
    + """, ct as (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.5) b, quantile_cont(v, 0.75) c from lv where side = 'reference')
select side, cast((v >= a)::int + (v >= b)::int + (v >= c)::int as bigint) bin, count(*) paths, round(avg(v), 7) + 0.0 mean_level from lv, ct group by 1, 2""",
    "regime_proportions": PATHS_SQL
    + _LEVELS_SQL
    + """, ct as (select quantile_cont(v, 1/3.0::double) a, quantile_cont(v, 2/3.0::double) b from lv where side = 'reference'),
s as (select side, count(*) paths, avg((v <= a)::int) low, avg((v > a and v <= b)::int) medium, avg((v > b)::int) high from lv, ct group by 1)
select c.side candidate, c.paths candidate_paths, r.paths reference_paths, """
    + ", ".join(f"round(c.{v}, 7) + 0.0 candidate_{v}, round(r.{v}, 7) + 0.0 reference_{v}" for v in ("low", "medium", "high"))
    + ", round((abs(c.low - r.low) + abs(c.medium - r.medium) + abs(c.high - r.high)) / 2, 7) + 0.0 total_variation_distance from s c join s r on c.side <> 'reference' and r.side = 'reference'",
    "path_features": PATHS_SQL
    + _FEATURES_SQL
    + f"select path_id, side, {', '.join(f'round(max({x}) filter (asset = {chr(39)}{a}{chr(39)}), 7) + 0.0 {a}_{n}' for a in ASSETS for n, x in _FEATURE.items())}, round(any_value(correlation), 7) + 0.0 correlation from fa join co using (path_id) group by 1, 2",
    "describe_compare": PATHS_SQL
    + f""", fi as (select side, path_id, exp(sum(btc_log_return)) * 0.6 + exp(sum(eth_log_return)) * 0.4 - 1 x from p group by 1, 2),
z as (select *, avg(x) over (partition by side) mu, stddev_pop(x) over (partition by side) sp from fi),
s as (select side, count(x) paths, avg(x) mean, coalesce(stddev_samp(x), 0) standard_deviation, {_q("x")}, {_moments("x", "mu", "sp")} from z group by 1)
"""
    + _sides([], _DESCRIBE, _err(_DESCRIBE) + ", c.paths candidate_paths, r.paths reference_paths"),
}
