"""Queries of the candle-to-window pipeline over the panel tables, and their SQL.

The two assets of every panel are read as candles: first copies of the delivered rows, without those marked missing and
without candles that break a price rule. Off-grid candles fit no tick of the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import to_us
from tidewright.operators import dedup, panel, windows
from tidewright.plans.problems import ARRIVAL, KLINE_ID, PANEL_ID, _klines
from tidewright.sources.tables import table

ASSETS = ("btc", "eth")
C, T = 24, 12
VOLUME_STEPS, CORRELATION_STEPS, PER_YEAR = 6, 12, 365.0 * 4
#: Cuts of the split as shares of a panel's windows; the purges between them are dropped parts of that share.
CUTS = (0.5, 0.6, 0.75, 0.85)
SPAN = ["target_start_ms"]
RETURNS = [f"{a}_log_return" for a in ASSETS]
FEATURES = [
    *[f"{a}_{n}" for a in ASSETS for n in ("cumulative_log_return", "realized_volatility_ann", "current_drawdown", "log_volume_z", "log_volume_change", "mean_log_range")],
    "correlation",
    "joint_trend_regime_score",
]
KLINE = {n: f"{n}_price" for n in panel.PRICES} | {"volume": "volume"}


def _rounded(df: DataFrame, columns, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def candles(spark: SparkSession, sf: str) -> DataFrame:
    once = dedup.keep_first(table(spark, sf, "btc_eth_6h_panel"), PANEL_ID, ARRIVAL)
    each = [
        F.struct(
            F.lit(a).alias("asset"),
            F.coalesce(F.col(f"{a}_missing"), F.lit(False)).alias("missing"),
            F.col(f"{a}_source_close_time_utc").alias("close_time_utc"),
            *[F.col(f"{a}_{v}").alias(v) for v in panel.VALUES],
        )
        for a in ASSETS
    ]
    rows = once.select("panel_id", "open_time_utc", F.explode(F.array(*each)).alias("x")).select("panel_id", "open_time_utc", "x.*")
    us = to_us(F.col("open_time_utc"))
    rules = panel.candle_violations(us, to_us(F.col("close_time_utc")), F.lit(panel.interval_us("6h")).cast("bigint"), *[F.col(v) for v in panel.VALUES])
    faulty = rules["non_positive_price"] | rules["negative_volume"] | rules["high_below"] | rules["low_above"]
    return rows.where(~F.col("missing") & ~faulty).drop("missing")


def panels(spark: SparkSession, sf: str) -> DataFrame:
    return panel.build_panel(candles(spark, sf), "panel_id", "asset", ASSETS, "open_time_utc", "close_time_utc")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return panel.log_returns(panels(spark, sf), "panel_id", ASSETS)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_index(windows.candidate_windows(returns(spark, sf), "panel_id", C, T), "panel_id", SPAN)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return windows.condition_features(returns(spark, sf), "panel_id", ASSETS, C, T, VOLUME_STEPS, CORRELATION_STEPS, PER_YEAR, SPAN)


def _split(index: DataFrame) -> DataFrame:
    """Cuts at shares of the span from a panel's first to its last target start."""
    lo, hi = (F.col(f"target_start_ms_{n}") for n in ("least", "most"))
    return windows.assign_split(index, [lo + F.floor((hi - lo) * F.lit(x)) for x in CUTS])


# queries


def candle_audit(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["feed_id", "instrument", "candle_interval"]
    return panel.candle_audit(_klines(spark, sf), keys, "open_time_utc", panel.interval_column_us(F.col("candle_interval")), KLINE)


def candle_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "klines")
    step = panel.interval_column_us(F.col("candle_interval"))
    rules = panel.candle_violations(to_us(F.col("open_time_utc")), to_us(F.col("close_time_utc")), step, *[F.col(KLINE[v]) for v in panel.VALUES])
    return rows.groupBy("candle_interval").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(n) for n, r in rules.items()])


def candle_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Daily candles from the first copies of the candles of each interval shorter than a day."""
    return _daily(_klines(spark, sf).where("candle_interval <> '1d'"), ["feed_id", "instrument", "candle_interval"])


def _daily(rows: DataFrame, keys: list[str]) -> DataFrame:
    once = dedup.keep_first(rows, KLINE_ID, ARRIVAL)
    order = F.struct(F.col("open_time_utc"), F.col("row_id"))
    daily = once.groupBy(*keys, F.date_format("open_time_utc", "yyyy-MM-dd").alias("day")).agg(
        F.min_by("open_price", order).alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", order).alias("close_price"),
        F.round(F.sum("volume"), 5).alias("volume"),
        F.count(F.lit(1)).alias("candles"),
    )
    return daily


def panel_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return panels(spark, sf).drop("tick_no", "calendar_ticks")


def panel_audit(spark: SparkSession, sf: str) -> DataFrame:
    return panel.panel_audit(panels(spark, sf), "panel_id", ASSETS)


def panel_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return panel.panel_gaps(panels(spark, sf), candles(spark, sf), "panel_id", "asset", ASSETS, "open_time_utc")


def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = returns(spark, sf).select("panel_id", "tick_ms", "tick_no", *RETURNS, "returns_valid", "invalid_reason")
    return _rounded(out, RETURNS, 10)


def return_audit(spark: SparkSession, sf: str) -> DataFrame:
    return panel.return_audit(returns(spark, sf), "panel_id")


def window_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).drop("target_start_ms_least", "target_start_ms_most")


def window_audit(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_audit(windows.candidate_windows(returns(spark, sf), "panel_id", C, T), "panel_id")


def window_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    return windows.non_overlapping(_index(spark, sf), T).select("panel_id", "sample_id", "start_index")


def window_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The target returns of every accepted window as arrays of a fixed length."""
    along = windows.frames("panel_id").rowsBetween(1, T)
    extra = {f"target_{a}": F.collect_list(F.round(f"{a}_log_return", 8)).over(along) for a in ASSETS}
    index = windows.window_index(windows.candidate_windows(returns(spark, sf), "panel_id", C, T, 1, extra), "panel_id")
    return index.select("panel_id", "sample_id", *extra)


def condition_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select("panel_id", "sample_id", *FEATURES), FEATURES, 7)


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(_index(spark, sf)).select("panel_id", "sample_id", "target_start_ms", "split")


def split_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(windows.split_audit(_split(_index(spark, sf)), "panel_id"), ["share"])


def split_separation(spark: SparkSession, sf: str) -> DataFrame:
    return windows.split_separation(_split(_index(spark, sf)), "panel_id")


def zscore_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised returns brought back to returns."""
    rows, fit = _fit(spark, sf)
    scaled = windows.zscore_apply(rows.where("returns_valid"), fit, ["panel_id"], ["tick_ms"], RETURNS).where("z is not null")
    out = windows.zscore_invert(scaled.select("panel_id", "tick_ms", "column", "z"), fit, ["panel_id"])
    return _rounded(out.select("panel_id", "tick_ms", "column", "value"), ["value"], 9)


def interval_union_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = returns(spark, sf)
    index = windows.window_index(windows.candidate_windows(rows, "panel_id", C, T), "panel_id", SPAN)
    return windows.covered_returns(rows, _split(index), "panel_id", C, T).select("panel_id", "tick_ms")


def _fit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = returns(spark, sf)
    index = windows.window_index(windows.candidate_windows(rows, "panel_id", C, T), "panel_id", SPAN)
    return rows, windows.zscore_fit(windows.covered_returns(rows, _split(index), "panel_id", C, T), ["panel_id"], RETURNS)


def zscore_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_fit(spark, sf)[1], ["mean", "scale"], 10)


def zscore_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows, fit = _fit(spark, sf)
    out = windows.zscore_apply(rows.where("returns_valid"), fit, ["panel_id"], ["tick_ms"], RETURNS)
    return _rounded(out.where("z is not null").select("panel_id", "tick_ms", "column", "z"), ["z"], 6)


def normalization_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of the standardised features of the training windows: 0 and 1, or 0 where there is no variance."""
    split = _split(_features(spark, sf))
    train = split.where("split = 'train'")
    fit = windows.zscore_fit(train, ["panel_id"], FEATURES)
    z = windows.zscore_apply(train, fit, ["panel_id"], ["sample_id"], FEATURES)
    out = z.groupBy("panel_id", "column").agg(F.count("z").alias("n"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd_z"))
    return _rounded(out.where("n > 1"), ["mean_z", "sd_z"], 5).withColumn("mean_z", F.abs("mean_z"))


def price_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Closes of each target window rebuilt from the last close of its condition; the greatest relative error is 0."""
    along = windows.frames("panel_id").rowsBetween(1, T)
    extra = {}
    for a in ASSETS:
        extra[f"{a}_start"] = F.col(f"{a}_close")
        extra[f"{a}_end"] = F.last(f"{a}_close").over(along)
        extra[f"{a}_sum"] = F.sum(f"{a}_log_return").over(along)
    index = windows.window_index(windows.candidate_windows(returns(spark, sf), "panel_id", C, T, 1, extra), "panel_id")
    rebuilt = {f"{a}_rebuilt": F.round(F.col(f"{a}_start") * F.exp(F.col(f"{a}_sum")), 5) for a in ASSETS}
    return index.withColumns(rebuilt).select("panel_id", "sample_id", "btc_rebuilt", "eth_rebuilt")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of successive valid returns: first tick and length."""
    valid = windows.numbered(returns(spark, sf).where("returns_valid"), "panel_id", "tick_no", "__no")
    runs = valid.withColumn("__run", F.col("tick_no") - F.col("__no"))
    return runs.groupBy("panel_id", "__run").agg(F.min("tick_ms").alias("first_tick_ms"), F.count(F.lit(1)).alias("length")).drop("__run")


#: Lags of the whole report of autocorrelations.
ACF_LAGS = 60


def segmented_acf(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelations of both assets' returns and absolute returns: pairs within segments only, one denominator for a whole series."""
    return segment_correlations(returns(spark, sf).where("returns_valid").select("panel_id", "tick_no", *RETURNS), ACF_LAGS)


def segment_correlations(valid: DataFrame, lags: int) -> DataFrame:
    """Per panel, asset, series ('return', 'absolute') and lag; ``valid`` has the valid returns by ``panel_id`` and ``tick_no``."""
    series = {(a, n): f"__x_{a}_{n}" for a in ASSETS for n in ("return", "absolute")}
    value = lambda a, n: F.col(f"{a}_log_return") if n == "return" else F.abs(f"{a}_log_return")
    rows = valid.select("panel_id", "tick_no", *[value(*k).alias(c) for k, c in series.items()])
    means = rows.groupBy("panel_id").agg(*[F.avg(c).alias(f"{c}_m") for c in series.values()])
    rows = rows.join(means, "panel_id").select("panel_id", "tick_no", *[(F.col(c) - F.col(f"{c}_m")).alias(c) for c in series.values()])
    along = windows.frames("panel_id").rowsBetween(-lags, 0)
    near = windows.sharded(rows, "panel_id", lags, 0).withColumn("__p", F.collect_list(F.struct("tick_no", *series.values())).over(along)).where(windows.at_home())
    pairs = near.select("panel_id", "tick_no", *series.values(), (F.size("__p") - 1).alias("__n"), F.posexplode("__p").alias("__i", "__e"))
    # k rows back is k ticks back exactly if no tick between is invalid, that is within the segment
    gap = F.col("tick_no") - F.col("__e.tick_no")
    pairs = pairs.withColumn("lag", gap.cast("bigint")).where((gap > 0) & (gap == F.col("__n") - F.col("__i")))
    sums = pairs.groupBy("panel_id", "lag").agg(*[F.sum(F.col(c) * F.col("__e").getField(c)).alias(c) for c in series.values()])
    whole = rows.groupBy("panel_id").agg(*[F.sum(F.col(c) * F.col(c)).alias(f"{c}_v") for c in series.values()])
    out = whole.withColumn("lag", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(lags).cast("bigint")))).join(sums, ["panel_id", "lag"], "left")
    acf = lambda c: F.when(F.col(f"{c}_v") > 0, F.coalesce(c, F.lit(0.0)) / F.col(f"{c}_v")).otherwise(F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(n).alias("series"), F.round(acf(c), 7).alias("acf")) for (a, n), c in series.items()])).alias("x")
    return out.select("panel_id", "lag", each).select("panel_id", "x.asset", "x.series", "lag", "x.acf")


def download_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Observed rows of each download against the rows that its requested range has room for."""
    rows = table(spark, sf, "kline_downloads")
    step = panel.interval_column_us(F.col("candle_interval"))
    room = F.call_function("div", to_us(F.col("requested_end_exclusive_utc")) - to_us(F.col("requested_start_utc")), step)
    return rows.select("download_id", "feed_id", room.alias("room"), (F.col("observed_rows") - F.coalesce("duplicate_open_times", F.lit(0))).alias("distinct_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        candle_audit,
        candle_rules,
        candle_resample,
        download_coverage,
        panel_calendar,
        panel_audit,
        panel_gaps,
        log_returns,
        return_audit,
        window_index,
        window_audit,
        window_nonoverlap,
        window_payload,
        condition_features,
        temporal_split,
        split_audit,
        split_separation,
        zscore_round_trip,
        interval_union_returns,
        zscore_fit,
        zscore_apply,
        normalization_audit,
        price_reconstruction,
        segments,
        segmented_acf,
    )
}

_STEP = 21_600_000_000
_K = """with k as (select *, upper(regexp_replace(symbol, '[^0-9A-Za-z]', '', 'g')) instrument, epoch_us(open_time_utc) us,
  case candle_interval when '1h' then 3600000000 when '4h' then 14400000000 when '6h' then 21600000000 when '1d' then 86400000000 end step from klines)
"""
_BAD_K = "(open_price is null or high_price is null or low_price is null or close_price is null or least(open_price, high_price, low_price, close_price) <= 0)"


def _candle_sql(a: str) -> str:
    p = {v: f"{a}_{v}" for v in panel.VALUES}
    return f"""select panel_id, '{a}' asset, epoch_us(open_time_utc) us, epoch_us({a}_source_close_time_utc) close_us, {", ".join(f"{c} as {n}" for n, c in p.items())} from once
  where not coalesce({a}_missing, false) and least({p["open"]}, {p["high"]}, {p["low"]}, {p["close"]}) > 0 and {p["open"]} is not null and {p["high"]} is not null and {p["low"]} is not null
    and {p["close"]} is not null and not coalesce({p["volume"]} < 0, false) and {p["high"]} >= greatest({p["open"]}, {p["close"]}, {p["low"]}) and {p["low"]} <= least({p["open"]}, {p["close"]}, {p["high"]})"""


CANDLES_SQL = f"""
with once as (select * from (select *, row_number() over (partition by panel_id, open_time_utc order by received_at_utc, row_id) rn from btc_eth_6h_panel) where rn = 1),
candles as ({_candle_sql("btc")} union all {_candle_sql("eth")}),
grid as (select * from candles where us % {_STEP} = 0),
cover as (
  select panel_id, greatest(min(us) filter (asset = 'btc'), min(us) filter (asset = 'eth')) lo, least(max(us) filter (asset = 'btc'), max(us) filter (asset = 'eth')) hi
  from grid group by panel_id having count(*) filter (asset = 'btc') > 0 and count(*) filter (asset = 'eth') > 0),
ticks as (select panel_id, unnest(range(lo, hi + 1, {_STEP})) us from cover where lo <= hi),
cal as (
  select t.panel_id, t.us // 1000 tick_ms, t.us // 1000 + 21599999 expected_close_ms, {", ".join(f"{a}.close_us // 1000 {a}_source_close_ms, " + ", ".join(f"{a}.{v} {a}_{v}" for v in panel.VALUES) + f", {a}.us is null {a}_missing, coalesce({a}.close_us = t.us + {_STEP - 1000}, false) {a}_duration_valid" for a in ASSETS)},
    btc.us is not null and eth.us is not null and coalesce(btc.close_us = t.us + {_STEP - 1000}, false) and coalesce(eth.close_us = t.us + {_STEP - 1000}, false) is_complete
  from ticks t left join grid btc on btc.panel_id = t.panel_id and btc.us = t.us and btc.asset = 'btc' left join grid eth on eth.panel_id = t.panel_id and eth.us = t.us and eth.asset = 'eth')
"""
RETURNS_SQL = (
    CANDLES_SQL
    + """, lagged as (
  select *, lag(is_complete) over w prev, lag(btc_close) over w pb, lag(eth_close) over w pe, row_number() over w - 1 tick_no from cal window w as (partition by panel_id order by tick_ms)),
rets as (
  select *, case when prev is null then 'first_observation' else concat_ws('|', case when not is_complete then 'current_incomplete' end, case when not prev then 'previous_incomplete' end) end invalid_reason from lagged),
ret as (
  select *, invalid_reason = '' returns_valid, case when invalid_reason = '' then ln(btc_close / pb) end btc_log_return, case when invalid_reason = '' then ln(eth_close / pe) end eth_log_return from rets)
"""
)
WINDOWS_SQL = (
    RETURNS_SQL
    + f""", cand as (
  select *, tick_no - {C - 1} start_index, count(*) over (partition by panel_id) ticks,
    sum(returns_valid::int) over (w rows between {C - 1} preceding and current row) = {C} condition_valid,
    coalesce(sum(returns_valid::int) over (w rows between 1 following and {T} following) = {T}, false) target_valid,
    first_value(tick_ms) over (w rows between {C - 1} preceding and current row) condition_start_ms, tick_ms condition_end_ms,
    first_value(tick_ms) over (w rows between 1 following and {T} following) target_start_ms, last_value(tick_ms) over (w rows between 1 following and {T} following) target_end_ms
  from ret window w as (partition by panel_id order by tick_no)),
fit as (select * from cand where start_index >= 0 and tick_no + {T} < ticks),
idx as (select *, row_number() over (partition by panel_id order by start_index) - 1 sample_id from fit where condition_valid and target_valid)
"""
)
_SPAN = "min(target_start_ms) over (partition by panel_id)"
_CUT = lambda x: f"lo + floor((hi - lo) * {x})"
SPLIT_SQL = (
    WINDOWS_SQL
    + f""", spanned as (select *, {_SPAN} lo, max(target_start_ms) over (partition by panel_id) hi from idx),
split as (
  select *, case when target_start_ms < {_CUT(CUTS[0])} then 'train' when target_start_ms < {_CUT(CUTS[1])} then 'purge_train_validation' when target_start_ms < {_CUT(CUTS[2])} then 'validation'
    when target_start_ms < {_CUT(CUTS[3])} then 'purge_validation_test' else 'test' end split from spanned)
"""
)
_UNION_SQL = (
    SPLIT_SQL
    + f""", marks as (select r.*, s.start_index is not null st from ret r left join (select panel_id, start_index from split where split = 'train') s on s.panel_id = r.panel_id and s.start_index = r.tick_no),
cov as (select * from (select *, bool_or(st) over (partition by panel_id order by tick_no rows between {C + T - 1} preceding and current row) c from marks) where c)
"""
)
_ZFIT_SQL = (
    _UNION_SQL
    + """, cols as (select panel_id, 'btc_log_return' as "column", btc_log_return x from cov union all select panel_id, 'eth_log_return', eth_log_return from cov),
zf as (select panel_id, "column", count(x) n, avg(x) mean, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end scale, stddev_pop(x) = 0 zero_variance from cols group by all)
"""
)


def _feature_sql() -> str:
    whole, recent = f"(w rows between {C - 1} preceding and current row)", f"(w rows between {VOLUME_STEPS - 1} preceding and current row)"
    earlier, near = f"(w rows between {2 * VOLUME_STEPS - 1} preceding and {VOLUME_STEPS} preceding)", f"(w rows between {CORRELATION_STEPS - 1} preceding and current row)"
    out = []
    for a in ASSETS:
        r, v = f"{a}_log_return", f"ln(1 + {a}_volume)"
        out += [
            f"sum({r}) over {whole} {a}_cumulative_log_return",
            f"coalesce(stddev_samp({r}) over {whole}, 0) * sqrt({PER_YEAR}) {a}_realized_volatility_ann",
            f"exp(lev_{a} - max(lev_{a}) over (w rows between {C} preceding and current row)) - 1 {a}_current_drawdown",
            f"case when stddev_samp({v}) over {whole} > 0 then (avg({v}) over {recent} - avg({v}) over {whole}) / stddev_samp({v}) over {whole} else 0 end {a}_log_volume_z",
            f"avg({v}) over {recent} - avg({v}) over {earlier} {a}_log_volume_change",
            f"avg(ln({a}_high / {a}_low)) over {recent} {a}_mean_log_range",
            f"stddev_samp({r}) over {whole} sd_{a}",
        ]
    b, e = RETURNS
    sds = f"(stddev_samp({b}) over {near} * stddev_samp({e}) over {near})"
    out.append(f"case when {sds} > 0 then covar_samp({b}, {e}) over {near} / {sds} end correlation")
    levels = ", ".join(f"sum(coalesce({a}_log_return, 0)) over (partition by panel_id order by tick_no rows unbounded preceding) lev_{a}" for a in ASSETS)
    return f""", lv as (select *, {levels} from ret),
f0 as (select panel_id, tick_no, {", ".join(out)} from lv window w as (partition by panel_id order by tick_no)),
feat as (
  select s.*, f0.* exclude (panel_id, tick_no), case when sd_btc + sd_eth > 0 then (btc_cumulative_log_return + eth_cumulative_log_return) / 2 / ((sd_btc + sd_eth) / 2 * sqrt({float(C)})) end joint_trend_regime_score
  from split s join f0 on f0.panel_id = s.panel_id and f0.tick_no = s.tick_no)
"""


_FEATURES_SQL = SPLIT_SQL + _feature_sql()
_round = lambda cols, d: ", ".join(f"round({c}, {d}) + 0.0 {c}" for c in cols)
_cal_cols = ["panel_id", "tick_ms", "expected_close_ms", *[f"{a}_{c}" for a in ASSETS for c in ("source_close_ms", *panel.VALUES, "missing", "duration_valid")], "is_complete"]
_IDX = "panel_id, start_index, condition_start_ms, condition_end_ms, target_start_ms, target_end_ms, sample_id"

ORACLE = {
    "candle_audit": _K
    + f""", a as (select feed_id, instrument, candle_interval, count(*) observed_rows, min(us) f, max(us) l, count(distinct us) d, max(step) step, count(*) filter ({_BAD_K}) b, count(*) filter (volume < 0) v from k group by all)
select feed_id, instrument, candle_interval, observed_rows, (l - f) // step + 1 expected_rows, f // 1000 first_open_ms, l // 1000 last_open_ms, observed_rows - d duplicate_open_times, (l - f) // step + 1 - d missing_open_times,
  b non_positive_ohlc_rows, v negative_volume_rows from a""",
    "candle_rules": _K
    + f"""select candle_interval, count(*) n, count(*) filter ({_BAD_K}) non_positive_price, count(*) filter (volume < 0) negative_volume, count(*) filter (high_price < greatest(open_price, close_price, low_price)) high_below,
  count(*) filter (low_price > least(open_price, close_price, high_price)) low_above, count(*) filter (us % step <> 0) off_grid, count(*) filter (coalesce(epoch_us(close_time_utc) <> us + step - 1000, true)) wrong_duration
from k group by 1""",
    "candle_resample": _K
    + """, once as (select * from (select *, row_number() over (partition by feed_id, instrument, candle_interval, us order by received_at_utc, row_id) rn from k where candle_interval in ('1h', '4h', '6h')) where rn = 1)
select feed_id, instrument, candle_interval, strftime(open_time_utc, '%Y-%m-%d') as day, first(open_price order by us) open_price, max(high_price) high_price, min(low_price) low_price, last(close_price order by us) close_price, round(sum(volume), 5) volume, count(*) candles
from once group by 1, 2, 3, 4""",
    "download_coverage": """select download_id, feed_id, (epoch_us(requested_end_exclusive_utc) - epoch_us(requested_start_utc)) // case candle_interval when '1h' then 3600000000 when '4h' then 14400000000 when '6h' then 21600000000 when '1d' then 86400000000 end room,
  observed_rows - coalesce(duplicate_open_times, 0) distinct_rows from kline_downloads""",
    "panel_calendar": CANDLES_SQL + f"select {', '.join(_cal_cols)} from cal",
    "panel_audit": CANDLES_SQL
    + """select panel_id, count(*) calendar_rows, min(tick_ms) first_tick_ms, max(tick_ms) last_tick_ms, count(*) filter (is_complete) complete_rows, count(*) filter (not is_complete) incomplete_rows,
  count(*) filter (btc_missing) btc_missing_rows, count(*) filter (eth_missing) eth_missing_rows, count(*) filter (btc_missing and eth_missing) common_missing_rows, count(*) filter (btc_missing <> eth_missing) one_sided_missing_rows,
  count(*) filter (not btc_missing and not btc_duration_valid and not eth_missing and not eth_duration_valid) common_invalid_rows,
  count(*) filter ((not btc_missing and not btc_duration_valid) <> (not eth_missing and not eth_duration_valid)) one_sided_invalid_rows from cal group by 1""",
    "panel_gaps": CANDLES_SQL + "select panel_id, tick_ms, 'btc' asset from cal where btc_missing union all select panel_id, tick_ms, 'eth' from cal where eth_missing",
    "log_returns": RETURNS_SQL + f"select panel_id, tick_ms, tick_no, {_round(RETURNS, 10)}, returns_valid, invalid_reason from ret",
    "return_audit": RETURNS_SQL + "select panel_id, invalid_reason, count(*) n from ret group by 1, 2",
    "window_index": WINDOWS_SQL + f"select {_IDX} from idx",
    "window_audit": WINDOWS_SQL
    + """select panel_id, count(*) candidates, count(*) filter (condition_valid and target_valid) accepted, count(*) filter (not condition_valid and target_valid) rejected_condition,
  count(*) filter (condition_valid and not target_valid) rejected_target, count(*) filter (not condition_valid and not target_valid) rejected_both from fit group by 1""",
    "window_nonoverlap": WINDOWS_SQL + f"select panel_id, sample_id, start_index from idx where sample_id % {T} = 0",
    "window_payload": WINDOWS_SQL
    + f"""select i.panel_id, i.sample_id, list(round(r.btc_log_return, 8) order by r.tick_no) target_btc, list(round(r.eth_log_return, 8) order by r.tick_no) target_eth
from idx i join ret r on r.panel_id = i.panel_id and r.tick_no between i.tick_no + 1 and i.tick_no + {T} group by 1, 2""",
    "condition_features": _FEATURES_SQL + f"select panel_id, sample_id, {_round(FEATURES, 7)} from feat",
    "temporal_split": SPLIT_SQL + "select panel_id, sample_id, target_start_ms, split from split",
    "split_audit": SPLIT_SQL
    + "select panel_id, split, count(*) windows, min(condition_start_ms) first_condition_ms, max(target_end_ms) last_target_ms, round(count(*) / sum(count(*)) over (partition by panel_id), 8) share from split group by 1, 2",
    "split_separation": SPLIT_SQL
    + """, e as (select panel_id, split, min(condition_start_ms) a, max(target_end_ms) b, case split when 'train' then 1 when 'validation' then 2 else 3 end k from split where split in ('train', 'validation', 'test') group by 1, 2),
g as (select panel_id, lag(split) over w earlier, split later, a - lag(b) over w gap_ms from e window w as (partition by panel_id order by k)) select *, gap_ms > 0 separate from g where earlier is not null""",
    "zscore_round_trip": _ZFIT_SQL
    + """, l as (select panel_id, tick_ms, 'btc_log_return' as "column", btc_log_return x from ret where returns_valid union all select panel_id, tick_ms, 'eth_log_return', eth_log_return from ret where returns_valid)
select l.panel_id, tick_ms, l."column", round(x, 9) + 0.0 as value from l join zf on zf.panel_id = l.panel_id and zf."column" = l."column" """,
    "interval_union_returns": _UNION_SQL + "select panel_id, tick_ms from cov",
    "zscore_fit": _ZFIT_SQL + 'select panel_id, "column", n, round(mean, 10) mean, round(scale, 10) scale, zero_variance from zf',
    "zscore_apply": _ZFIT_SQL
    + """, l as (select panel_id, tick_ms, 'btc_log_return' as "column", btc_log_return x from ret where returns_valid union all select panel_id, tick_ms, 'eth_log_return', eth_log_return from ret where returns_valid)
select l.panel_id, tick_ms, l."column", round((x - mean) / scale, 6) + 0.0 z from l join zf on zf.panel_id = l.panel_id and zf."column" = l."column\"""",
    "normalization_audit": _FEATURES_SQL
    + f""", tr as (select * from feat where split = 'train'), lg as ({" union all ".join(f'select panel_id, {chr(39)}{c}{chr(39)} as "column", {c} x from tr' for c in FEATURES)}),
f as (select panel_id, "column", count(x) n, avg(x) m, stddev_pop(x) s from lg group by all)
select panel_id, "column", n, 0.0::double mean_z, case when s = 0 then 0.0::double else 1.0::double end sd_z from f where n > 1""",
    "price_reconstruction": WINDOWS_SQL
    + f"""select i.panel_id, i.sample_id, round(r.btc_close, 5) btc_rebuilt, round(r.eth_close, 5) eth_rebuilt from idx i join ret r on r.panel_id = i.panel_id and r.tick_no = i.tick_no + {T}""",
    "segments": RETURNS_SQL
    + """, g as (select *, tick_no - row_number() over (partition by panel_id order by tick_no) run from ret where returns_valid)
select panel_id, min(tick_ms) first_tick_ms, count(*) length from g group by panel_id, run""",
    "segmented_acf": RETURNS_SQL
    + f""", h as (select *, tick_no - row_number() over (partition by panel_id order by tick_no) run from ret where returns_valid),
x as ({" union all ".join(f"select panel_id, tick_no, run, '{a}' asset, '{n}' series, {e} x from h" for a in ASSETS for n, e in (("return", f"{a}_log_return"), ("absolute", f"abs({a}_log_return)")))}),
g as (select *, x - avg(x) over (partition by panel_id, asset, series) d from x), v as (select panel_id, asset, series, sum(d * d) v from g group by 1, 2, 3), lags as (select unnest(range(1, {ACF_LAGS + 1})) lag),
p as (select a.panel_id, a.asset, a.series, lag, sum(a.d * b.d) s from g a cross join lags join g b on a.panel_id = b.panel_id and a.asset = b.asset and a.series = b.series and a.run = b.run and b.tick_no = a.tick_no + lag group by 1, 2, 3, 4)
select v.panel_id, v.asset, v.series, lags.lag, round(case when v.v > 0 then coalesce(p.s, 0) / v.v else 0 end, 7) acf from v cross join lags left join p on p.panel_id = v.panel_id and p.asset = v.asset and p.series = v.series and p.lag = lags.lag""",
}
