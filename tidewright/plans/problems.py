"""The pN queries of the core problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import to_us
from tidewright.operators import dedup, grid, intervals, rolling, spikes
from tidewright.sources.tables import table

ARRIVAL = ("received_at_utc", "row_id")


# 1. rolling totals over trailing periods


def rolling_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_totals(
        table(spark, sf, "btc_eth_6h_panel"),
        table(spark, sf, "panels"),
        ["panel_id"],
        "open_time_utc",
        {"btc": "btc_volume", "eth": "eth_volume"},
        "first_open_time_utc",
        "last_open_time_utc",
        windows=(7, 30),
        arrival=ARRIVAL,
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_panel(spark, sf).where(F.col("active_readings") == 0).select("panel_id", "asset", "activity_day", "window_days")


def p1_rolling_totals(spark: SparkSession, sf: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("total", "daily_average")}
    return rolling_panel(spark, sf).withColumns(rounded)


_P1_SQL = """
with once as (
  select * from (select *, row_number() over (partition by panel_id, open_time_utc order by received_at_utc, row_id) rn from btc_eth_6h_panel) where rn = 1),
long as (
  select panel_id, 'btc' asset, cast(open_time_utc as date) d, btc_volume v from once
  union all select panel_id, 'eth', cast(open_time_utc as date), eth_volume from once),
live as (
  select panel_id, 'btc' asset, cast(open_time_utc as date) d, count(*) filter (where btc_volume > 0) a from btc_eth_6h_panel group by all
  union all select panel_id, 'eth', cast(open_time_utc as date), count(*) filter (where eth_volume > 0) from btc_eth_6h_panel group by all),
daily as (select panel_id, asset, d, sum(v) v from long group by all),
cal as (
  select p.panel_id, a.asset, w.window_days, cast(unnest(generate_series(cast(cast(first_open_time_utc as date) as timestamp), cast(cast(last_open_time_utc as date) as timestamp), interval 1 day)) as date) d
  from panels p, (values ('btc'), ('eth')) a(asset), (values (7), (30)) w(window_days)),
sums as (
  select c.panel_id, c.asset, c.d, c.window_days, coalesce(sum(y.v), 0) total, coalesce(sum(l.a), 0) act
  from cal c left join live l on l.panel_id = c.panel_id and l.asset = c.asset and l.d between c.d - (c.window_days - 1) and c.d
  left join daily y on y.panel_id = l.panel_id and y.asset = l.asset and y.d = l.d
  group by all)
"""


# 2. irregular readings onto a regular grid


def grid_panel(spark: SparkSession, sf: str) -> DataFrame:
    return grid.regular_grid(
        table(spark, sf, "btc_eth_6h_panel"),
        table(spark, sf, "panels"),
        ["panel_id"],
        "open_time_utc",
        "first_open_time_utc",
        "last_open_time_utc",
        "is_complete",
        values=("btc_close", "eth_close"),
        arrival=ARRIVAL,
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return grid_panel(spark, sf).where("is_missing").select("panel_id", "tick_ms")


def p2_regular_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_panel(spark, sf)


_P2_SQL = """
with ticks as (
  select panel_id, epoch_ms(first_open_time_utc) f, unnest(range(epoch_ms(first_open_time_utc), epoch_ms(last_open_time_utc) + 1, 21600000)) tick_ms from panels),
readings as (
  select r.*, epoch_us(open_time_utc) us, f0 + ((epoch_us(open_time_utc) - f0 * 1000) // 21600000000) * 21600000 tick_ms
  from btc_eth_6h_panel r join (select panel_id, epoch_ms(first_open_time_utc) f0 from panels) using (panel_id)
  where epoch_us(open_time_utc) >= f0 * 1000),
counted as (select panel_id, tick_ms, count(*) n from readings group by all),
chosen as (
  select * from (select *, row_number() over (partition by panel_id, tick_ms order by us desc, received_at_utc, row_id) rn from readings where is_complete) where rn = 1),
j as (
  select t.panel_id, t.tick_ms, coalesce(n, 0) n, c.us, c.row_id, c.btc_close, c.eth_close, case when c.us is not null then t.tick_ms end full_ms
  from ticks t left join counted using (panel_id, tick_ms) left join chosen c on c.panel_id = t.panel_id and c.tick_ms = t.tick_ms),
g as (
  select *, max(full_ms) over (partition by panel_id order by tick_ms) prev, min(full_ms) over (partition by panel_id order by tick_ms rows between current row and unbounded following) nxt from j)
"""


# 3. overlapping and gapped time intervals


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "window_index").where(F.col("split").isNotNull())
    return intervals.interval_gaps(rows, ["panel_id", "split"], "condition_start_utc", "target_end_utc")


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "window_index").where(F.col("split").isNotNull())
    return intervals.interval_periods(rows, ["panel_id", "split"], "condition_start_utc", "target_end_utc")


def p3_every_split(spark: SparkSession, sf: str) -> DataFrame:
    """The periods of every split, windows without a split being one of their own."""
    return intervals.interval_periods(table(spark, sf, "window_index"), ["panel_id", "split"], "condition_start_utc", "target_end_utc")


_P3_SQL = """
with i as (
  select panel_id, split, epoch_us(condition_start_utc) s, epoch_us(target_end_utc) e from window_index
  where split is not null and condition_start_utc is not null and target_end_utc is not null and target_end_utc >= condition_start_utc),
m as (select *, max(e) over (partition by panel_id, split order by s, e rows between unbounded preceding and 1 preceding) reach from i),
o as (select *, case when reach is null or s > reach + 21600000000 then 1 else 0 end opens from m),
r as (select *, sum(opens) over (partition by panel_id, split order by s, e rows unbounded preceding) run from o)
"""


# 5. messages delivered more than once

KLINE_ID = ["feed_id", "instrument", "candle_interval", "open_time_utc"]
PANEL_ID = ["panel_id", "open_time_utc"]


def _klines(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.resolve_symbols(table(spark, sf, "klines"), table(spark, sf, "instruments"), "symbol", "instrument")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    candles = dedup.further_copies(_klines(spark, sf), KLINE_ID, ["received_at_utc"], "row_id")
    panel = dedup.further_copies(table(spark, sf, "btc_eth_6h_panel"), PANEL_ID, ["received_at_utc"], "row_id")
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "row_id")
    return named(candles, "klines").unionByName(named(panel, "btc_eth_6h_panel"))


def p5_kept_candles(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.keep_first(_klines(spark, sf), KLINE_ID, ARRIVAL)
    return kept.select("row_id", "feed_id", "instrument", "candle_interval", (to_us(F.col("open_time_utc")) / 1000).cast("bigint").alias("open_time_ms"), F.round("close_price", 6).alias("close_price"), F.round("volume", 6).alias("volume"))


BATCH_CUT = "2021-01-01 00:00:00"


def p5_new_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Candles received from the cut on are a new batch; those before it are stored."""
    rows = _klines(spark, sf)
    cut = F.lit(BATCH_CUT).cast("timestamp_ntz")
    stored, batch = rows.where(F.col("received_at_utc") < cut), rows.where(F.col("received_at_utc") >= cut)
    return dedup.accept_batch(batch, stored, KLINE_ID, ARRIVAL).select("row_id", "feed_id", "instrument", "candle_interval")


_P5_K = "(select *, upper(regexp_replace(symbol, '[^0-9A-Za-z]', '', 'g')) instrument from klines)"

# 6. implausible spikes in measurements

CANDLE = {n: f"btc_{n}" for n in ("open", "high", "low", "close", "volume")}


def p6_readings(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, sf, "btc_eth_6h_panel"), ["panel_id"], "open_time_utc", "is_complete", CANDLE, ARRIVAL)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_readings(spark, sf).select("panel_id", "open_time_ms", "measure")


_WEEK = spikes.NEIGHBOUR_US


def _stuck_sql(c: str) -> str:
    return f"coalesce({c} = lag({c}) over w and us - lag(us) over w <= {_WEEK}, false)::int e_{c}"


def _change_sql(x: str) -> str:
    """The changes from the medians of the readings before and after, in SQL."""
    near = f"[n.{x} for n in coalesce({{side}}, []) if n.{x} is not null and abs(n.us - b.us) <= {spikes.CHANGE_US}]"
    before, after = (f"({x} - list_median({near.format(side=side)}))" for side in ("before", "after"))
    return f"{before} {x}b, {after} {x}a"


_both_sql = lambda x, name: f"case when sign({x}a) = sign({x}b) then least(abs({x}a), abs({x}b)) end {name}"
_step_sql = lambda x: f"case when us - lag(us) over w <= {spikes.CHANGE_US} then {x} - lag({x}) over w end {x}s"
_P6_SQL = f"""
with first_copy as (
  select *, row_number() over (partition by panel_id, open_time_utc order by received_at_utc, row_id) rn from btc_eth_6h_panel where is_complete),
r as (select panel_id, epoch_us(open_time_utc) us, hour(open_time_utc) hr, btc_open o, btc_high h, btc_low l, btc_close c, btc_volume v from first_copy where rn = 1),
a as (
  select *, coalesce(h <= 0 or l <= 0 or h < l or h < greatest(o, c) or l > least(o, c), false) bad_price, coalesce(v < 0, false) bad_volume,
    case when h > 0 and greatest(o, c) > 0 then greatest(ln(h / greatest(o, c)), 0) end up, case when l > 0 and least(o, c) > 0 then greatest(ln(least(o, c) / l), 0) end down,
    case when v > 0 then ln(v) end lv, case when h > 0 then ln(h) end lh, case when l > 0 then ln(l) end ll, {_stuck_sql("h")}, {_stuck_sql("l")}, {_stuck_sql("v")}
  from r window w as (partition by panel_id order by us)),
b as (
  select *, sum(e_h) over e h4, sum(e_l) over e l4, sum(e_v) over e v4,
    list({{'us': us, 'lv': lv, 'lh': lh, 'll': ll}}) over (partition by panel_id order by us rows between {spikes.AROUND} preceding and 1 preceding) before,
    list({{'us': us, 'lv': lv, 'lh': lh, 'll': ll}}) over (partition by panel_id order by us rows between 1 following and {spikes.AROUND} following) after
  from a window e as (partition by panel_id order by us rows between {spikes.STUCK - 2} preceding and current row)),
c0 as (
  select *, bool_or(h4 = {spikes.STUCK - 1} or l4 = {spikes.STUCK - 1}) over s stuck_price, bool_or(v4 = {spikes.STUCK - 1}) over s stuck_volume,
    lv - list_median([n.lv for n in coalesce(before, []) || coalesce(after, []) if n.lv is not null and abs(n.us - b.us) <= {_WEEK}]) lvl, {_change_sql("lh")}, {_change_sql("ll")}
  from b window s as (partition by panel_id order by us rows between current row and {spikes.STUCK - 1} following)),
c1 as (select *, {_both_sql("lh", "rise")}, {_both_sql("ll", "fall")}, {_step_sql("lh")}, {_step_sql("ll")} from c0 window w as (partition by panel_id order by us)),
both_levels as (select panel_id, hr, up, down, lvl, null::double lhs, null::double lls from c1 union all select panel_id, -1, up, down, lvl, lhs, lls from c1),
q as (
  select panel_id, hr, count(*) n, quantile_disc(up, 0.25) u1, quantile_disc(up, 0.75) u3, quantile_disc(down, 0.25) d1, quantile_disc(down, 0.75) d3, quantile_disc(lvl, 0.25) v1, quantile_disc(lvl, 0.75) v3,
    quantile_disc(lhs, 0.75) - quantile_disc(lhs, 0.25) hi, quantile_disc(lls, 0.75) - quantile_disc(lls, 0.25) li
  from both_levels group by 1, 2),
z as (
  select c1.*, (up - q.u3) / greatest(q.u3 - q.u1, {spikes.LEAST_RANGE}) zu, (down - q.d3) / greatest(q.d3 - q.d1, {spikes.LEAST_RANGE}) zd,
    greatest(lvl - q.v3, q.v1 - lvl) / greatest(q.v3 - q.v1, {spikes.LEAST_RANGE}) zv, rise / greatest(qw.hi, {spikes.LEAST_RANGE}) zr, fall / greatest(qw.li, {spikes.LEAST_RANGE}) zf
  from c1 join q qh on qh.panel_id = c1.panel_id and qh.hr = c1.hr join q qw on qw.panel_id = c1.panel_id and qw.hr = -1
  join q on q.panel_id = c1.panel_id and q.hr = case when qh.n >= {spikes.HOUR_READINGS} then c1.hr else -1 end),
f as (
  select panel_id, us // 1000 open_time_ms, 'price' measure, bad_price impossible, stuck_price stuck,
    coalesce(zu > {spikes.WICK_FENCE}, false) or coalesce(zd > {spikes.WICK_FENCE}, false) or coalesce(zr > {spikes.CHANGE_FENCE}, false) or coalesce(zf > {spikes.CHANGE_FENCE}, false) spike from z
  union all select panel_id, us // 1000, 'volume', bad_volume, stuck_volume, coalesce(zv > {spikes.VOLUME_FENCE}, false) from z)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_rolling_totals": p1_rolling_totals,
    "p2_found": p2_found,
    "p2_regular_grid": p2_regular_grid,
    "p3_found": p3_found,
    "p3_periods": p3_periods,
    "p3_every_split": p3_every_split,
    "p5_found": p5_found,
    "p5_kept_candles": p5_kept_candles,
    "p5_new_batch": p5_new_batch,
    "p6_found": p6_found,
    "p6_readings": p6_readings,
}

ORACLE = {
    "p1_found": _P1_SQL + "select panel_id, asset, strftime(d, '%Y-%m-%d') activity_day, window_days from sums where act = 0",
    "p1_rolling_totals": _P1_SQL
    + "select panel_id, asset, strftime(d, '%Y-%m-%d') activity_day, window_days, round(total, 6) total, round(total / window_days, 6) daily_average, cast(act as bigint) active_readings from sums",
    "p2_found": _P2_SQL + "select panel_id, tick_ms from g where full_ms is null",
    "p2_regular_grid": _P2_SQL
    + """select g.panel_id, g.tick_ms, g.full_ms is null is_missing, g.n readings, g.us // 1000 reading_ms, (g.tick_ms - g.prev) // 21600000 periods_since_reading,
  (g.nxt - g.tick_ms) // 21600000 periods_to_reading, g.btc_close, g.eth_close, c.btc_close btc_close_carried, c.eth_close eth_close_carried
from g left join chosen c on c.panel_id = g.panel_id and c.tick_ms = g.prev""",
    "p3_found": _P3_SQL
    + """, f as (select panel_id, split, s, reach from r where opens = 1 and reach is not null)
select panel_id, split, reach // 1000 period_end_ms, s // 1000 next_start_ms from f""",
    "p3_periods": _P3_SQL + "select panel_id, split, min(s) // 1000 period_start_ms, max(e) // 1000 period_end_ms from r group by panel_id, split, run",
    "p3_every_split": _P3_SQL.replace("split is not null and ", "") + "select panel_id, split, min(s) // 1000 period_start_ms, max(e) // 1000 period_end_ms from r group by panel_id, split, run",
    "p5_found": f"""
select 'klines' table_name, row_id from (select row_id, row_number() over (partition by feed_id, instrument, candle_interval, open_time_utc order by received_at_utc, row_id) rn from {_P5_K}) where rn > 1
union all
select 'btc_eth_6h_panel', row_id from (select row_id, row_number() over (partition by panel_id, open_time_utc order by received_at_utc, row_id) rn from btc_eth_6h_panel) where rn > 1""",
    "p5_kept_candles": f"""
select row_id, feed_id, instrument, candle_interval, epoch_ms(open_time_utc) open_time_ms, round(close_price, 6) close_price, round(volume, 6) volume
from (select *, row_number() over (partition by feed_id, instrument, candle_interval, open_time_utc order by received_at_utc, row_id) rn from {_P5_K}) where rn = 1""",
    "p5_new_batch": f"""
with k as {_P5_K}, ranked as (select *, row_number() over (partition by feed_id, instrument, candle_interval, open_time_utc order by received_at_utc, row_id) rn from k where received_at_utc >= timestamp '{BATCH_CUT}')
select row_id, feed_id, instrument, candle_interval from ranked r where rn = 1 and not exists (
  select 1 from k where received_at_utc < timestamp '{BATCH_CUT}' and k.feed_id = r.feed_id and k.instrument = r.instrument and k.candle_interval = r.candle_interval and k.open_time_utc = r.open_time_utc)""",
    "p6_found": _P6_SQL + "select panel_id, open_time_ms, measure from f where impossible or stuck or spike",
    "p6_readings": _P6_SQL + "select * from f where impossible or stuck or spike",
}
