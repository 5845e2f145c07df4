"""Candles to a regular two-asset panel, gap-safe log returns and their audits.

Nothing is imputed: a tick without a candle is a row with empty values, and a return exists only where the
current and the previous tick are complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.times import HOUR_US, MS, to_us, us_to_ms
from tidewright.operators.windows import at_home, frames, sharded

#: The candle intervals and their length in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
}
PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


def interval_us(interval: str) -> int:
    """Length of a candle interval in microseconds."""
    if interval not in INTERVAL_MS:
        raise ValueError(f"unknown candle interval {interval!r}")
    return INTERVAL_MS[interval] * MS


def steps_for_days(days: float, interval: str) -> int:
    """Ticks in a number of days, which must be a whole number of ticks."""
    steps, rest = divmod(round(days * 24 * HOUR_US), interval_us(interval))
    if rest or steps < 1:
        raise ValueError(f"{days} days are not a whole number of {interval} candles")
    return steps


def interval_column_us(interval: Column) -> Column:
    """The same for a column; NULL for intervals that are not listed."""
    out = F.lit(None).cast("bigint")
    for name, length in INTERVAL_MS.items():
        out = F.when(interval == name, F.lit(length * MS).cast("bigint")).otherwise(out)
    return out


def candle_violations(open_us: Column, close_us: Column, length_us: Column, o: Column, h: Column, l: Column, c: Column, v: Column) -> dict[str, Column]:  # noqa: E741
    """The rules that a candle can break, each a boolean column (NULL values break the price rule)."""
    least, most = F.least(o, c, h), F.greatest(o, c, l)
    return {
        "non_positive_price": F.coalesce((F.least(o, h, l, c) <= 0) | o.isNull() | h.isNull() | l.isNull() | c.isNull(), F.lit(True)),
        "negative_volume": F.coalesce(v < 0, F.lit(False)),
        "high_below": F.coalesce(h < most, F.lit(False)),
        "low_above": F.coalesce(l > least, F.lit(False)),
        "off_grid": F.coalesce(F.pmod(open_us, length_us) != 0, F.lit(True)),
        "wrong_duration": F.coalesce(close_us != open_us + length_us - MS, F.lit(True)),
    }


def candle_audit(candles: DataFrame, keys: Sequence[str], open_time: str, length_us: Column, columns: dict[str, str]) -> DataFrame:
    """One row per series: rows, expected rows, first and last open, repeated and missing open times, faulty rows."""
    rows = candles.select(*keys, to_us(F.col(open_time)).alias("__us"), length_us.alias("__step"), *[F.col(columns[n]).alias(f"__{n}") for n in VALUES])
    bad = F.lit(False)
    for n in PRICES:
        x = F.col(f"__{n}")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)
    distinct_opens = rows.groupBy(*keys, "__us").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__step").alias("__step"), F.count_if(bad).alias("__bad"), F.count_if(F.col("__volume") < 0).alias("__neg")
    )
    audit = distinct_opens.groupBy(*keys).agg(
        F.sum("__n").alias("observed_rows"),
        F.min("__us").alias("__first"),
        F.max("__us").alias("__last"),
        F.count("__us").alias("__distinct"),
        F.max("__step").alias("__step"),
        F.sum("__bad").alias("non_positive_ohlc_rows"),
        F.sum("__neg").alias("negative_volume_rows"),
    )
    expected = F.call_function("div", F.col("__last") - F.col("__first"), F.col("__step")) + 1
    return audit.select(
        *keys,
        "observed_rows",
        expected.alias("expected_rows"),
        us_to_ms(F.col("__first")).alias("first_open_ms"),
        us_to_ms(F.col("__last")).alias("last_open_ms"),
        (F.col("observed_rows") - F.col("__distinct")).alias("duplicate_open_times"),
        (expected - F.col("__distinct")).alias("missing_open_times"),
        "non_positive_ohlc_rows",
        "negative_volume_rows",
    )


def build_panel(candles: DataFrame, entity: str, asset: str, assets: Sequence[str], open_time: str, close_time: str, values: Sequence[str] = VALUES, interval: str = "6h") -> DataFrame:
    """A row per entity and tick of the calendar that both assets cover, each asset's candle beside it or empty, and the
    number of the tick and of all ticks.

    ``candles`` has one candle per entity, asset and open time. Candles off the grid fit no tick. Calendar and candles meet
    in one shuffle, as rows of the same aggregate. Entities without common coverage give no rows.
    """
    if len(set(assets)) != 2:
        raise ValueError("a panel has two different assets")
    step = interval_us(interval)
    rows = candles.select(F.col(entity).alias("entity"), F.col(asset).alias("asset"), to_us(F.col(open_time)).alias("us"), to_us(F.col(close_time)).alias("close_us"), *values)
    rows = rows.where(F.col("asset").isin(*assets) & F.col("us").isNotNull() & (F.pmod(F.col("us"), F.lit(step).cast("bigint")) == 0))
    own = lambda a, c: F.when(F.col("asset") == a, F.col(c))
    cover = rows.groupBy("entity").agg(*[f(own(a, "us")).alias(f"{n}_{i}") for i, a in enumerate(assets) for n, f in (("lo", F.min), ("hi", F.max))])
    lo, hi = F.greatest("lo_0", "lo_1"), F.least("hi_0", "hi_1")
    cover = cover.where(F.col("lo_0").isNotNull() & F.col("lo_1").isNotNull() & (lo <= hi))
    ticks = cover.select("entity", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(lo, hi, F.lit(step).cast("bigint"))).alias("us"))
    both = rows.unionByName(ticks, allowMissingColumns=True)
    candle = F.struct("close_us", *values)
    wide = both.groupBy("entity", "us").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max_by(candle, F.when(F.col("asset") == a, F.lit(1))).alias(f"c{i}") for i, a in enumerate(assets)]
    )
    wide = wide.where("lo is not null")  # a tick of the calendar
    steps = lambda c: F.call_function("div", c, F.lit(step).cast("bigint"))
    counts = [steps(F.col("us") - F.col("lo")).alias("tick_no"), (steps(F.col("hi") - F.col("lo")) + 1).alias("calendar_ticks")]
    out = [F.col("entity").alias(entity), *counts, us_to_ms(F.col("us")).alias("tick_ms"), us_to_ms(F.col("us") + F.lit(step - MS)).alias("expected_close_ms")]
    complete = F.lit(True)
    for i, a in enumerate(assets):
        c = F.col(f"c{i}")
        valid = F.coalesce(c["close_us"] == F.col("us") + F.lit(step - MS), F.lit(False))
        complete = complete & c.isNotNull() & valid
        out += [us_to_ms(c["close_us"]).alias(f"{a}_source_close_ms"), *[c[v].alias(f"{a}_{v}") for v in values], c.isNull().alias(f"{a}_missing"), valid.alias(f"{a}_duration_valid")]
    return wide.select(*out, complete.alias("is_complete"))


def panel_audit(panel: DataFrame, entity: str, assets: Sequence[str]) -> DataFrame:
    """Counts of complete, missing and truncated ticks per entity: common to both assets and one-sided."""
    a, b = assets
    missing = [F.col(f"{x}_missing") for x in assets]
    truncated = [~F.col(f"{x}_missing") & ~F.col(f"{x}_duration_valid") for x in assets]
    return panel.groupBy(entity).agg(
        F.count(F.lit(1)).alias("calendar_rows"),
        F.min("tick_ms").alias("first_tick_ms"),
        F.max("tick_ms").alias("last_tick_ms"),
        F.count_if("is_complete").alias("complete_rows"),
        F.count_if(~F.col("is_complete")).alias("incomplete_rows"),
        F.count_if(missing[0]).alias(f"{a}_missing_rows"),
        F.count_if(missing[1]).alias(f"{b}_missing_rows"),
        F.count_if(missing[0] & missing[1]).alias("common_missing_rows"),
        F.count_if(missing[0] != missing[1]).alias("one_sided_missing_rows"),
        F.count_if(truncated[0] & truncated[1]).alias("common_invalid_rows"),
        F.count_if(truncated[0] != truncated[1]).alias("one_sided_invalid_rows"),
    )


def panel_gaps(panel: DataFrame, candles: DataFrame, entity: str, asset: str, assets: Sequence[str], open_time: str) -> DataFrame:
    """Calendar ticks without a candle, by asset: the set difference of calendar and candles."""
    ticks = panel.select(entity, "tick_ms", F.explode(F.array(*[F.lit(a) for a in assets])).alias("asset"))
    have = candles.select(entity, us_to_ms(to_us(F.col(open_time))).alias("tick_ms"), F.col(asset).alias("asset"))
    return ticks.join(have, [entity, "tick_ms", "asset"], "left_anti")


def log_returns(panel: DataFrame, entity: str, assets: Sequence[str], interval: str = "6h") -> DataFrame:
    """Log returns from tick to tick; ``invalid_reason`` says why there is none (empty if there is).

    The panel has every tick of its calendar, so ``tick_no`` counts steps from an entity's first tick.
    """
    rows = panel
    if "tick_no" not in panel.columns:
        step = interval_us(interval) // MS
        starts = panel.groupBy(entity).agg(F.min("tick_ms").alias("__from"))
        rows = panel.join(starts, entity).withColumn("tick_no", F.call_function("div", F.col("tick_ms") - F.col("__from"), F.lit(step).cast("bigint")))
    along = frames(entity)
    before = F.lag("is_complete").over(along)
    current = ~F.col("is_complete")
    rows = sharded(rows, entity, 1, 0).withColumns(
        {
            "__reason": F.when(before.isNull(), F.lit("first_observation")).otherwise(
                F.concat_ws("|", F.when(current, F.lit("current_incomplete")), F.when(~before, F.lit("previous_incomplete")))
            ),
            **{f"__p_{a}": F.lag(f"{a}_close").over(along) for a in assets},
        }
    )
    rows = rows.where(at_home())
    valid = F.col("__reason") == ""
    returns = [F.when(valid, F.ln(F.col(f"{a}_close") / F.col(f"__p_{a}"))).alias(f"{a}_log_return") for a in assets]
    rest = [c for c in panel.columns if c not in (entity, "tick_ms", "tick_no")]
    return rows.select(entity, "tick_ms", "tick_no", *returns, valid.alias("returns_valid"), F.col("__reason").alias("invalid_reason"), *rest)


def return_audit(returns: DataFrame, entity: str) -> DataFrame:
    """How many ticks have which reason; valid ones have an empty reason."""
    return returns.groupBy(entity, "invalid_reason").agg(F.count(F.lit(1)).alias("n"))
