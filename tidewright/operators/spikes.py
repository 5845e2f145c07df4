"""Implausible readings of candles, relative to each source's normal behaviour.

Five features of a reading have a fence each, all logarithms: the upper wick (high over the body of the candle), the lower
wick (body over the low), the rates of change of high and low, and the volume against the readings around it. Quartile
sketches of the features are kept per source, for wicks and volume per hour of day too, merged across partitions, and
a value beyond the expanded interquartile fence is a spike.

A rate of change is taken towards the readings before and towards those after, each by their median. A fault is away from both
in one direction, so the smaller of the two counts; a lasting change of level is away from one only, and a genuine
move stays within the fence of the source's own changes from one reading to the next. Runs of equal readings (zero
variance) are stuck, and readings that no candle can have are impossible.

Sources are cut into time shards with a margin of readings on both sides, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.times import DAY_US, HOUR_US, floor_div, to_us, us_to_ms
from tidewright.operators.scan import pack, unpack

#: Fences in interquartile ranges beyond the quartiles; of rates of change in interquartile ranges.
WICK_FENCE = 8.0
CHANGE_FENCE = 10.0
VOLUME_FENCE = 3.5
#: Readings on each side that make up a local level.
AROUND = 6
#: Equal readings in a row from which a measure counts as stuck.
STUCK = 5
#: Readings further apart than this are no neighbours; for rates of change of prices, which do not wander as volumes do.
NEIGHBOUR_US = 7 * DAY_US
CHANGE_US = 30 * DAY_US
#: The sampling error of a quartile of n readings is about an interquartile range over the root of n. Where it would be more than
#: HOUR_ERROR for a source and hour, that has no sketch of its own and takes the source's.
HOUR_ERROR = 0.16
HOUR_READINGS = ceil(HOUR_ERROR**-2)
#: Least interquartile range of a feature, so that sources that hardly vary keep a fence.
LEAST_RANGE = 1e-4
_FEATURES = ("up", "down", "level")
#: Changes from one reading to the next, whose quartiles are the fence of the two-sided change.
_CHANGES = {"h": "high_change", "l": "low_change"}
_SKETCHED = (*_FEATURES, *_CHANGES.values())
_SKETCH = 2_000


def _positive(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)


def _stuck(c: Column, order, us: Column) -> Column:
    """Whether a reading repeats the one before it."""
    near = us - F.lag(us).over(order) <= NEIGHBOUR_US
    return F.coalesce((c == F.lag(c).over(order)) & near, F.lit(False)).cast("int")


def _let(value: Column, f) -> Column:
    """``f`` of a value that it uses several times and that is to be computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _median(sorted_values: Column) -> Column:
    """The median of a sorted array without NULLs, NULL if it is empty."""
    at = lambda v, i: F.get(v, F.call_function("div", i, F.lit(2)).cast("int"))
    return _let(sorted_values, lambda v: (at(v, F.size(v) - 1) + at(v, F.size(v))) / 2)


def _near(side: Column, field: str, within: int) -> Column:
    """The known values of a field of the readings at most ``within`` away, sorted."""
    kept = F.filter(side, lambda t: t[field].isNotNull() & (F.abs(t["us"] - F.col("__us")) <= within))
    return F.array_sort(F.transform(kept, lambda t: t[field]))


def reading_features(
    readings: DataFrame,
    keys: Sequence[str],
    time: str,
    complete: str,
    columns: dict[str, str],
    arrival: Sequence[str] = (),
    shard_us: int = 512 * DAY_US,
    margin_us: int = 32 * DAY_US,
) -> DataFrame:
    """Each complete reading once, with its features and its stuck and impossible flags.

    ``columns`` names open, high, low, close and volume. Copies of one reading (same keys and time) count once, the first
    by ``arrival``.
    """
    ids = ["__id"]
    order = [f"__a{i}" for i in range(len(arrival))]
    names = ("open", "high", "low", "close", "volume")
    us = to_us(F.col(time))
    rows = readings.where(F.col(time).isNotNull() & F.coalesce(F.col(complete).cast("boolean"), F.lit(False))).select(
        pack(keys).alias("__id"),
        us.alias("__us"),
        *[F.col(a).alias(o) for a, o in zip(arrival, order)],
        *[F.col(columns[n]).cast("double").alias(n) for n in names],
    )
    shards = F.array_distinct(F.array(*[floor_div(F.col("__us") + F.lit(d), shard_us) for d in (-margin_us, 0, margin_us)]))
    rows = rows.withColumn("__shard", F.explode(shards)).repartition(*ids, "__shard")
    copies = W.partitionBy(*ids, "__shard", "__us").orderBy(*([F.col(o).asc_nulls_last() for o in order] or [F.lit(0)]))
    rows = rows.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") == 1)

    along = W.partitionBy(*ids, "__shard").orderBy("__us")
    x = {n: F.col(n) for n in names}
    top, bottom = F.greatest(x["open"], x["close"]), F.least(x["open"], x["close"])
    wrong = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.withColumns(
        {
            "bad_price": F.coalesce(
                (x["high"] <= 0) | (x["low"] <= 0) | (x["high"] < x["low"]) | (x["high"] < top) | (x["low"] > bottom) | wrong(x["high"]) | wrong(x["low"]), F.lit(False)
            ),
            "bad_volume": F.coalesce((x["volume"] < 0) | wrong(x["volume"]), F.lit(False)),
            "up": F.greatest(F.ln(_positive(x["high"]) / _positive(top)), F.lit(0.0)),
            "down": F.greatest(F.ln(_positive(bottom) / _positive(x["low"])), F.lit(0.0)),
            "__lv": F.ln(_positive(x["volume"])),
            "__lh": F.ln(_positive(x["high"])),
            "__ll": F.ln(_positive(x["low"])),
            **{f"__e_{n}": _stuck(x[n], along, F.col("__us")) for n in ("high", "low", "volume")},
        }
    )
    near = F.struct(F.col("__us").alias("us"), F.col("__lv").alias("v"), F.col("__lh").alias("h"), F.col("__ll").alias("l"))
    back, ahead = along.rowsBetween(-AROUND, -1), along.rowsBetween(1, AROUND)
    ends = {f"__{f}_{n}{side}": agg(f"__l{f}").over(frame) for f in _CHANGES for n, agg in (("least", F.min), ("most", F.max)) for side, frame in (("b", back), ("a", ahead))}
    fresh = F.col("__us") - F.lag("__us").over(along) <= CHANGE_US
    rows = rows.withColumns(
        {
            "__before": F.collect_list(near).over(back),
            "__after": F.collect_list(near).over(ahead),
            **ends,
            **{c: F.when(fresh, F.col(f"__l{f}") - F.lag(f"__l{f}").over(along)) for f, c in _CHANGES.items()},
            **{f"__f_{n}": F.sum(f"__e_{n}").over(along.rowsBetween(2 - STUCK, 0)) for n in ("high", "low", "volume")},
        }
    )
    ended = lambda n: F.max(F.col(f"__f_{n}") == STUCK - 1).over(along.rowsBetween(0, STUCK - 1))
    rows = rows.withColumns({f"__s_{n}": ended(n) for n in ("high", "low", "volume")})
    rows = rows.where(floor_div(F.col("__us"), shard_us) == F.col("__shard"))
    rows = rows.withColumn("__around", _near(F.concat("__before", "__after"), "v", NEIGHBOUR_US))
    # a change from both medians is at most that from the nearer ends of both sides
    most = {f: F.greatest(F.col(f"__l{f}") - F.greatest(f"__{f}_leastb", f"__{f}_leasta"), F.least(f"__{f}_mostb", f"__{f}_mosta") - F.col(f"__l{f}")) for f in _CHANGES}
    return rows.select(
        *ids,
        "__shard",
        "__us",
        F.call_function("div", F.pmod(F.col("__us"), F.lit(DAY_US).cast("bigint")), F.lit(HOUR_US).cast("bigint")).cast("int").alias("__hour"),
        "up",
        "down",
        (F.col("__lv") - _median(F.col("__around"))).alias("level"),
        *[F.col(f"__l{f}").alias(f"__l{f}") for f in _CHANGES],
        *[m.alias(f"__most_{f}") for f, m in most.items()],
        *_CHANGES.values(),
        "__before",
        "__after",
        "bad_price",
        "bad_volume",
        (F.col("__s_high") | F.col("__s_low")).alias("stuck_price"),
        F.col("__s_volume").alias("stuck_volume"),
    )


def fences(features: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Quartile sketches of the features per source and hour, and per source (hour -1): one row per source with
    a map from hour to quartiles (25 entries at most)."""
    changes = [F.when(F.col("__hour") < 0, F.col(c)).alias(c) for c in _CHANGES.values()]  # of the whole source alone
    both = features.select(*ids, F.explode(F.array(F.col("__hour"), F.lit(-1))).alias("__hour"), *_SKETCHED).select(*ids, "__hour", *_FEATURES, *changes)
    probes = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])
    sketches = both.groupBy(*ids, "__hour").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, probes, _SKETCH).alias(c) for c in _SKETCHED])
    entry = F.struct("__hour", F.struct("n", *_SKETCHED).alias("q"))
    return sketches.groupBy(*ids).agg(F.map_from_entries(F.collect_list(entry)).alias("__fences"))


def score_readings(features: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Distance of each feature from the quartiles of its source and hour, in interquartile ranges (``z_*``); of changes
    their size, NULL where it cannot be beyond the fence."""
    per_source = fences(features, ids)
    shards = features.select(*ids, "__shard").distinct()
    placed = shards.join(per_source, ids)  # one row per shard: a hot source stays spread over its shards
    rows = features.join(placed, [*ids, "__shard"])
    hourly, whole = F.element_at("__fences", F.col("__hour")), F.element_at("__fences", F.lit(-1))
    rows = rows.withColumns({"__q": F.when(hourly["n"] >= HOUR_READINGS, hourly).otherwise(whole), "__w": whole}).drop("__fences")
    scores = {}
    for f, change in _CHANGES.items():
        q = F.col("__w")[change]
        spread = F.greatest(F.get(q, 2) - F.get(q, 0), F.lit(LEAST_RANGE))
        a, b = (F.col(f"__l{f}") - _median(_near(F.col(side), f, CHANGE_US)) for side in ("__before", "__after"))
        # medians cost a sort each, so only changes that can be beyond the fence have them taken
        both = _let(F.struct(a.alias("a"), b.alias("b")), lambda t: F.when(F.signum(t["a"]) == F.signum(t["b"]), F.least(F.abs(t["a"]), F.abs(t["b"]))))
        scores[f"z_{change}"] = F.when(F.col(f"__most_{f}") > CHANGE_FENCE * spread, both / spread)
    for c in _FEATURES:
        q = F.col("__q")[c]
        low, high = F.get(q, 0), F.get(q, 2)
        spread = F.greatest(high - low, F.lit(LEAST_RANGE))
        scores[f"z_{c}"] = F.when(F.col(c) > high, (F.col(c) - high) / spread).when(F.col(c) < low, (F.col(c) - low) / spread).otherwise(F.lit(0.0))
    return rows.withColumns(scores).drop("__q", "__w")


def implausible_readings(
    readings: DataFrame,
    keys: Sequence[str],
    time: str,
    complete: str,
    columns: dict[str, str],
    arrival: Sequence[str] = (),
) -> DataFrame:
    """The flagged readings: keys, ``open_time_ms``, ``measure`` (price or volume), ``impossible``, ``stuck``, ``spike``.

    Defined results: only readings whose ``complete`` is true and whose time is known count; a NULL measure is never
    flagged; NaN and infinite ones are impossible, as are prices not above 0, a high below or a low above another
    price of the candle, and negative volumes; one row per reading and measure however often it was
    delivered; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ids = ["__id"]
    features = reading_features(readings, keys, time, complete, columns, arrival)
    scored = score_readings(features, ids)
    beyond = lambda c, k: F.coalesce(F.abs(F.col(c)) > k, F.lit(False))
    flag = lambda measure, spike: F.struct(
        F.lit(measure).alias("measure"), F.col(f"bad_{measure}").alias("impossible"), F.col(f"stuck_{measure}").alias("stuck"), spike.alias("spike")
    )
    price = beyond("z_up", WICK_FENCE) | beyond("z_down", WICK_FENCE) | beyond("z_high_change", CHANGE_FENCE) | beyond("z_low_change", CHANGE_FENCE)
    flags = F.array(flag("price", price), flag("volume", beyond("z_level", VOLUME_FENCE)))
    out = scored.select(*ids, "__us", F.explode(flags).alias("f")).where(F.col("f.impossible") | F.col("f.stuck") | F.col("f.spike"))
    return out.select(*unpack("__id", keys), us_to_ms(F.col("__us")).alias("open_time_ms"), "f.measure", "f.impossible", "f.stuck", "f.spike")
