"""Rolling totals and averages over trailing periods of whole days.

Range-based window frames run over integer day numbers. Readings become sparse daily totals,
calendar rows stand for days without activity, and averages divide by the fixed number of days.

Each entity is cut into time shards of ``shard_days``; the days before a shard that its frames look
back on are copied into it, so a hot entity is spread over many tasks and one shuffle serves
de-duplication, daily totals and frames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.times import day_number, floor_div, to_us


def rolling_totals(
    readings: DataFrame,
    coverage: DataFrame,
    keys: Sequence[str],
    time: str,
    measures: dict[str, str],
    first: str,
    last: str,
    windows: Sequence[int] = (7, 30),
    arrival: Sequence[str] = (),
    shard_days: int = 256,
) -> DataFrame:
    """One row per entity, measure, day of its coverage and window length.

    ``measures`` maps a label to the column it stands for; ``arrival`` orders the copies of one
    reading (same keys and time), of which the first counts. Returns the keys, ``asset`` (the
    label), ``activity_day`` (yyyy-MM-dd), ``window_days``, ``total``, ``daily_average``
    (``total / window_days``, also where days are missing) and ``active_readings``.

    Defined results: NULL and NaN measures add nothing; a reading is active if some copy of it has a
    measure above 0; readings with a NULL time are left out; entities without rows in ``coverage``,
    or with a NULL or reversed coverage, give no rows; entities with coverage but no readings give
    zeros; readings outside the coverage count in the windows that reach them; repeated coverage
    rows count once. Other columns of the inputs are ignored, whatever their names.
    """
    if not measures or not windows or min(windows) < 1:
        raise ValueError("measures and windows of at least one day are needed")
    back = max(windows) - 1
    if shard_days <= back:
        raise ValueError("shard_days must exceed the longest window")
    labels, span = list(measures), F.lit(shard_days).cast("bigint")
    ids = [f"__k{i}" for i in range(len(keys))]
    order = [f"__a{i}" for i in range(len(arrival))]
    none = F.lit(None)

    def measure(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    day = day_number(F.col(time))
    seen = readings.where(F.col(time).isNotNull()).select(
        *[F.col(k).alias(i) for k, i in zip(keys, ids)],
        day.alias("__day"),
        to_us(F.col(time)).alias("__us"),
        *[F.col(a).alias(o) for a, o in zip(arrival, order)],
        *[measure(measures[m]).alias(f"__m{j}") for j, m in enumerate(labels)],
    )
    # a day belongs to its shard and, within reach of the next one's frames, to that as well
    home = floor_div(F.col("__day"), shard_days)
    reach = floor_div(F.col("__day") + F.lit(back), shard_days)
    seen = seen.withColumn("__shard", F.explode(F.when(home == reach, F.array(home)).otherwise(F.array(home, reach))))
    types = dict(seen.dtypes)
    days = coverage.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], day_number(F.col(first)).alias("__from"), day_number(F.col(last)).alias("__to"))
    calendar = (
        days.where(F.col("__from") <= F.col("__to"))
        .select(*ids, F.explode(F.sequence("__from", "__to")).alias("__day"))
        .select(
            *ids,
            "__day",
            none.cast("bigint").alias("__us"),
            *[none.cast(types[o]).alias(o) for o in order],
            *[none.cast("double").alias(f"__m{j}") for j in range(len(labels))],
            floor_div(F.col("__day"), shard_days).alias("__shard"),
        )
    )
    parts = seen.unionByName(calendar).repartition(*ids, "__shard")

    copies = W.partitionBy(*ids, "__shard", "__day", "__us")
    first_copy = F.row_number().over(copies.orderBy(*[F.col(o).asc_nulls_last() for o in order]) if order else copies.orderBy(F.lit(0))) == 1
    once = parts.select("*", first_copy.alias("__once"))
    daily = once.groupBy(*ids, "__shard", "__day").agg(
        F.max(F.col("__us").isNull()).alias("__in"),
        *[F.coalesce(F.sum(F.when(F.col("__once"), F.col(f"__m{j}"))), F.lit(0.0)).alias(f"__t{j}") for j in range(len(labels))],
        *[F.count_if(F.col(f"__m{j}") > 0).alias(f"__n{j}") for j in range(len(labels))],
    )
    frames = W.partitionBy(*ids, "__shard").orderBy("__day")
    rows = []
    for j, label in enumerate(labels):
        for n in windows:
            frame = frames.rangeBetween(-(n - 1), 0)
            total = F.sum(f"__t{j}").over(frame)
            rows.append(F.struct(F.lit(label).alias("asset"), F.lit(n).cast("int").alias("window_days"), total.alias("total"), F.sum(f"__n{j}").over(frame).alias("active")))
    wide = daily.select(*ids, "__shard", "__day", "__in", *[r.alias(f"__r{i}") for i, r in enumerate(rows)])
    wide = wide.where(F.col("__in") & (floor_div(F.col("__day"), shard_days) == F.col("__shard")))
    out = wide.select(*ids, "__day", F.explode(F.array(*[f"__r{i}" for i in range(len(rows))])).alias("__r"))
    return out.select(
        *[F.col(i).alias(k) for k, i in zip(keys, ids)],
        F.col("__r.asset").alias("asset"),
        F.date_format(F.date_from_unix_date(F.col("__day").cast("int")), "yyyy-MM-dd").alias("activity_day"),
        F.col("__r.window_days").alias("window_days"),
        F.col("__r.total").alias("total"),
        (F.col("__r.total") / F.col("__r.window_days")).alias("daily_average"),
        F.col("__r.active").alias("active_readings"),
    )
