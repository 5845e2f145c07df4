"""Irregular readings onto a regular grid, missing periods marked and carried over.

Each source is cut into time shards. A shard gives a summary of its first and last reading; a prefix
scan over the summaries gives every shard the reading that it carries in from either side; then all
shards are filled independently. Nothing is imputed into ``{value}``: the carried value stands beside
it in ``{value}_carried``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.times import HOUR_US, floor_div, to_us, us_to_ms
from tidewright.operators.scan import carry_scan, pack, unpack


def regular_grid(
    readings: DataFrame,
    coverage: DataFrame,
    keys: Sequence[str],
    time: str,
    first: str,
    last: str,
    complete: str,
    values: Sequence[str] = (),
    arrival: Sequence[str] = (),
    step_us: int = 6 * HOUR_US,
    shard_steps: int = 512,
) -> DataFrame:
    """One row per source and period ``[tick, tick + step)`` of its coverage.

    Ticks run from ``first`` to ``last`` (both included) in steps of ``step_us``. A period is complete
    if a reading whose ``complete`` is true has its time in it; of several the latest counts, of
    copies of one time the first by ``arrival``. Returns the keys, ``tick_ms``, ``is_missing``,
    ``readings`` (rows with a time in the period), ``reading_ms``, ``periods_since_reading`` and
    ``periods_to_reading`` (0 in a complete period, NULL where there is no reading on that side) and,
    for each of ``values``, the value of a complete period and ``{value}_carried``, that of the last
    complete period up to now.

    Defined results: NULL ``complete`` is not complete; readings with a NULL time or outside the
    coverage are left out; a source without coverage, or with a NULL or reversed one, gives no rows,
    one without readings only missing periods; repeated coverage rows of a source span from their
    least ``first`` to their greatest ``last``. Other columns are ignored, whatever their names.
    """
    if step_us < 1 or shard_steps < 1:
        raise ValueError("step_us and shard_steps must be positive")
    ids = ["__id"]
    order = [f"__a{i}" for i in range(len(arrival))]
    vals = [f"__v{i}" for i in range(len(values))]
    shard_us = step_us * shard_steps
    none = F.lit(None)

    spans = coverage.select(pack(keys).alias("__id"), to_us(F.col(first)).alias("__f"), to_us(F.col(last)).alias("__l"))
    spans = spans.groupBy(*ids).agg(F.min("__f").alias("__f"), F.max("__l").alias("__l")).where(F.col("__f") <= F.col("__l"))
    ticks = spans.select(*ids, "__f", "__l", F.explode(F.sequence("__f", "__l", F.lit(step_us).cast("bigint"))).alias("__us"))

    seen = readings.where(F.col(time).isNotNull()).select(
        pack(keys).alias("__id"),
        to_us(F.col(time)).alias("__us"),
        F.coalesce(F.col(complete).cast("boolean"), F.lit(False)).alias("__ok"),
        *[F.col(a).alias(o) for a, o in zip(arrival, order)],
        *[F.col(v).alias(c) for v, c in zip(values, vals)],
    )
    types = dict(seen.dtypes)
    # the tick of a reading may lie in the shard before, at most one step back
    home, before = floor_div(F.col("__us"), shard_us), floor_div(F.col("__us") - F.lit(step_us), shard_us)
    seen = seen.withColumn("__shard", F.explode(F.when(home == before, F.array(home)).otherwise(F.array(home, before))))
    seen = seen.select(*ids, "__shard", "__us", none.cast("bigint").alias("__f"), none.cast("bigint").alias("__l"), "__ok", *order, *vals)
    grid = ticks.select(
        *ids,
        floor_div(F.col("__us"), shard_us).alias("__shard"),
        "__us",
        "__f",
        "__l",
        none.cast("boolean").alias("__ok"),
        *[none.cast(types[c]).alias(c) for c in [*order, *vals]],
    )
    parts = seen.unionByName(grid).repartition(*ids, "__shard")

    whole = W.partitionBy(*ids, "__shard")
    parts = parts.withColumns({"__first": F.max("__f").over(whole), "__end": F.max("__l").over(whole)})
    offset = F.pmod(F.col("__us") - F.col("__first"), F.lit(step_us).cast("bigint"))
    parts = parts.withColumn("__tick", F.col("__us") - offset)
    parts = parts.where(F.col("__tick").between(F.col("__first"), F.col("__end")) & (floor_div(F.col("__tick"), shard_us) == F.col("__shard")))

    # the latest time wins; among its copies the first to arrive
    copies = W.partitionBy(*ids, "__shard", "__tick").orderBy(F.col("__ok").desc_nulls_last(), F.col("__us").desc(), *[F.col(o).asc_nulls_last() for o in order])
    state = F.struct(F.col("__tick").alias("tick"), F.col("__us").alias("us"), *[F.col(c) for c in vals])
    per_tick = (
        parts.withColumn("__rank", F.row_number().over(copies))
        .groupBy(*ids, "__shard", "__tick")
        .agg(F.count("__ok").alias("__n"), F.max_by(F.when(F.col("__ok"), state), F.when(F.col("__ok") & (F.col("__rank") == 1), F.lit(1))).alias("__state"))
    )
    known = F.when(F.col("__state").isNotNull(), F.col("__tick"))
    summaries = per_tick.groupBy(*ids, "__shard").agg(F.max_by("__state", known).alias("__tail"), F.min_by(F.col("__state.tick"), known).alias("__head"))
    carries = carry_scan(summaries, ids, "__shard", {"__before": "__tail"}, {"__after": "__head"})

    filled = per_tick.join(carries, [*ids, "__shard"], "left")
    along = W.partitionBy(*ids, "__shard").orderBy("__tick")
    filled = filled.withColumns(
        {
            "__prev": F.coalesce(F.last("__state", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)), F.col("__before")),
            "__next": F.coalesce(F.first("__state.tick", ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing)), F.col("__after")),
        }
    )
    here = F.coalesce(F.col("__prev.tick") == F.col("__tick"), F.lit(False))
    steps = lambda c: floor_div(c, step_us)
    return filled.select(
        *unpack("__id", keys),
        us_to_ms(F.col("__tick")).alias("tick_ms"),
        (~here).alias("is_missing"),
        F.col("__n").alias("readings"),
        F.when(here, us_to_ms(F.col("__prev.us"))).alias("reading_ms"),
        steps(F.col("__tick") - F.col("__prev.tick")).alias("periods_since_reading"),
        steps(F.col("__next") - F.col("__tick")).alias("periods_to_reading"),
        *[F.when(here, F.col(f"__prev.{c}")).alias(v) for v, c in zip(values, vals)],
        *[F.col(f"__prev.{c}").alias(f"{v}_carried") for v, c in zip(values, vals)],
    )
