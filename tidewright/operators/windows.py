"""Sliding condition and target windows, their features, purged temporal splits and training-only normalisation.

A window is known at the last tick of its condition: frames look back ``c`` ticks for the condition and forward
``t`` ticks for the target, so no arrays are built and all frames share one sort. Entities are cut into shards of ticks; the
ticks within reach of a shard's frames are copied into it, so a long entity is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.times import floor_div
from tidewright.operators.scan import join_on

SPLITS = ("train", "purge_train_validation", "validation", "purge_validation_test", "test")
#: Ticks of an entity that are framed in one task.
SHARD_TICKS = 4_096


def sharded(rows: DataFrame, entity: str, before: int, after: int, position: str = "tick_no") -> DataFrame:
    """Rows by (entity, ``__shard``), each shard with ``before`` and ``after`` more positions; ``at_home`` tells its own."""
    at = F.col(position)
    shards = F.sequence(floor_div(at - after, SHARD_TICKS), floor_div(at + before, SHARD_TICKS))
    return rows.withColumn("__shard", F.explode(shards)).repartition(entity, "__shard")


def at_home(position: str = "tick_no") -> Column:
    return floor_div(F.col(position), SHARD_TICKS) == F.col("__shard")


def frames(entity: str, position: str = "tick_no"):
    """The window of an entity's shard; used by the columns that callers add to ``candidate_windows``."""
    return W.partitionBy(entity, "__shard").orderBy(position)


def numbered(rows: DataFrame, entity: str, position: str, out: str, spans: Sequence[str] = ()) -> DataFrame:
    """Dense numbers from 0 within each entity by position, from counts per shard and ranks within it.

    ``spans`` names columns whose least and greatest value in the entity are added as ``{column}_least`` and ``{column}_most``.
    """
    rows = rows.withColumn("__b", floor_div(F.col(position), SHARD_TICKS))
    whole = W.partitionBy(entity)
    earlier = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ends = [(f"{c}_{n}", f) for c in spans for n, f in (("least", F.min), ("most", F.max))]
    found = [f(c).alias(f"{c}_{n}") for c in spans for n, f in (("least", F.min), ("most", F.max))]
    counts = rows.groupBy(entity, "__b").agg(F.count(F.lit(1)).alias("__n"), *found)
    counts = counts.select(entity, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), *[f(n).over(whole).alias(n) for n, f in ends])
    number = F.col("__base") + F.row_number().over(W.partitionBy(entity, "__b").orderBy(position)) - 1
    return rows.join(counts, [entity, "__b"]).withColumn(out, number.cast("bigint")).drop("__b", "__base")


def candidate_windows(returns: DataFrame, entity: str, c: int, t: int, stride: int = 1, extra: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """Every window that fits into the calendar of its entity, with the validity of both parts.

    ``extra`` columns are evaluated at the last tick of the condition, over ``frames`` that reach ``c`` ticks back and ``t`` ahead;
    ``first`` columns come before them. Rows without an entity are left out.
    """
    if min(c, t, stride) < 1:
        raise ValueError("window lengths and stride must be positive")
    along = frames(entity)
    ok = F.col("returns_valid").cast("int")
    if "calendar_ticks" not in returns.columns:
        ends = returns.groupBy(entity).agg((F.max("tick_no") + 1).alias("calendar_ticks"))
        returns = returns.join(ends, entity)
    rows = sharded(returns, entity, c, t).withColumns(first or {})
    rows = rows.withColumns(
        {
            "start_index": F.col("tick_no") - (c - 1),
            "condition_valid": F.sum(ok).over(along.rowsBetween(1 - c, 0)) == c,
            "target_valid": F.coalesce(F.sum(ok).over(along.rowsBetween(1, t)) == t, F.lit(False)),
            "condition_start_ms": F.first("tick_ms").over(along.rowsBetween(1 - c, 0)),
            "condition_end_ms": F.col("tick_ms"),
            "target_start_ms": F.first("tick_ms").over(along.rowsBetween(1, t)),
            "target_end_ms": F.last("tick_ms").over(along.rowsBetween(1, t)),
            **(extra or {}),
        }
    )
    fits = (F.col("start_index") >= 0) & (F.col("tick_no") + t < F.col("calendar_ticks")) & (F.col("start_index") % stride == 0)
    names = ["start_index", "condition_start_ms", "condition_end_ms", "target_start_ms", "target_end_ms", "condition_valid", "target_valid"]
    return rows.where(fits & at_home()).select(entity, *names, *(extra or {}))


def window_index(candidates: DataFrame, entity: str, spans: Sequence[str] = ()) -> DataFrame:
    """The accepted windows with their dense number within the entity."""
    ok = candidates.where(F.col("condition_valid") & F.col("target_valid")).drop("condition_valid", "target_valid")
    return numbered(ok, entity, "start_index", "sample_id", spans)


def window_audit(candidates: DataFrame, entity: str) -> DataFrame:
    a, b = F.col("condition_valid"), F.col("target_valid")
    return candidates.groupBy(entity).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(a & b).alias("accepted"),
        F.count_if(~a & b).alias("rejected_condition"),
        F.count_if(a & ~b).alias("rejected_target"),
        F.count_if(~a & ~b).alias("rejected_both"),
    )


def non_overlapping(index: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th accepted window of an entity."""
    return index.where(F.col("sample_id") % every == 0)


def feature_columns(entity: str, assets: Sequence[str], c: int, volume_steps: int, correlation_steps: int, periods_per_year: float) -> dict[str, Column]:
    """The market-state features at the last tick of a condition of ``c`` steps: six per asset and two joint ones."""
    if correlation_steps > c or 2 * volume_steps > c:
        raise ValueError("the condition is too short for its features")
    along = frames(entity)
    whole, recent = along.rowsBetween(1 - c, 0), along.rowsBetween(1 - volume_steps, 0)
    earlier = along.rowsBetween(1 - 2 * volume_steps, -volume_steps)
    out, sums, deviations = {}, [], []
    for a in assets:
        r, v = F.col(f"{a}_log_return"), F.log1p(F.col(f"{a}_volume"))
        level = F.col(f"__s_{a}")
        sd, sdv = F.coalesce(F.stddev_samp(r).over(whole), F.lit(0.0)), F.coalesce(F.stddev_samp(v).over(whole), F.lit(0.0))
        lately = F.avg(v).over(recent)
        out |= {
            f"{a}_cumulative_log_return": F.sum(r).over(whole),
            f"{a}_realized_volatility_ann": sd * float(periods_per_year) ** 0.5,
            f"{a}_current_drawdown": F.exp(level - F.max(level).over(along.rowsBetween(-c, 0))) - 1,
            f"{a}_log_volume_z": F.when(sdv > 0, (lately - F.avg(v).over(whole)) / sdv).otherwise(F.lit(0.0)),
            f"{a}_log_volume_change": lately - F.avg(v).over(earlier),
            f"{a}_mean_log_range": F.avg(F.ln(F.col(f"{a}_high") / F.col(f"{a}_low"))).over(recent),
        }
        sums.append(F.sum(r).over(whole))
        deviations.append(sd)
    x, y = (F.col(f"{a}_log_return") for a in assets)
    near = along.rowsBetween(1 - correlation_steps, 0)
    out["correlation"] = F.try_divide(F.covar_samp(x, y).over(near), F.stddev_samp(x).over(near) * F.stddev_samp(y).over(near))
    out["joint_trend_regime_score"] = F.try_divide((sums[0] + sums[1]) / 2, (deviations[0] + deviations[1]) / 2 * float(c) ** 0.5)
    return out


def condition_features(returns: DataFrame, entity: str, assets: Sequence[str], c: int, t: int, volume_steps: int, correlation_steps: int, periods_per_year: float, spans: Sequence[str] = ()) -> DataFrame:
    """Accepted windows with the features of their condition."""
    # a drawdown only compares levels within its window, so each shard adds up from its own start
    along = frames(entity).rowsBetween(W.unboundedPreceding, 0)
    levels = {f"__s_{a}": F.sum(F.coalesce(F.col(f"{a}_log_return"), F.lit(0.0))).over(along) for a in assets}
    features = feature_columns(entity, assets, c, volume_steps, correlation_steps, periods_per_year)
    return window_index(candidate_windows(returns, entity, c, t, 1, features, levels), entity, spans)


def assign_split(index: DataFrame, cuts: Sequence[Column]) -> DataFrame:
    """The split of each window by its target start: four ascending cuts (milliseconds), half-open."""
    at = F.col("target_start_ms")
    split = F.lit(SPLITS[4])
    for cut, name in reversed(list(zip(cuts, SPLITS))):
        split = F.when(at < cut, F.lit(name)).otherwise(split)
    return index.withColumn("split", split)


def check_cuts(cuts_ms: Sequence[int], minimum_purge_ms: int, span_ms: int) -> None:
    """Cuts must ascend and each purge must be as long as asked for and as a whole window."""
    a, b, c, d = cuts_ms
    if not a < b < c < d:
        raise ValueError("the cuts must ascend")
    if min(b - a, d - c) < max(minimum_purge_ms, span_ms):
        raise ValueError("a purge is too short")


def split_separation(split: DataFrame, entity: str) -> DataFrame:
    """Each pair of successive parts of an entity: milliseconds from the last target of the earlier to the first condition of the
    later (``gap_ms``), and whether they are ``separate`` (the gap is above 0). Parts without windows are passed over."""
    order = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    kept = split.where(F.col("split").isin("train", "validation", "test"))
    ends = kept.groupBy(entity, "split").agg(F.min("condition_start_ms").alias("__a"), F.max("target_end_ms").alias("__b"))
    along = W.partitionBy(entity).orderBy(order)  # three rows at most
    pairs = ends.select(entity, F.lag("split").over(along).alias("earlier"), F.col("split").alias("later"), (F.col("__a") - F.lag("__b").over(along)).alias("gap_ms"))
    return pairs.where("earlier is not null").withColumn("separate", F.col("gap_ms") > 0)


def split_audit(split: DataFrame, entity: str) -> DataFrame:
    """Windows, share, first condition and last target of each split."""
    n = F.count(F.lit(1))
    by = split.groupBy(entity, "split").agg(n.alias("windows"), F.min("condition_start_ms").alias("first_condition_ms"), F.max("target_end_ms").alias("last_target_ms"))
    return by.withColumn("share", F.col("windows") / F.sum("windows").over(W.partitionBy(entity)))


def mark_covered(returns: DataFrame, split: DataFrame, entity: str, c: int, t: int, name: str = "train") -> DataFrame:
    """Adds ``covered``: whether a tick lies in at least one window of a split."""
    starts = split.where(F.col("split") == name).select(entity, F.col("start_index").alias("tick_no"), F.lit(1).alias("__starts"))
    rows = sharded(returns.join(starts, [entity, "tick_no"], "left"), entity, c + t - 1, 0)
    covered = F.max("__starts").over(frames(entity).rowsBetween(1 - c - t, 0)) == 1
    return rows.withColumn("covered", F.coalesce(covered, F.lit(False))).where(at_home()).drop("__starts", "__shard")


def covered_returns(returns: DataFrame, split: DataFrame, entity: str, c: int, t: int, name: str = "train") -> DataFrame:
    """The ticks that lie in at least one window of a split, each once however many windows overlap there."""
    return mark_covered(returns, split, entity, c, t, name).where("covered").drop("covered")


def zscore_fit(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and scale (population deviation, 1 where that is 0) of each column, in long form."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")
    fit = rows.select(*groups, each).groupBy(*groups, F.col("f.column").alias("column"))
    fit = fit.agg(F.avg("f.x").alias("mean"), F.stddev_pop("f.x").alias("sd"), F.count("f.x").alias("n"))
    flat = F.col("sd") == 0
    return fit.select(*groups, "column", "n", "mean", F.when(flat, F.lit(1.0)).otherwise(F.col("sd")).alias("scale"), flat.alias("zero_variance"))


def zscore_apply(rows: DataFrame, fit: DataFrame, groups: Sequence[str], ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Standardised values in long form; nothing is clipped."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")
    long = rows.select(*dict.fromkeys([*groups, *ids]), each).select("*", F.col("f.column").alias("column"), F.col("f.x").alias("x")).drop("f")
    joined = join_on(long, fit.select(*groups, "column", "mean", "scale"), [*groups, "column"])
    return joined.withColumn("z", (F.col("x") - F.col("mean")) / F.col("scale"))


def zscore_invert(scaled: DataFrame, fit: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The inverse of ``zscore_apply``: adds ``value`` to the standardised values ``z`` in long form."""
    joined = join_on(scaled, fit.select(*groups, "column", F.col("mean").alias("__mean"), F.col("scale").alias("__scale")), [*groups, "column"])
    return joined.withColumn("value", F.col("z") * F.col("__scale") + F.col("__mean")).drop("__mean", "__scale")
