"""Null-safe joins on keys, and the prefix scan of carry states over the shards of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; columns of ``right`` besides the keys are added."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def pack(keys: Sequence[str]) -> Column:
    """The keys of an entity as one column that is never NULL: structs of equal fields are equal, NULLs included.

    Plain joins on it keep the partitioning of earlier steps, which null-safe ones on the fields would not.
    """
    return F.struct(*[F.col(k).alias(f"f{i}") for i, k in enumerate(keys)])


def unpack(packed: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(packed).getField(f"f{i}").alias(k) for i, k in enumerate(keys)]


def carry_scan(summaries: DataFrame, keys: Sequence[str], shard: str, before: dict[str, str], after: dict[str, str] | None = None, block: int = 1024) -> DataFrame:
    """For each (keys, shard) the nearest non-null states of the other shards of the same keys.

    ``before`` maps a name to the state to look for in earlier shards, ``after`` in later ones. ``summaries`` has one row
    per (keys, shard), keys without NULLs. The scan has two levels, blocks of ``block`` shards and shards within a block,
    so no task has to hold all shards of one long entity. Returns keys, shard and the names.
    """
    after = after or {}
    names = [*before, *after]
    state = {n: f"__x{i}" for i, n in enumerate(names)}
    s = summaries.select(*keys, F.col(shard), *[F.col(c).alias(state[n]) for n, c in {**before, **after}.items()])
    s = s.withColumn("__block", F.floor(F.col(shard) / F.lit(block)).cast("bigint"))

    def nearest(n: str, window) -> Column:
        if n in before:
            return F.last(state[n], ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))
        return F.first(state[n], ignorenulls=True).over(window.rowsBetween(1, W.unboundedFollowing))

    local = s.withColumns({f"__in{n}": nearest(n, W.partitionBy(*keys, "__block").orderBy(shard)) for n in names})
    pick = lambda n: (F.max_by if n in before else F.min_by)(state[n], F.when(F.col(state[n]).isNotNull(), F.col(shard)))
    blocks = s.groupBy(*keys, "__block").agg(*[pick(n).alias(state[n]) for n in names])
    blocks = blocks.select(*keys, "__block", *[nearest(n, W.partitionBy(*keys).orderBy("__block")).alias(f"__out{n}") for n in names])
    joined = local.join(blocks, [*keys, "__block"], "left")
    return joined.select(*keys, shard, *[F.coalesce(f"__in{n}", f"__out{n}").alias(n) for n in names])
