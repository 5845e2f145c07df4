"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them.

Time is discretised into exact units of half a microsecond. Every (entity, time shard) has a compressed bitmap of its units,
written as its set runs: sorted pairs ``low, high`` of unit numbers within the shard, as the run containers of compressed
bitmaps are. Bitmaps are united (a logical or) as rows stream by, first in every task before the shuffle, then over the tasks,
so an interval delivered a million times costs one run in the shuffle. The set runs and the clear runs between them are read from
the united bitmaps; a prefix scan over the shards' last set units joins them across shards.

An interval ``[start, end]`` with tolerance ``t`` sets the units from ``2 start`` up to
``2 (end + t)``: the next interval continues the run exactly if it starts at most ``t`` after the
latest end, and leaves a clear unit if it starts a microsecond later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.times import DAY_US, HOUR_US, floor_div, to_us, us_to_ms
from tidewright.operators.scan import carry_scan, pack
from tidewright.session import ship_package

HALF_US = 2
#: Runs that a task holds before it hands its bitmaps on.
RUNS_HELD = 1 << 20
#: Keys as text, to the microsecond.
_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class RunBitmap:
    """A set of units as its runs ``[low, high)``: ascending, disjoint, not touching."""

    __slots__ = ("runs",)

    def __init__(self, runs: np.ndarray):
        self.runs = runs

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> "RunBitmap":
        """The units of any runs."""
        order = np.argsort(low, kind="stable")
        low, reach = low[order], np.maximum.accumulate(high[order])
        opens = np.append(True, low[1:] > reach[:-1])
        return cls(np.column_stack([low[opens], reach[np.append(opens[1:], True)]]))

    def __or__(self, other: "RunBitmap") -> "RunBitmap":
        if len(self.runs) == 1 and self.runs[0, 0] <= other.runs[0, 0] and self.runs[0, 1] >= other.runs[-1, 1]:
            return self
        both = np.concatenate([self.runs, other.runs])
        return RunBitmap.of(both[:, 0], both[:, 1])

    def to_bytes(self) -> bytes:
        return np.ascontiguousarray(self.runs, dtype="<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "RunBitmap":
        return cls(np.frombuffer(data, dtype="<i8").reshape(-1, 2))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals to bitmaps: one row for each entity and shard of a task. The entity is opaque bytes made by the JVM."""
    held: dict[tuple[bytes, int], RunBitmap] = {}
    runs = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array([b.to_bytes() for b in held.values()], pa.binary())], ["__id", "__shard", "__bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("__id").dictionary_encode()
        code, shard = ids.indices.to_numpy(zero_copy_only=False), batch.column("__shard").to_numpy()
        low, high = batch.column("__low").to_numpy(), batch.column("__high").to_numpy()
        order = np.lexsort((shard, code))
        code, shard, low, high = code[order], shard[order], low[order], high[order]
        edges = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])))
        names = ids.dictionary.to_pylist()
        for a, b in zip(edges, np.append(edges[1:], len(code))):
            key, one = (names[code[a]], int(shard[a])), RunBitmap.of(low[a:b], high[a:b])
            known = held.get(key)
            held[key] = one if known is None else known | one
            runs += len(held[key].runs) - (0 if known is None else len(known.runs))
        if runs > RUNS_HELD:
            yield flush()
            held, runs = {}, 0
    if held:
        yield flush()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by entity and shard to the set runs of their union; one bitmap is held at a time."""
    runs = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def emit(done: list[tuple[tuple[str, int], RunBitmap]]) -> pa.RecordBatch:
        every = np.concatenate([b.runs for _, b in done])
        offsets = np.cumsum([0, *[len(b.runs) for _, b in done]]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["low", "high"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(runs)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.string()), pa.array([k[1] for k, _ in done], pa.int64()), lists], ["__id", "__shard", "__runs"])

    key, bits, done, held = None, None, [], 0
    for batch in batches:
        for i, s, b in zip(*[batch.column(c).to_pylist() for c in ("__id", "__shard", "__bits")]):
            one = RunBitmap.from_bytes(b)
            if (i, s) == key:
                bits = bits | one
                continue
            if key is not None:
                done.append((key, bits))
                held += len(bits.runs)
            if held > RUNS_HELD or len(done) >= 4096:
                yield emit(done)
                done, held = [], 0
            key, bits = (i, s), one
    if key is not None:
        yield emit([*done, (key, bits)])


def set_runs(intervals: DataFrame, keys: Sequence[str], start: str, end: str, tolerance_us: int, shard_us: int = 64 * DAY_US) -> DataFrame:
    """The set runs of every (entity, shard): ``__id`` (the keys as text), ``__shard``, ``__low``, ``__high`` (absolute units), and
    ``__prev``, the end of the set run before it in the entity, whichever shard that is in."""
    if tolerance_us < 0:
        raise ValueError("the tolerance must not be negative")
    ship_package(intervals.sparkSession)
    unit = shard_us * HALF_US
    span = lambda c: to_us(F.col(c)) * F.lit(HALF_US)
    good = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))
    # Python sees an entity as the text of its keys only, NULLs included, so no key changes its type on the way
    pieces = intervals.where(good).select(
        F.to_json(pack(keys), {"ignoreNullFields": "false", **_TEXT}).alias("__id"),
        span(start).alias("__a"),
        (span(end) + F.lit(HALF_US * tolerance_us + 1).cast("bigint")).alias("__b"),
    )
    first, final = floor_div(F.col("__a"), unit), floor_div(F.col("__b") - 1, unit)
    pieces = pieces.withColumn("__shard", F.explode(F.sequence(first, final)))
    floor = F.col("__shard") * F.lit(unit).cast("bigint")
    pieces = pieces.select(
        "__id",
        "__shard",
        (F.greatest(F.col("__a"), floor) - floor).alias("__low"),
        (F.least(F.col("__b"), floor + F.lit(unit).cast("bigint")) - floor).alias("__high"),
    )
    bitmaps = pieces.mapInArrow(_bitmaps, "__id string, __shard bigint, __bits binary")
    sorted_bits = bitmaps.repartition("__id", "__shard").sortWithinPartitions("__id", "__shard")
    united = sorted_bits.mapInArrow(_united, "__id string, __shard bigint, __runs array<struct<low: bigint, high: bigint>>")
    united = united.repartition("__id", "__shard")  # the runs are read twice below and united once

    ends = united.select("__id", "__shard", (F.element_at("__runs", -1)["high"] + floor).alias("__end"))
    carried = carry_scan(ends, ["__id"], "__shard", {"__before": "__end"})
    joined = united.join(carried, ["__id", "__shard"], "left")
    before = F.concat(F.array(F.col("__before") - floor), F.transform("__runs", lambda r: r["high"]))
    each = F.explode(F.zip_with("__runs", F.slice(before, F.lit(1), F.size("__runs")), lambda r, p: F.struct(r["low"].alias("low"), r["high"].alias("high"), p.alias("prev")))).alias("r")
    runs = joined.select("__id", "__shard", each)
    return runs.select("__id", "__shard", *[(F.col(f"r.{c}") + floor).alias(f"__{c}") for c in ("low", "high", "prev")])


def _keys(intervals: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys of ``__id`` in their own types."""
    kind = intervals.select(pack(keys).alias("k")).schema["k"].dataType
    named = F.from_json("__id", kind, _TEXT)
    return [named.getField(f"f{i}").alias(k) for i, k in enumerate(keys)]


def interval_gaps(intervals: DataFrame, keys: Sequence[str], start: str, end: str, tolerance_us: int = 6 * HOUR_US, shard_us: int = 64 * DAY_US) -> DataFrame:
    """Each gap between two successive continuous periods of an entity: the clear runs between set runs.

    Returns the keys, ``period_end_ms`` (latest end of the earlier period) and ``next_start_ms``
    (first start of the later one). Defined results: rows with a NULL bound or an end before the start are
    left out; NULL keys are an entity like any other; repeated rows change nothing; an empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    runs = set_runs(intervals, keys, start, end, tolerance_us, shard_us)
    gaps = runs.where(F.col("__prev") < F.col("__low"))
    ended = floor_div(F.col("__prev") - 1, HALF_US) - F.lit(tolerance_us)
    return gaps.select(
        *_keys(intervals, keys),
        us_to_ms(ended).alias("period_end_ms"),
        us_to_ms(floor_div(F.col("__low"), HALF_US)).alias("next_start_ms"),
    )


def interval_periods(intervals: DataFrame, keys: Sequence[str], start: str, end: str, tolerance_us: int = 6 * HOUR_US, shard_us: int = 64 * DAY_US) -> DataFrame:
    """The continuous periods of each entity: keys, ``period_start_ms``, ``period_end_ms``; cases as in ``interval_gaps``."""
    runs = set_runs(intervals, keys, start, end, tolerance_us, shard_us)
    fresh = F.col("__prev").isNull() | (F.col("__prev") < F.col("__low"))
    runs = runs.withColumn("__start", F.when(fresh, F.col("__low")))
    heads = runs.groupBy("__id", "__shard").agg(F.max("__start").alias("__head"))
    carried = carry_scan(heads, ["__id"], "__shard", {"__open": "__head"})
    order = W.partitionBy("__id", "__shard").orderBy("__low").rowsBetween(W.unboundedPreceding, 0)
    joined = runs.join(carried, ["__id", "__shard"], "left")
    joined = joined.withColumn("__from", F.coalesce(F.last("__start", ignorenulls=True).over(order), F.col("__open")))
    periods = joined.groupBy("__id", "__from").agg(F.max("__high").alias("__high"))
    return periods.select(
        *_keys(intervals, keys),
        us_to_ms(floor_div(F.col("__from"), HALF_US)).alias("period_start_ms"),
        us_to_ms(floor_div(F.col("__high") - 1, HALF_US) - F.lit(tolerance_us)).alias("period_end_ms"),
    )
