"""Percentiles of very large numeric columns by radix selection over mergeable summaries.

Values become 64-bit integers of the same order (``functions.keys``), read as successive digits: 12 bits (sign and exponent),
then 4 and 8 bits of the mantissa. The summary of a part (a day, a partition, a batch) is a set of histograms: one of the
first digit of all its values, and of each following digit only within those prefixes that hold a target rank of
the part itself or of all parts together. Histograms are bounded (at most 4,096, 16 and 256 counts) and so is their
number (one for each target of a level), however many values a part has.

Summaries are combined by adding counts of equal digits. A percentile of any set of parts is found by walking down from the first
digit as long as the digit that holds the rank was followed in all parts that have values there; the digits reached give
its error, which is stated beside it. For single parts and for all parts together every digit was followed, and
the stated error of an order statistic is 2**-13 of its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.keys import key_value, with_ordered_key
from tidewright.operators.radix import BROADCAST_ROWS, KEY_BITS, SALTS, quantile_name
from tidewright.operators.scan import join_on
from tidewright.session import cut_lineage

#: Bits of the digits, first to last.
DIGITS = (12, 4, 8)
_INFINITY = 2047 << 52
_RESERVED = {"level", "prefix", "digits", "n", "n_values", "scope", "histogram", "relative_error"}


def _lead(key: Column, bits: int) -> Column:
    """The first ``bits`` bits, towards zero, so that buckets of negative values mirror those of positive ones."""
    return F.call_function("div", key, F.lit(1 << (KEY_BITS - bits)).cast("bigint"))


def _widths(digits: Sequence[int]) -> list[int]:
    """Leading bits known after each digit."""
    return [sum(digits[: i + 1]) for i in range(len(digits))]


def stated_error(bits: Column | int) -> Column:
    """Relative error of an order statistic of which that many leading bits are known: of the midpoint of its bucket."""
    return F.pow(F.lit(2.0), F.lit(11) - (bits if isinstance(bits, Column) else F.lit(bits)))


def _targets(total: Column, quantiles: Sequence[float]) -> Column:
    """The ranks, from 0, of the order statistics on both sides of each quantile."""
    each = []
    for i, q in enumerate(quantiles):
        low = F.floor((total - 1) * F.lit(float(q))).cast("bigint")
        each += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), F.least(low + s, total - 1).alias("rank")) for s in (0, 1)]
    return F.array(*each)


def _within(targets: Column, before: Column, n: Column) -> Column:
    """The targets among the ``n`` values that ``before`` values precede, their ranks counted from these."""
    kept = F.filter(targets, lambda t: (t["rank"] >= before) & (t["rank"] < before + n))
    return F.transform(kept, lambda t: F.struct(t["i"].alias("i"), t["side"].alias("side"), (t["rank"] - before).alias("rank")))


def _start(counts: DataFrame, groups: Sequence[str], quantiles: Sequence[float], bits: int) -> DataFrame:
    """Buckets of the first digit that hold a target: groups, ``n_values``, ``at`` (the digit), ``n``, ``targets``, ``bits``."""
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))  # at most 4,096 rows for each group
    counts = counts.withColumns({"n_values": F.sum("n").over(whole), "__before": F.sum("n").over(whole.orderBy(F.col("digits").asc_nulls_first())) - F.col("n")})
    inside = _within(_targets(F.col("n_values"), quantiles), F.col("__before"), F.col("n"))
    hits = counts.select(*groups, "n_values", F.col("digits").alias("at"), "n", inside.alias("targets"), F.lit(bits).alias("bits"))
    return hits.where((F.size("targets") > 0) | (F.col("n_values") == 0))


def _descend(hits: DataFrame, counts: DataFrame, groups: Sequence[str], bits: int) -> DataFrame:
    """One digit further down wherever the counts of the next digit make up the whole bucket; elsewhere a hit stays as it is."""
    inner = W.partitionBy(*groups, "prefix")
    order = inner.orderBy("digits")
    children = counts.select(
        *groups, F.col("prefix").alias("at"), "digits", F.col("n").alias("__n"), (F.sum("n").over(order) - F.col("n")).alias("__before"), F.sum("n").over(inner).alias("__all"), F.row_number().over(order).alias("__no")
    )
    both = join_on(hits, children, [*groups, "at"], "left")
    whole = F.coalesce(F.col("__all") == F.col("n"), F.lit(False))
    inside = F.when(whole, _within(F.col("targets"), F.col("__before"), F.col("__n"))).otherwise(F.col("targets"))
    moved = both.select(
        *groups,
        "n_values",
        F.when(whole, F.col("digits")).otherwise(F.col("at")).alias("at"),
        F.when(whole, F.col("__n")).otherwise(F.col("n")).alias("n"),
        inside.alias("targets"),
        F.when(whole, F.lit(bits)).otherwise(F.col("bits")).alias("bits"),
        (whole | (F.coalesce("__no", F.lit(1)) == 1)).alias("__kept"),
    )
    return moved.where(F.col("__kept") & ((F.size("targets") > 0) | (F.col("n_values") == 0))).drop("__kept")


def _scoped(counts: DataFrame, groups: Sequence[str], part: str) -> DataFrame:
    """Counts of every part (scope 'part') and, added up, of all parts (scope 'all', part NULL)."""
    every = counts.groupBy(*groups, "prefix", "digits").agg(F.sum("n").alias("n"))
    every = every.withColumns({"scope": F.lit("all"), part: F.lit(None).cast(dict(counts.dtypes)[part])})
    return counts.select(*groups, "prefix", "digits", "n", F.lit("part").alias("scope"), part).unionByName(every)


def part_summaries(values: DataFrame, groups: Sequence[str], part: str, value: str, quantiles: Sequence[float], digits: Sequence[int] = DIGITS) -> DataFrame:
    """The summaries of all parts in long form: ``groups``, ``part``, ``level`` (1 is the first digit), ``prefix`` (leading bits of
    the digits before; NULL at level 1), ``digits`` (leading bits with this digit) and ``n``.

    One pass over the values for each digit; every pass counts on the map side before its shuffle. The prefixes to follow
    (two for each quantile, part and scope at most) are sent to all tasks if their counted rows allow it and meet the values in a
    salted shuffle otherwise. Defined results: NULL and NaN values do not count; a part whose values are all
    of these has one row of level 1 with NULL digits and n = 0; NULLs in groups and parts are values like any other.
    """
    if taken := _RESERVED & {*groups, part}:
        raise ValueError(f"groups may not be named {', '.join(sorted(taken))}")
    if digits[0] != 12 or sum(digits) > KEY_BITS or min(digits) < 1:
        raise ValueError("the first digit has 12 bits, all of them at most 64")
    by, scoped = [*groups, part], ["scope", *groups, part]
    keyed = with_ordered_key(values.select(*by, F.col(value).alias("__value")), "__value", "__key").drop("__value")
    none = F.lit(None).cast("bigint")
    widths = _widths(digits)
    counts = keyed.groupBy(*by, _lead(F.col("__key"), widths[0]).alias("digits")).agg(F.count("__key").alias("n"))
    levels = [cut_lineage(counts.select(*by, F.lit(1).alias("level"), none.alias("prefix"), "digits", "n"))]
    hits = _start(_scoped(levels[0], groups, part), scoped, quantiles, widths[0])
    parts = levels[0].select(*by).distinct()
    for level, (known, bits) in enumerate(zip(widths, widths[1:]), 2):
        hits = cut_lineage(hits)
        own = hits.where("scope = 'part' and n_values > 0").select(*by, "at")
        shared = join_on(parts, hits.where("scope = 'all' and n_values > 0").select(*groups, "at"), groups, "inner") if groups else parts.crossJoin(F.broadcast(hits.where("scope = 'all' and n_values > 0").select("at")))  # a row for each target
        followed = own.unionByName(shared.select(*by, "at")).groupBy(*by).agg(F.collect_set("at").alias("__followed"))  # four for each quantile at most
        followed = cut_lineage(followed)
        rows = keyed.withColumn("prefix", _lead(F.col("__key"), known))
        if followed.count() <= BROADCAST_ROWS:
            rows = join_on(rows, F.broadcast(followed), by, "inner")
        else:
            salted = followed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            rows = join_on(rows, salted, [*by, "__salt"], "inner")
        # a filter on the prefix would be pushed below the steps that make the key, and make it several times over
        held = F.array_contains("__followed", F.col("prefix"))
        rows = rows.select(*by, F.when(held, F.col("prefix")).alias("prefix"), F.when(held, _lead(F.col("__key"), bits)).alias("digits"))
        counts = rows.groupBy(*by, "prefix", "digits").agg(F.count("digits").alias("n")).where("n > 0")
        levels.append(cut_lineage(counts.select(*by, F.lit(level).alias("level"), "prefix", "digits", "n")))
        if level < len(widths):
            hits = _descend(hits, _scoped(levels[-1], groups, part), scoped, bits)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def packed(summaries: DataFrame, groups: Sequence[str], part: str) -> DataFrame:
    """Summaries as they are stored: one row for each histogram, its counts in order of their digits."""
    by = [*groups, part, "level", "prefix"]
    return summaries.groupBy(*by).agg(F.sum("n").alias("n_values"), F.array_sort(F.collect_list(F.struct("digits", "n"))).alias("histogram"))


def unpacked(stored: DataFrame, groups: Sequence[str], part: str) -> DataFrame:
    by = [*groups, part, "level", "prefix"]
    return stored.select(*by, F.explode("histogram").alias("__h")).select(*by, "__h.digits", "__h.n")


def summary_percentiles(summaries: DataFrame, groups: Sequence[str], quantiles: Sequence[float], digits: Sequence[int] = DIGITS) -> DataFrame:
    """Percentiles per group over all summaries of it: ``groups``, ``n_values``, ``q01`` ..., ``q01_error`` ..., ``relative_error``.

    Add a day to ``groups`` for those of single days. Each order statistic is the midpoint of its bucket; a percentile interpolates
    linearly between the two around it, and its ``_error`` is what that can be off at most; ``relative_error`` is the greatest
    stated error of an order statistic relative to its size. Defined results: a group without values has n_values 0
    and NULLs; -0.0 counts as 0.0 and is exact; infinities are the extreme values; subnormal numbers have the
    error of their bucket's width.
    """
    counts = summaries.groupBy(*groups, "level", "prefix", "digits").agg(F.sum("n").alias("n"))
    widths = _widths(digits)
    hits = _start(counts.where("level = 1"), groups, quantiles, widths[0])
    for level, bits in enumerate(widths[1:], 2):
        hits = _descend(hits, counts.where(F.col("level") == level), groups, bits)
    size = F.abs("at")
    least, span = (F.coalesce(*[F.when(F.col("bits") == b, f(KEY_BITS - b)) for b in widths]) for f in (lambda rest: F.shiftleft(size, rest), lambda rest: F.lit((1 << rest) - 1).cast("bigint")))
    most = F.least(least + span, F.lit(_INFINITY).cast("bigint"))
    hits = hits.withColumns({"__least": least, "__most": most})
    hits = hits.withColumns({"__a": key_value(F.col("__least")), "__b": key_value(F.col("__most"))})
    zero = F.col("at") == 0
    middle = F.when(zero, F.lit(0.0)).otherwise(F.col("__a") / 2 + F.col("__b") / 2)
    error = F.when(F.col("__b") == float("inf"), F.lit(0.0)).when(zero, F.col("__b")).otherwise(F.col("__b") / 2 - F.col("__a") / 2)
    single = hits.select(*groups, "n_values", F.explode_outer("targets").alias("__t"), F.when(F.col("at") < 0, -middle).otherwise(middle).alias("__x"), error.alias("__e"), F.when(F.col("n_values") > 0, stated_error(F.col("bits"))).alias("__r"))
    pick = lambda c, i, side: F.max(F.when((F.col("__t.i") == i) & (F.col("__t.side") == side), F.col(c)))
    picked = [pick(c, i, side).alias(f"{c}{i}_{side}") for c in ("__x", "__e") for i in range(len(quantiles)) for side in (0, 1)]
    wide = single.groupBy(*groups).agg(F.max("n_values").alias("n_values"), F.max("__r").alias("relative_error"), *picked)
    out = []
    for i, q in enumerate(quantiles):
        at = (F.col("n_values") - 1) * F.lit(float(q))
        share = at - F.floor(at)
        between = lambda c: F.when(F.col(f"{c}{i}_0") == F.col(f"{c}{i}_1"), F.col(f"{c}{i}_0")).otherwise(F.col(f"{c}{i}_0") + (F.col(f"{c}{i}_1") - F.col(f"{c}{i}_0")) * share)  # noqa: E731, B023
        out += [between("__x").alias(quantile_name(q)), between("__e").alias(f"{quantile_name(q)}_error")]
    return wide.select(*groups, "n_values", *out, "relative_error")
