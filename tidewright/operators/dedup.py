"""Messages delivered at least once: keep one copy of each.

Rows are partitioned by the message identifier and ranked by arrival, with a deterministic tie-break;
the first stays. The rank filter limits each group to one row already on the map side, so a message
delivered millions of times costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.scan import join_on
from tidewright.session import FEW_ROWS, cut_lineage


_RANK, _CANONICAL, _LISTED = "__dedup_rank", "__dedup_canonical", "__dedup_listed"


def _identified(rows: DataFrame, identifier: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in identifier:
        known = known & F.col(c).isNotNull()
    return known


def keep_first(rows: DataFrame, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One copy of each message: the first by ``arrival`` (NULLs last). All columns stay.

    Defined results: a row whose identifier has a NULL part cannot be told to be a copy and is kept;
    of rows that tie in every arrival column one stays; an empty table stays empty.
    """
    known = _identified(rows, identifier)
    order = W.partitionBy(*identifier).orderBy(*[F.col(a).asc_nulls_last() for a in arrival])
    ranked = rows.where(known).withColumn(_RANK, F.row_number().over(order))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK).unionByName(rows.where(~known))


def further_copies(rows: DataFrame, identifier: Sequence[str], arrival: Sequence[str], row_id: str) -> DataFrame:
    """The rows that ``keep_first`` removes, found without gathering the copies of one message in a task:
    rows whose ``row_id`` is not among those kept. Rows that share a ``row_id`` are one row. Returns ``row_id``."""
    known = rows.where(_identified(rows, identifier) & F.col(row_id).isNotNull())
    needed = list(dict.fromkeys([*identifier, *arrival, row_id]))
    kept = keep_first(known.select(*needed), identifier, [*arrival, row_id]).select(row_id)
    return join_on(known.select(row_id).distinct(), kept, [row_id], "left_anti")


def accept_batch(batch: DataFrame, stored: DataFrame, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The rows of a new batch that are to be stored: its first copies whose identifier is not stored yet.

    Rows whose identifier has a NULL part are accepted, as in ``keep_first``. The first copies of the batch are written once;
    if their counted identifiers allow it, the store is cut to those before its identifiers are shuffled, so a small
    batch costs a scan of the store and no more. The identifiers of either side are distinct in the anti-join.
    """
    fresh = keep_first(batch, identifier, arrival)
    if not identifier:
        return fresh
    fresh = cut_lineage(fresh)
    asked, known = fresh.select(*identifier), stored.select(*identifier)
    if asked.count() <= FEW_ROWS:
        known = join_on(known, F.broadcast(asked), list(identifier), "left_semi")
    return join_on(fresh, known.distinct(), list(identifier), "left_anti")


def canonical_symbol(spelling: Column) -> Column:
    """A symbol without separators and in capitals: ``btc/usdt`` and ``BTC-USDT`` are ``BTCUSDT``."""
    return F.regexp_replace(F.upper(spelling), "[^0-9A-Z]", "")


def resolve_symbols(rows: DataFrame, instruments: DataFrame, spelling: str, out: str) -> DataFrame:
    """Adds the instrument that a spelling stands for; spellings of no listed instrument keep their canonical form.

    The list of instruments joins by its canonical form, of which the least symbol counts. Spark broadcasts it
    if it is small; a spelling that is in canonical form already resolves to the same group either way.
    """
    listed = instruments.where(F.col("symbol").isNotNull()).groupBy(canonical_symbol(F.col("symbol")).alias(_CANONICAL)).agg(F.min("symbol").alias(_LISTED))
    joined = rows.withColumn(_CANONICAL, canonical_symbol(F.col(spelling))).join(listed, _CANONICAL, "left")
    return joined.withColumn(out, F.coalesce(_LISTED, _CANONICAL)).drop(_CANONICAL, _LISTED)
