"""Candle sources: delimited files with a declared schema, pages of a kline service, and validating readers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewright.functions.times import floor_div, to_us
from tidewright.operators.panel import INTERVAL_MS, VALUES
from tidewright.operators.scan import join_on

# The columns of a candle file, in their order.
CANDLE_SCHEMA = T.StructType(
    [
        T.StructField("open_time_utc", T.TimestampType()),
        T.StructField("close_time_utc", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "quote_asset_volume")],
        T.StructField("number_of_trades", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("taker_buy_base_volume", "taker_buy_quote_volume")],
        *[T.StructField(c, T.StringType()) for c in ("exchange", "market_type", "symbol", "base_asset", "quote_asset", "interval")],
    ]
)
PAGE = 1_000
T_ = TypeVar("T_")
# HTTP answers after which a request is tried again, besides 5xx.
RETRY_STATUS = (418, 429)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CANDLE_SCHEMA) -> DataFrame:
    """A delimited file with a header; its columns must include those of the schema, which are never inferred."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in header.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    # by name, not by position: a file may have further columns, in another order
    read = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", True)
    types = {f.name: f.dataType for f in schema}
    return read.schema(T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header.columns])).csv(path).select(*types)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Delimited files with a header; Spark's committer publishes them as a whole."""
    df.write.mode(mode).option("header", True).csv(path)


def with_provenance(candles: DataFrame, exchange: str, market_type: str, symbol: str, base_asset: str, quote_asset: str, interval: str) -> DataFrame:
    """Adds where candles come from, as the last columns of a candle file."""
    if interval not in INTERVAL_MS:
        raise ValueError(f"unknown candle interval {interval!r}")
    named = {"exchange": exchange, "market_type": market_type, "symbol": symbol.upper(), "base_asset": base_asset, "quote_asset": quote_asset, "interval": interval}
    return candles.withColumns({k: F.lit(v) for k, v in named.items()})


# validating readers: each rule counts the rows that break it; strict readers raise


def violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """One row with the number of rows that break each rule."""
    return df.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(n) for n, r in rules.items()])


def require(df: DataFrame, rules: dict[str, object], what: str) -> DataFrame:
    """``df`` if no row breaks a rule, else an error that names the rules and counts."""
    counts = violations(df, rules).first().asDict()
    broken = {k: v for k, v in counts.items() if v}
    if broken:
        raise ValueError(f"{what}: {', '.join(f'{k} in {v} rows' for k, v in broken.items())}")
    return df


def regular_calendar(df: DataFrame, time_column: str, step_us: int, entity: Sequence[str] = ()) -> DataFrame:
    """Raises unless every row of an entity is one step after the one before it.

    Counted, not sorted: the times of an entity are a calendar if they are distinct, all on the grid of the first, and as many
    as fit between the first and the last.
    """
    us = df.select(*entity, to_us(F.col(time_column)).alias("__us")).withColumn("__n", F.lit(1))
    per = us.groupBy(*entity, "__us").agg(F.count(F.lit(1)).alias("__n"))
    ends = per.groupBy(*entity).agg(F.min("__us").alias("__a"), F.max("__us").alias("__b"), F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__d"), F.count_if(F.col("__us").isNull()).alias("__none"), F.min(F.pmod("__us", F.lit(step_us))).alias("__g"), F.max(F.pmod("__us", F.lit(step_us))).alias("__h"))
    fits = floor_div(F.col("__b") - F.col("__a"), step_us) + 1 == F.col("__d")
    rules = {"unknown time": F.col("__none") > 0, "repeated time": F.col("__n") > F.col("__d"), "irregular step": (F.col("__g") != F.col("__h")) | ~fits}
    require(ends, rules, "calendar")
    return df


#: Where a candle comes from: the same in all rows of a file.
PROVENANCE = ("exchange", "market_type", "symbol", "base_asset", "quote_asset", "interval")


def checked_candles(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """The candles of one file, strictly: not empty, known and distinct open times, known values, one provenance throughout and, where
    ``expected`` names some of it, that one."""
    provenance = {c: F.col(c) for c in PROVENANCE if c in df.columns}
    each = df.groupBy("open_time_utc").agg(F.count(F.lit(1)).alias("__n"))
    require(df.agg(F.count(F.lit(1)).alias("__n")), {"no row": F.col("__n") == 0}, "candles")
    require(each, {"unknown open time": F.col("open_time_utc").isNull(), "repeated open time": F.col("__n") > 1}, "candles")
    unknown = F.lit(False)
    for v in VALUES[:5]:
        unknown = unknown | F.col(v).isNull() | F.isnan(v)
    require(df, {"unknown value": unknown, **{f"another {c}": ~provenance[c].eqNullSafe(F.lit(v)) for c, v in (expected or {}).items()}}, "candles")
    kinds = df.select(F.struct(*provenance.values()).alias("p")).agg(F.min("p").alias("a"), F.max("p").alias("b")) if provenance else None
    if kinds is not None:
        require(kinds, {"several provenances": ~F.col("a").eqNullSafe(F.col("b"))}, "candles")
    return df


def checked_panel(df: DataFrame, assets: Sequence[str], entity: Sequence[str] = (), step_us: int = 21_600_000_000) -> DataFrame:
    """A panel fit for features: a regular calendar, and in complete rows positive ordered prices and volumes not below 0 of all assets."""
    regular_calendar(df, "open_time_utc", step_us, entity)
    rules = {}
    for a in assets:
        o, h, l, c, v = (F.col(f"{a}_{n}") for n in ("open", "high", "low", "close", "volume"))  # noqa: E741
        rules[f"{a} price out of order"] = (l <= 0) | (h < F.greatest(o, c, l)) | (l > F.least(o, c, h)) | h.isNull() | l.isNull() | o.isNull() | c.isNull()
        rules[f"{a} volume below 0"] = (v < 0) | v.isNull()
    require(df.where(F.coalesce("is_complete", F.lit(False))), rules, "panel")
    return df


def checked_returns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Valid rows have finite values and no reason, invalid ones no values and a reason."""
    finite, empty = F.lit(True), F.lit(True)
    for c in columns:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        empty = empty & F.col(c).isNull()
    reason = F.coalesce(F.col("invalid_reason"), F.lit("")) != ""
    ok = F.col("returns_valid")
    rules = {"valid row without finite values": ok & ~finite, "valid row with a reason": ok & reason, "invalid row with values": ~ok & ~empty, "invalid row without a reason": ~ok & ~reason}
    return require(df, rules, "returns")


def checked_index(df: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Sample numbers run from 0 without a gap, and target starts increase with them."""
    counts = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("sample_id").alias("__d"), F.min("sample_id").alias("__a"), F.max("sample_id").alias("__b"))
    whole = (F.col("__n") == F.col("__d")) & (F.col("__a") == 0) & (F.col("__b") == F.col("__n") - 1)
    require(counts, {"sample number out of sequence": ~whole}, "window index")
    # each number beside the next one: an equi-join, so one long entity is spread over tasks
    after = df.select(*entity, (F.col("sample_id") - 1).alias("sample_id"), F.col("target_start_ms").alias("__next"))
    pairs = join_on(df.select(*entity, "sample_id", "target_start_ms"), after, [*entity, "sample_id"], "inner")
    require(pairs, {"target start that does not increase": F.col("__next") <= F.col("target_start_ms")}, "window index")
    return df


def checked_partition(split: DataFrame, names: Sequence[str], entity: Sequence[str] = ()) -> DataFrame:
    """Every sample has exactly one of the split names."""
    counted = split.groupBy(*entity, "sample_id").agg(F.count(F.lit(1)).alias("__n"), F.max(F.coalesce(~F.col("split").isin(*names), F.lit(True))).alias("__odd"))
    require(counted, {"sample in several splits": F.col("__n") != 1, "unknown split": F.col("__odd")}, "split")
    return split


# pages of a kline service


def spans(start_ms: int, end_ms: int, step_ms: int, ticks: int) -> Iterator[tuple[int, int]]:
    """Half-open spans of at most ``ticks`` open times each that together cover ``[start_ms, end_ms)``."""
    width = step_ms * max(1, ticks)
    return ((low, min(low + width, end_ms)) for low in range(start_ms, end_ms, width))


@dataclass
class KlinePages:
    """The candles of a half-open span, asked for in pages.

    A span has room for one page, so the pages are known beforehand and none depends on the answer before it; ``page`` must not be
    above the service's own limit. Rows outside the span are left out; an answer of nothing else is an error.
    ``fetch(symbol, interval, start_ms, end_ms, limit)`` gives lists of candle fields, open time first; it is a
    parameter, so tests and recorded answers need no network.
    """

    fetch: Callable[[str, str, int, int, int], list[list]]
    page: int = PAGE

    def rows(self, symbol: str, interval: str, start_ms: int, end_ms: int) -> Iterator[list]:
        step = INTERVAL_MS.get(interval)
        if step is None:
            raise ValueError(f"unknown candle interval {interval!r}")
        for low, high in spans(start_ms, end_ms, step, self.page):
            answer = self.fetch(symbol, interval, low, high - 1, self.page)
            inside = [r for r in answer if low <= int(r[0]) < high]
            if answer and not inside:
                raise RuntimeError(f"the service answers outside the span from {low} to {high}")
            yield from inside


class Retry(Exception):
    """An attempt that is worth another one, after ``wait`` seconds if the other side named a time."""

    def __init__(self, why: Exception, wait: float | None = None):
        super().__init__(str(why))
        self.why, self.wait = why, wait


def delays(attempts: int, longest: float = 30.0) -> Iterator[float]:
    """Pauses between that many attempts: each twice the one before it, from one second."""
    return (min(2.0**i, longest) for i in range(attempts - 1))


def with_retries(attempt: Callable[[], T_], pauses: Iterable[float], sleep: Callable[[float], None] = time.sleep) -> T_:
    """What ``attempt`` returns, tried again after each pause for as long as it raises ``Retry``; then its reason is raised."""
    for pause in pauses:
        try:
            return attempt()
        except Retry as again:
            sleep(pause if again.wait is None else again.wait)
    try:
        return attempt()
    except Retry as last:
        raise last.why from None


def http_fetch(base_url: str, attempts: int = 5, timeout: float = 30.0, opener=urllib.request.urlopen, sleep=time.sleep) -> Callable:
    """A fetcher over HTTP: throttling and server errors are tried again, after ``Retry-After`` or the ``delays``."""

    def answer(url: str) -> list[list]:
        try:
            with opener(url, timeout=timeout) as body:
                return json.load(body)
        except urllib.error.URLError as e:  # an answer with a status, or no answer
            status = getattr(e, "code", None)
            if status is not None and status < 500 and status not in RETRY_STATUS:
                raise
            named = (getattr(e, "headers", None) or {}).get("Retry-After")
            raise Retry(e, float(named) if named else None) from e

    def fetch(symbol: str, interval: str, start_ms: int, end_ms: int, limit: int) -> list[list]:
        query = urllib.parse.urlencode({"symbol": symbol, "interval": interval, "startTime": start_ms, "endTime": end_ms, "limit": limit})
        return with_retries(lambda: answer(f"{base_url}?{query}"), delays(attempts), sleep)

    return fetch


@dataclass
class _Span(InputPartition):
    symbol: str
    start_ms: int
    end_ms: int


class _KlineReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable):
        self.interval = options["interval"]
        self.symbols = options["symbols"].split(",")
        self.start_ms, self.end_ms = int(options["start_ms"]), int(options["end_exclusive_ms"])
        self.parts = int(options.get("spans", "4"))
        self.pages = KlinePages(fetch, int(options.get("page", str(PAGE))))

    def partitions(self) -> list[_Span]:
        step = INTERVAL_MS[self.interval]
        ticks = max(1, -(-(self.end_ms - self.start_ms) // step))
        width = -(-ticks // self.parts) * step
        return [_Span(s, a, min(a + width, self.end_ms)) for s in self.symbols for a in range(self.start_ms, self.end_ms, width)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for r in self.pages.rows(partition.symbol, self.interval, partition.start_ms, partition.end_ms):
            yield (partition.symbol, int(r[0]), int(r[6]), *[float(x) for x in r[1:6]], float(r[7]), int(r[8]), float(r[9]), float(r[10]))


def kline_source(fetch: Callable, name: str = "klines") -> type[DataSource]:
    """A batch data source over a fetcher (workers need this package: ``session.ship_package``): register it, then ``spark.read.format(name)`` with the options symbols,
    interval, start_ms, end_exclusive_ms, spans. Each symbol and span of time is a partition of its own."""

    class KlineSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return (
                "symbol string, open_time_ms bigint, close_time_ms bigint, open double, high double, low double, close double, volume double, "
                "quote_asset_volume double, number_of_trades bigint, taker_buy_base_volume double, taker_buy_quote_volume double"
            )

        def reader(self, schema) -> DataSourceReader:
            return _KlineReader(dict(self.options), fetch)

    return KlineSource
