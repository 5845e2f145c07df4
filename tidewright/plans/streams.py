"""Queries that run a stream over the event table, and the SQL of the same results in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import to_us, us_to_ms
from tidewright.session import pin_utc
from tidewright.streaming import streams as S


def _ms(c: str):
    return us_to_ms(to_us(F.col(c)))


def stream_candles(spark: SparkSession, sf: str) -> DataFrame:
    out = S.run_available(S.closed_candles(S.event_stream(pin_utc(spark), sf)))
    return out.withColumns({"open_time": _ms("open_time"), "close_time": _ms("close_time")})


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = S.run_available(S.sessions(S.event_stream(pin_utc(spark), sf)))
    return out.withColumns({"started": _ms("started"), "ended": _ms("ended")})


def stream_running_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    out = S.run_available(S.running_drawdown(S.event_stream(pin_utc(spark), sf)))
    return out.withColumn("drawdown", F.round("drawdown", 9) + F.lit(0.0))


QUERIES = {f.__name__: f for f in (stream_candles, stream_sessions, stream_running_drawdown)}

_WATERMARK = "(select max(epoch_us(ts)) - 21600000000 from events{})"
ORACLE = {
    "stream_candles": f"""with e as (select *, epoch_us(ts) // 21600000000 * 21600000 w from events where value > 0)
select event_type asset, w open_time, w + 21600000 close_time, first(value order by ts, event_id) open, max(value) high, min(value) low, last(value order by ts, event_id) "close", count(*) events
from e group by 1, 2, 3 having (w + 21600000) * 1000 <= {_WATERMARK.format(" where value > 0")}""",
    "stream_sessions": f"""with e as (select user_id, epoch_us(ts) t from events), g as (select *, case when t - lag(t) over (partition by user_id order by t) < 43200000000 then 0 else 1 end n from e),
s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) k from g)
select user_id, min(t) // 1000 started, (max(t) + 43200000000) // 1000 ended, count(*) events from s group by user_id, k having max(t) + 43200000000 <= {_WATERMARK.format("")}""",
    "stream_running_drawdown": """select event_type as "key", event_id, round(1 - value / max(value) over (partition by event_type order by ts, event_id), 9) + 0.0 drawdown from events where value > 0""",
}
