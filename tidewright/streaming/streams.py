"""Streams over an event table: closed candles, sessions and running drawdown.

Streams write to files in the shared folder (``spark.checkpoint.dir``) with their offsets and state beside them, so a
restarted query goes on where it stopped. ``run_available`` processes what is there and ends.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.session import ensure_checkpoint_dir, ship_package

LATE = "6 hours"


def event_stream(spark: SparkSession, path: str, name: str = "events") -> DataFrame:
    """A stream of the files of one table: a folder, or one file of the data directory."""
    whole = f"{path}/{name}.parquet"
    schema = spark.read.parquet(whole).schema
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(whole) if os.path.isdir(whole) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(path)
    # watermarks need times with a zone; the session's is UTC
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available and reads its result."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def closed_candles(events: DataFrame, asset: str = "event_type", time: str = "ts", value: str = "value", order: str = "event_id", length: str = "6 hours", late: str = LATE) -> DataFrame:
    """Candles that are closed: their end is behind the watermark. Works on streams and tables alike (a table has no
    watermark and gives all candles)."""
    rows = events.where(F.col(value) > 0)
    at = F.struct(time, order)
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(asset).alias("asset"))
    candles = grouped.agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("events")
    )
    return candles.select("asset", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "events")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """Stretches of activity of a key without a pause of ``gap`` or more."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def running_drawdown(events: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """Fall of each value from the highest value of its key so far, the state being that peak.

    Within a micro-batch rows are put in order of time; a row that arrives in a later batch is judged by the peak then.
    """

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["t", "o"])  # one key's rows of one micro-batch
        peaks = rows["v"].cummax().clip(lower=peak)
        state.update((float(peaks.iloc[-1]),))
        yield pd.DataFrame({"key": names[0], "event_id": rows["o"], "drawdown": 1 - rows["v"] / peaks})

    ship_package(events.sparkSession)
    rows = events.where(F.col(value) > 0).select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy("k").applyInPandasWithState(step, "key string, event_id bigint, drawdown double", "peak double", "append", GroupStateTimeout.NoTimeout)
