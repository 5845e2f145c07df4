"""The test tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.session import pin_utc, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a folder of Parquet."""
    return ship_package(pin_utc(spark)).read.parquet(f"{sf_dir}/{name}.parquet")
