"""Portable random numbers: the same in every engine, run and partitioning, from the MD5 of a seed and indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A bigint below 2**32 drawn by the parts, joined with commas."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(",", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """The same in DuckDB's SQL; parts are SQL expressions."""
    joined = " || ',' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(concat('0x', substr(md5({joined}), 1, 8)) as bigint)"
