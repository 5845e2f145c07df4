"""Time arithmetic on integers. Timestamps (with or without zone) are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS = 1_000
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def to_us(c: Column) -> Column:
    """Microseconds since the epoch; needs a session in UTC (``session.pin_utc``)."""
    return F.unix_micros(c.cast("timestamp"))


def floor_div(c: Column, n: int) -> Column:
    """Integer division that rounds towards minus infinity, exact for any bigint."""
    step = F.lit(n).cast("bigint")
    rest = F.pmod(c, step)
    return F.call_function("div", c - rest, step)


def us_to_ms(c: Column) -> Column:
    return floor_div(c, MS)


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 of a timestamp or date."""
    return F.unix_date(c.cast("date")).cast("bigint")
