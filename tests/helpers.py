"""Small frames for tests."""

from __future__ import annotations

import datetime as dt

UTC0 = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return UTC0 + dt.timedelta(hours=hours)


def ms(t: dt.datetime) -> int:
    return round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))
