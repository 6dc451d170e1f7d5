"""Durations and bucket widths as text: ``15s``, ``5 minutes``, ``1d``."""

from __future__ import annotations

import re

# Microseconds of each unit's names.
UNITS = {
    "us": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "millisecond": 1_000, "milliseconds": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
    "w": 604_800_000_000, "week": 604_800_000_000, "weeks": 604_800_000_000,
}


def micros(width: str | int) -> int:
    """A duration in microseconds."""
    if isinstance(width, int):
        return width
    parts = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", width)
    if not parts or re.sub(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", "", width).strip(" ,"):
        raise ValueError(f"not a duration: {width!r}; write one like '5 minutes' or '15s', of microseconds to weeks")
    try:
        return round(sum(float(n) * UNITS[unit.lower()] for n, unit in parts))
    except KeyError as e:
        raise ValueError(f"unknown unit {e.args[0]!r} in {width!r}: durations are of microseconds to weeks") from None


def positive(width: str | int) -> int:
    us = micros(width)
    if us <= 0:
        raise ValueError(f"a bucket's width must be above 0, not {width!r}")
    return us


def interval(us: int) -> str:
    """Microseconds as a Spark SQL interval literal."""
    sign, us = ("-", -us) if us < 0 else ("", us)
    return f"INTERVAL '{sign}{us // 1_000_000}.{us % 1_000_000:06d}' SECOND"
