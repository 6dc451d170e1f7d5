"""Time functions as Spark SQL text, and as Columns (`col`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .widths import micros, positive


def us(ts: str) -> str:
    """Microseconds since 1970 of a timestamp."""
    return f"unix_micros(CAST({ts} AS TIMESTAMP))"


def from_us(x: str) -> str:
    return f"CAST(timestamp_micros({x}) AS TIMESTAMP_NTZ)"


def bucket(width: str | int, ts: str, origin: str | None = None) -> str:
    """The start of the bucket that a time is in; buckets are counted from the epoch or an origin."""
    w = positive(width)
    if origin is None:
        return from_us(f"{us(ts)} - pmod({us(ts)}, {w})")
    return from_us(f"{us(ts)} - pmod({us(ts)} - {us(origin)}, {w})")


def zoned_bucket(width: str | int, ts: str, zone: str) -> str:
    """The start, in UTC, of the wall-clock bucket of a zone.

    Where a wall-clock start is ambiguous or later than the time itself (the hour that
    a change of clocks repeats), the reading nearest below the time is taken.
    """
    w = positive(width)
    local = f"from_utc_timestamp(CAST({ts} AS TIMESTAMP), {zone})"
    # Widths under a day keep the distance to the start within one offset from UTC.
    if w < micros("1d"):
        return from_us(f"{us(ts)} - pmod(unix_micros({local}), {w})")
    start = f"timestamp_micros(unix_micros({local}) - pmod(unix_micros({local}), {w}))"
    return f"CAST(to_utc_timestamp({start}, {zone}) AS TIMESTAMP_NTZ)"


def col(text: str) -> Column:
    return F.expr(text)


# What each part of a time is, as Spark SQL over {x}; {us} its microseconds.
PARTS = {
    "year": "year({x})", "quarter": "quarter({x})", "month": "month({x})", "day": "day({x})",
    "hour": "hour({x})", "minute": "minute({x})", "second": "second({x})",
    "millisecond": "CAST(pmod({us}, 60000000) DIV 1000 AS BIGINT)", "milliseconds": "CAST(pmod({us}, 60000000) DIV 1000 AS BIGINT)",
    "microsecond": "pmod({us}, 60000000)", "microseconds": "pmod({us}, 60000000)",
    "dow": "(dayofweek({x}) - 1)", "dayofweek": "(dayofweek({x}) - 1)", "isodow": "(weekday({x}) + 1)",
    "doy": "dayofyear({x})", "dayofyear": "dayofyear({x})", "week": "weekofyear({x})", "weekofyear": "weekofyear({x})",
    "epoch": "({us} / 1000000D)",
}


def part(name: str, ts: str) -> str:
    try:
        text = PARTS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown part of a time: {name!r}; known are {', '.join(PARTS)}") from None
    out = text.format(x=ts, us=us(ts))
    return out if name.lower() == "epoch" else f"CAST({out} AS BIGINT)"


def trunc(unit: str, ts: str) -> str:
    return f"CAST(date_trunc('{unit}', CAST({ts} AS TIMESTAMP)) AS TIMESTAMP_NTZ)"


def diff(unit: str, a: str, b: str) -> str:
    """How many boundaries of the unit lie between two times."""
    unit = unit.lower().rstrip("s")
    if unit in ("year", "quarter", "month"):
        months = f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
        quarters = f"((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}))"
        return f"CAST({ {'year': f'(year({b}) - year({a}))', 'quarter': quarters, 'month': months}[unit]} AS BIGINT)"
    w = positive(f"1 {unit}")
    ta, tb = (us(trunc(unit, x)) for x in (a, b))
    return f"(({tb} - {ta}) DIV {w})"


# strftime's marks as date_format patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "a": "EEE", "b": "MMM"}


def strftime(ts: str, pattern: str) -> str:
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "%" and k + 1 < len(pattern):
            k += 1
            mark = pattern[k]
            if mark != "%" and mark not in STRFTIME:
                raise ValueError(f"strftime's %{mark} isn't supported; known are {' '.join('%' + m for m in STRFTIME)} %%")
            out += "%" if mark == "%" else STRFTIME[mark]
        else:
            out += "''''" if c == "'" else f"''{c}''" if c.isalpha() else c
        k += 1
    return f"date_format({ts}, '{out}')"
