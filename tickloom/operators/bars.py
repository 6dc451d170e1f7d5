"""Bars, profiles and ordered aggregates as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.ordered import ORDERED, Ordered
from ..functions.times import bucket


def time_bucket(width: str | int, ts: str, origin: str | None = None) -> Column:
    """The start of the bucket a time is in, counted from the epoch."""
    return F.expr(bucket(width, ts, origin))


def ohlcv(rows: DataFrame, width: str | int, keys: list[str], ts: str = "ts", price: str = "price", size: str = "size") -> DataFrame:
    """Open, high, low, close, volume and count of each bucket and key: one partial aggregate and one shuffle."""
    return rows.groupBy(time_bucket(width, ts).alias("bucket"), *keys).agg(
        F.min_by(price, ts).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, ts).alias("close"),
        F.sum(size).alias("volume"),
        F.count("*").alias("trades"),
    )


def rolled_up(bars: DataFrame, width: str | int, keys: list[str]) -> DataFrame:
    """Wider bars from narrower ones (as `ohlcv` makes them), without reading the rows again."""
    return bars.groupBy(time_bucket(width, "bucket").alias("bucket"), *keys).agg(
        F.min_by("open", "bucket").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bucket").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    )


def aggregate(name: str, *args: str) -> Column:
    """An aggregate of the dialect over texts of Spark SQL."""
    make = registry.aggregate(name)
    if make is None:
        raise ValueError(f"unknown aggregate {name!r}")
    return F.expr(make(*args))


def staged(rows: DataFrame, by: list[str], ordered: Ordered, k: int) -> DataFrame:
    """The rows with an ordered aggregate's window columns; `by`: texts of the group's keys."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    over = f"OVER ({part}ORDER BY {ordered.order})"
    upto = f"OVER ({part}ORDER BY {ordered.order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for stage in ordered.stages:
        marks = {"over": over, "upto": upto, "all": f"OVER ({part.strip()})", "k": k}
        rows = rows.select("*", *[F.expr(x.format(**marks)).alias(n.format(k=k)) for n, x in stage.items()])
    return rows


def ordered_aggregate(rows: DataFrame, keys: list[str], **aggregates: tuple) -> DataFrame:
    """Aggregates over each key's rows in order: name=(function, *argument texts)."""
    made = []
    for k, (alias, (function, *args)) in enumerate(aggregates.items()):
        ordered = ORDERED[function][0](*map(str, args))
        rows = staged(rows, [f"`{c}`" for c in keys], ordered, k)
        made.append(F.expr(ordered.result.format(k=k)).alias(alias))
    return rows.groupBy(*keys).agg(*made)


def latest(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), ts).alias("row")).select("row.*")


def sessions(rows: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """The rows with `session`: numbers runs of rows that follow each other within the gap."""
    from ..functions.widths import interval, micros

    order = Window.partitionBy(*keys).orderBy(ts)
    new = (F.col(ts) - F.lag(ts).over(order) > F.expr(interval(micros(gap)))).cast("int")
    return rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
