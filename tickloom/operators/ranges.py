"""Aggregates over ranges around each row's place, in time that grows with the rows and not with the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How what a range has of two stretches is put together; {p} and {s} are the aggregates of each.
MADE_OF = {
    "count": "{p} + {s}",
    "sum": "coalesce({p} + {s}, {p}, {s})",
    "min": "least({p}, {s})",
    "max": "greatest({p}, {s})",
}


def range_aggregates(rows: DataFrame, keys: list[str], at: str, low: int, high: int, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with, for each name in `columns` (one of MADE_OF, Spark SQL text of a value), that aggregate
    over the rows of its keys whose `at` (a whole number) is from at + low to at + high, both included.

    Numbers are cut in stretches as wide as the range, so each range is the end of one stretch and the start
    of the next.  A row is told to the stretch that it lies in and, moved back by the range's width, to the one
    before; there a frame that only grows from the last row backwards gives the end, and one from the first row
    the start.  Rows are dealt out by key and stretch, and each of these is sorted twice and read once each way.
    Rows without a number are each other's range, as in SQL.
    """
    width = high - low
    if width <= 0:
        raise ValueError("a range must be wider than 0")

    def copy(n: str, stretch: int, asks: bool, side: str) -> str:
        return f"named_struct('stretch', ({n} - pmod({n}, {width}L)) DIV {width}L - {stretch}L, 'place', {n} - {stretch * width}L, 'asks', {str(asks).upper()}, 'side', {side})"

    own = quoted(at)
    copies = [copy(own, 1, low == -width, "'start'"), copy(own, 0, low == 0, f"CASE WHEN {own} IS NOT NULL THEN 'end' END")]
    if low not in (-width, 0):
        copies.append(copy(f"({own} + {low}L)", 0, True, "CAST(NULL AS STRING)"))
    told = rows.select("*", F.explode(F.expr(f"array({', '.join(copies)})")).alias("_told")).where("_told.asks OR _told.side IS NOT NULL")
    told = told.select(*map(quoted, rows.columns), *[F.col(f"_told.{c}").alias(f"_{c}") for c in ("stretch", "place", "asks", "side")])
    dealt = Window.partitionBy(*map(quoted, keys), "_stretch")
    frames = {"start": dealt.orderBy(F.asc_nulls_last("_place")), "end": dealt.orderBy(F.desc_nulls_last("_place"))}
    parts = []
    for i, (how, x) in enumerate(columns.values()):
        for side, frame in frames.items():
            value = F.expr(f"{how}(CASE WHEN _side = '{side}' THEN {x} END)")
            parts.append(value.over(frame.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_{side}{i}"))
    met = told.select("*", *parts).where("_asks")
    made = [F.expr(MADE_OF[how].format(p=f"_start{i}", s=f"_end{i}")).alias(n) for i, (n, (how, _)) in enumerate(columns.items())]
    return met.select(*map(quoted, rows.columns), *made)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
