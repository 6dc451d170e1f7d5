"""As-of, lookup and window joins.

The joined rows hold one struct column for each side, named by its alias, so that
``t.price`` and ``q.bid`` resolve as they would in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.widths import interval, micros


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str | Column,
    right_time: str | Column,
    keys: list[tuple[str | Column, str | Column]] = (),
    *,
    aliases: tuple[str, str] = ("l", "r"),
    how: str = "left",
    strict: bool = False,
    tolerance: str | int | None = None,
    slices: str | int | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    strict: before it only.  tolerance: a right row older than this is none.  how:
    'inner' drops left rows without a match.  Of right rows at one time the last
    one counts.  Left rows without a time are dropped; null keys match nothing.

    One sorted union serves all left rows, so there is one shuffle, on the keys.  If
    single keys hold too much for one task, `slices` (a duration) deals each key's rows
    out by time slice too; what a slice starts with is carried in from the earlier ones.
    """
    lt, rt = (F.col(x) if isinstance(x, str) else x for x in (left_time, right_time))
    lk = [F.col(a) if isinstance(a, str) else a for a, _ in keys]
    rk = [F.col(b) if isinstance(b, str) else b for _, b in keys]
    names = [f"k{i}" for i in range(len(keys))]
    a, b = aliases
    row, match = F.struct("*"), F.struct(rt.alias("at"), F.struct("*").alias("row"))
    ls = left.select(*[c.alias(n) for c, n in zip(lk, names, strict=True)], lt.alias("at"), F.lit(0 if strict else 1).alias("side"), F.lit(0).cast("long").alias("seq"), row.alias("own"))
    rs = right.select(*[c.alias(n) for c, n in zip(rk, names, strict=True)], rt.alias("at"), F.lit(1 if strict else 0).alias("side"), F.monotonically_increasing_id().alias("seq"), match.alias("match"))
    ls, rs = ls.where("at IS NOT NULL"), rs.where("at IS NOT NULL")
    for n in names:
        rs = rs.where(F.col(n).isNotNull())
    by = list(names)
    if slices is not None:
        us = micros(slices)
        at_slice = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / us)
        ls, rs = ls.withColumn("slice", at_slice), rs.withColumn("slice", at_slice)
        rs = rs.unionByName(_carried(ls, rs, names))
        by.append("slice")
    both = ls.withColumn("match", F.lit(None).cast(rs.schema["match"].dataType)).unionByName(rs.withColumn("own", F.lit(None).cast(ls.schema["own"].dataType)))
    # Without keys a time slice is all there is to deal rows out by.
    order = Window.partitionBy(*by).orderBy("at", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("match", F.last("match", ignorenulls=True).over(order)).where("own IS NOT NULL")
    hit = F.col("match")
    if tolerance is not None:
        hit = F.when(F.col("at") - F.col("match.at") <= F.expr(interval(micros(tolerance))), hit)
        found = found.withColumn("match", hit)
    if how == "inner":
        found = found.where("match IS NOT NULL")
    return found.select(F.col("own").alias(a), F.col("match.row").alias(b))


@dataclass
class Side:
    """A right side of `asof_joins`.  shift: microseconds that the left time is moved by for it."""

    rows: DataFrame
    time: Column
    keys: list[Column]
    alias: str
    shift: int = 0
    strict: bool = False
    tolerance: int | None = None
    inner: bool = False


def asof_joins(left: DataFrame, left_time: Column, left_keys: list[Column], rights: list[Side], alias: str = "l") -> DataFrame:
    """Several as-of joins of one table on the same keys and time, in one sorted union: one
    shuffle for all of them, where each in turn would take its own.

    A right side whose left time is moved (a horizon) has its own times moved the other way.
    """
    names = [f"k{i}" for i in range(len(left_keys))]

    def moved(c: Column, us: int) -> Column:
        return c - F.expr(interval(us)) if us else c

    both = left.select(*[k.alias(n) for k, n in zip(left_keys, names, strict=True)], left_time.alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("seq"), F.struct("*").alias("own")).where("at IS NOT NULL")
    parts = []
    for i, r in enumerate(rights):
        match = F.struct(r.time.alias("at"), F.struct("*").alias("row")).alias(f"m{i}")
        rows = r.rows.select(*[k.alias(n) for k, n in zip(r.keys, names, strict=True)], moved(r.time, r.shift).alias("at"), F.lit(2 if r.strict else 0).alias("side"), F.monotonically_increasing_id().alias("seq"), match)
        rows = rows.where("at IS NOT NULL")
        for n in names:
            rows = rows.where(F.col(n).isNotNull())
        parts.append(rows)
    for rows in parts:
        both = both.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*names).orderBy("at", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("at", "own", *[F.last(f"m{i}", ignorenulls=True).over(order).alias(f"m{i}") for i in range(len(rights))]).where("own IS NOT NULL")
    for i, r in enumerate(rights):
        if r.tolerance is not None:
            found = found.withColumn(f"m{i}", F.when(F.col("at") - F.col(f"m{i}.at") <= F.expr(interval(r.tolerance)), F.col(f"m{i}")))
        if r.inner:
            found = found.where(f"m{i} IS NOT NULL")
    return found.select(F.col("own").alias(alias), *[F.col(f"m{i}.row").alias(r.alias) for i, r in enumerate(rights)])


def _carried(ls: DataFrame, rs: DataFrame, names: list[str]) -> DataFrame:
    """For each key and slice, the last right row of the earlier slices, placed first in it."""
    last = rs.groupBy(*names, "slice").agg(F.max_by("match", F.struct("at", "seq")).alias("match"))
    every = last.unionByName(ls.select(*names, "slice").distinct(), allowMissingColumns=True)
    every = every.groupBy(*names, "slice").agg(F.first("match", ignorenulls=True).alias("match"))
    before = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("match", F.last("match", ignorenulls=True).over(before)).where("match IS NOT NULL")
    return every.select(*names, F.col("match.at").alias("at"), F.lit(-1).alias("side"), F.lit(-1).cast("long").alias("seq"), "match", "slice")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], *, aliases: tuple[str, str] = ("l", "r"), how: str = "inner", order: list[Column] = ()) -> DataFrame:
    """Each left row with the last right row of its keys: one match at most.

    order: what makes a right row the last one.  Without it, the order in which files are
    read: the same on each run over the same files, but arbitrary after a shuffle.

    The right side is reduced to a row for each key before it is joined; whether that
    side is then broadcast is decided by its size.
    """
    a, b = aliases
    names = [f"k{i}" for i in range(len(keys))]
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    rs = right.select(*[r.alias(n) for (_, r), n in zip(keys, names, strict=True)], place.alias("seq"), F.struct("*").alias(b))
    rs = rs.groupBy(*names).agg(F.max_by(b, "seq").alias(b))
    ls = left.select(*[k.alias(n) for (k, _), n in zip(keys, names, strict=True)], F.struct("*").alias(a))
    return ls.join(rs, names, how).select(a, b)


def window_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    keys: list[tuple[str, str]],
    aggregates: dict[str, str],
    low: int,
    high: int,
    *,
    closed: tuple[bool, bool] = (True, True),
    aliases: tuple[str, str] = ("l", "w"),
    right_alias: str = "r",
    keep_null_time: bool = True,
) -> DataFrame:
    """Each left row with aggregates over the right rows of its keys in a range around its time.

    low, high: microseconds added to the left time; closed: whether the ends belong to
    the range.  aggregates: name to Spark SQL text over `right_alias`; over no rows
    counts are 0 and others null.

    Time is cut in buckets as wide as the range, so a left row meets two buckets at most
    and the join is an equality on keys and bucket: a busy key is dealt out by time.
    """
    width = max(high - low, 1)
    us = "unix_micros(CAST({} AS TIMESTAMP))".format
    a, b = aliases
    names = [f"k{i}" for i in range(len(keys))]
    ls = left.select(*[F.col(k).alias(n) for (k, _), n in zip(keys, names, strict=True)], F.expr(us(left_time)).alias("at"), F.struct("*").alias(a))
    if not keep_null_time:
        ls = ls.where("at IS NOT NULL")
    ls = ls.withColumn("id", F.monotonically_increasing_id())
    buckets = f"coalesce(sequence(floor((at + {low}) / {width}), floor((at + {high}) / {width})), array(CAST(NULL AS BIGINT)))"
    ls = ls.withColumn("bucket", F.explode(F.expr(buckets)))
    rs = right.select(*[F.col(r).alias(f"r{n}") for (_, r), n in zip(keys, names, strict=True)], F.expr(us(right_time)).alias("rat"), F.struct("*").alias(right_alias))
    rs = rs.withColumn("rbucket", F.floor(F.col("rat") / width))
    lo, hi = F.col("at") + low, F.col("at") + high
    within = (F.col("rat") >= lo if closed[0] else F.col("rat") > lo) & (F.col("rat") <= hi if closed[1] else F.col("rat") < hi)
    on = (F.col("bucket") == F.col("rbucket")) & within
    for n in names:
        on &= F.col(n) == F.col(f"r{n}")
    both = ls.join(rs, on, "left")
    # The outer join pads bucket copies without a match; the marker keeps those rows out.
    met = both.groupBy("id").agg(F.first(a).alias(a), *[F.expr(f"{x}").alias(n) for n, x in aggregates.items()])
    return met.select(a, F.struct(*aggregates).alias(b))
