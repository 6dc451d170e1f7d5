"""Filling the buckets between a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import from_us, us
from ..functions.widths import positive

#: A row makes at most so many new ones at once; longer gaps are made in as many parts.
PART = 65_536


def gapfill(
    rows: DataFrame,
    bucket: str,
    width: str | int,
    keys: list[str],
    *,
    locf: list[str] = (),
    interpolate: list[str] = (),
    start: str | None = None,
    finish: str | None = None,
) -> DataFrame:
    """The rows (one a key and bucket) with a row for each bucket between them.

    A new row has its key and bucket; `locf` columns carry the key's last row's value,
    `interpolate` columns lie on the line between the rows around the gap; other
    columns are null.  start, finish: texts of times; with them, a key's buckets from
    the start's on and before the finish are there too.

    Each row makes the new rows that follow it, so there is no grid to join: one
    window by key and two generators, of parts and of the buckets of a part, so that the
    longest gap takes no more memory than a part.
    """
    w = positive(width)
    names = rows.columns
    order = Window.partitionBy(*keys).orderBy(bucket)
    at = us(f"`{bucket}`")
    out = rows.where(F.col(bucket).isNotNull())
    out = out.withColumn("_at", F.expr(at)).withColumn("_next", F.lead("_at").over(order)).withColumn("_first", F.lag("_at").over(order).isNull())
    for c in interpolate:
        out = out.withColumn(f"_to_{c}", F.lead(c).over(order))
    tail = f"CASE WHEN _next IS NULL THEN CAST(ceil(({us(finish)} - _at) / {w}) AS BIGINT) - 1 ELSE 0 END" if finish else "0"
    gap = f"coalesce((_next - _at) DIV {w} - 1, greatest({tail}, 0))"
    lead = f"CASE WHEN _first THEN greatest((_at - ({us(start)} - pmod({us(start)}, {w}))) DIV {w}, 0) ELSE 0 END" if start else "0"
    out = out.withColumn("_lead", F.expr(f"-CAST({lead} AS BIGINT)")).withColumn("_gap", F.expr(f"CAST({gap} AS BIGINT)"))
    out = out.withColumn("_part", F.explode(F.expr(f"sequence(_lead, _gap, {PART}L)")))
    out = out.withColumn("_step", F.explode(F.expr(f"sequence(_part, least(_part + {PART - 1}L, _gap))")))
    made = []
    for c in names:
        if c == bucket:
            made.append(F.expr(from_us(f"_at + _step * {w}")).alias(c))
        elif c in keys:
            made.append(F.col(c))
        elif c in locf:
            made.append(F.when(F.col("_step") >= 0, F.col(c)).alias(c))
        elif c in interpolate:
            line = F.col(c) + (F.col(f"_to_{c}") - F.col(c)) * F.col("_step") * w / (F.col("_next") - F.col("_at"))
            made.append(F.when(F.col("_step") == 0, F.col(c)).when(F.col("_step") > 0, line).cast("double").alias(c))
        else:
            made.append(F.when(F.col("_step") == 0, F.col(c)).alias(c))
    return out.select(*made)
