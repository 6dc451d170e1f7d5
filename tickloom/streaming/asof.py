"""The as-of join over streams, exact for rows up to a lateness.

A left row is held until the watermark has passed its time; by then every right
row that it may take has arrived.  Per key the state is the held left rows and
the right rows that they, or later ones, may still take.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.widths import micros
from ..shipping import ship


class AsOf(StatefulProcessor):
    """Holds rows (side, at, payload) of one key; gives (left, right) payloads."""

    def __init__(self, inner: bool, strict: bool, tolerance: int | None) -> None:
        self.inner, self.strict, self.tolerance = inner, strict, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("at", T.LongType()), T.StructField("row", T.StringType())])
        self.handle = handle
        self.held = handle.getListState("held", kind)
        self.right = handle.getListState("right", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left, right = [], []
        for part in rows:
            for side, at, row in zip(part["side"], part["at_us"], part["payload"], strict=True):
                (left if side == 0 else right).append((int(at), row))
        if left:
            self.held.appendList(left)
        if right:
            self.right.appendList(right)
        yield self.settle(timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.settle(timerValues.getCurrentWatermarkInMs() * 1000)

    def settle(self, upto: int) -> pd.DataFrame:
        """Left rows at or before the watermark with their matches; keeps the others."""
        held = sorted(self.held.get(), key=lambda r: r[0])
        right = sorted(self.right.get(), key=lambda r: r[0])  # stable: the last arrived of a time stays last
        out, k = [], -1
        due = [r for r in held if r[0] < upto]
        for at, row in due:
            while k + 1 < len(right) and (right[k + 1][0] < at or (right[k + 1][0] == at and not self.strict)):
                k += 1
            match = right[k] if k >= 0 else None
            if match is not None and self.tolerance is not None and at - match[0] > self.tolerance:
                match = None
            if match is not None or not self.inner:
                out.append((row, match[1] if match else None))
        waiting = held[len(due) :]
        if due:
            self.held.clear()
            if waiting:
                self.held.appendList(waiting)
        # Of right rows before the watermark only the last can still be taken.
        old = [r for r in right if r[0] < upto]
        if len(old) > 1:
            self.right.clear()
            self.right.appendList(right[len(old) - 1 :])
        if waiting:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        return pd.DataFrame(out, columns=["l", "r"])

    def close(self) -> None:
        pass


def _keyed(right: DataFrame, keys: int) -> DataFrame:
    """The right rows that any left row may match: a null key matches nothing."""
    for i in range(keys):
        right = right.where(F.col(f"k{i}").isNotNull())
    return right


def asof_stream(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    keys: list[tuple[str, str]],
    *,
    lateness: str = "1 s",
    aliases: tuple[str, str] = ("l", "r"),
    how: str = "left",
    strict: bool = False,
    tolerance: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it, when `lateness` has passed.

    The session needs a state store for transformWithState (RocksDB).
    """
    ship(left.sparkSession)
    a, b = aliases

    def side(df: DataFrame, k: int, time: str, names: list[str]) -> DataFrame:
        return df.select(
            *[F.col(n).cast("string").alias(f"k{i}") for i, n in enumerate(names)],
            F.lit(k).alias("side"),
            F.col(time).cast("timestamp").alias("at"),
            F.unix_micros(F.col(time).cast("timestamp")).alias("at_us"),
            F.to_json(F.struct("*")).alias("payload"),
        ).where("at IS NOT NULL")

    both = side(left, 0, left_time, [x for x, _ in keys]).unionByName(_keyed(side(right, 1, right_time, [y for _, y in keys]), len(keys)))
    both = both.withWatermark("at", f"{micros(lateness)} microseconds")
    out = both.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(
        AsOf(how == "inner", strict, micros(tolerance) if tolerance else None), T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]), "append", "EventTime"
    )
    return out.select(F.from_json("l", left.schema).alias(a), F.from_json("r", right.schema).alias(b))


def arrival_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[tuple[str, str]], *, versions: int = 3, aliases: tuple[str, str] = ("l", "r"), how: str = "left") -> DataFrame:
    """Each left row at once, with the newest at or before it of the last `versions` right rows
    that have arrived: quick, where `asof_stream` is exact."""
    from .carried import carried

    a, b = aliases

    def side(df: DataFrame, k: int, time: str, names: list[str]) -> DataFrame:
        return df.select(*[F.col(n).cast("string").alias(f"k{i}") for i, n in enumerate(names)], F.lit(k).alias("side"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_us"), F.to_json(F.struct("*")).alias("payload")).where("at_us IS NOT NULL")

    inner = how == "inner"

    def feed(held: list, row: dict) -> list[tuple]:
        at = int(row["at_us"])
        if row["side"] == 1:
            held.append((at, row["payload"]))
            held.sort(key=lambda v: v[0])
            del held[:-versions]
            return []
        match = next((p for t, p in reversed(held) if t <= at), None)
        return [] if match is None and inner else [(row["payload"], match)]

    both = side(left, 0, left_time, [x for x, _ in keys]).unionByName(_keyed(side(right, 1, right_time, [y for _, y in keys]), len(keys)))
    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])
    # Within a batch right rows count as arrived by their time.
    out = carried(both.withColumn("turn", F.col("at_us") * 2 - F.col("side")), [f"k{i}" for i in range(len(keys))], ["turn"], list, feed, schema)
    return out.select(F.from_json("l", left.schema).alias(a), F.from_json("r", right.schema).alias(b))
