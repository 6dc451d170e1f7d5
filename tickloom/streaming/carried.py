"""Row-at-a-time operators over streams, with state carried from row to row of a key.

Spark's windows over rows don't run on streams; these do: running functions
(lag, moving averages, totals) and order books.  A key's state is one value; rows of a
batch are fed to it in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ema import decay
from ..operators.orderbook import REQUIRED, Book, Message, Place
from ..shipping import ship


class Carried(StatefulProcessor):
    """Feeds a key's rows to `feed(state, row)`, which gives the rows to put out."""

    def __init__(self, fresh: Callable[[], Any], feed: Callable[[Any, dict], list[tuple]], order: list[str], columns: list[str]) -> None:
        self.fresh, self.feed, self.order, self.columns = fresh, feed, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("held", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else self.fresh()
        every = pd.concat(list(rows))
        if self.order:
            every = every.sort_values(self.order, kind="stable")
        out = [made for row in every.to_dict("records") for made in self.feed(held, row)]
        self.state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def carried(rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], Any], feed: Callable[[Any, dict], list[tuple]], schema: T.StructType) -> DataFrame:
    """A stream of what `feed` makes of each key's rows."""
    ship(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(Carried(fresh, feed, order, schema.names), schema, "append", "None")


def running(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple]) -> DataFrame:
    """The rows with running columns: name to ('lag', source), ('sum', source), ('count',),
    ('max', source), ('min', source) or ('ema', source, period or weight)."""
    names = rows.columns
    kinds = {f.name: f.dataType for f in rows.schema}

    def kind(spec: tuple) -> T.DataType:
        return T.LongType() if spec[0] == "count" else T.DoubleType() if spec[0] in ("ema", "sum") else kinds[spec[1]]

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, kind(s)) for n, s in columns.items())])
    specs = list(columns.items())

    def value(x: Any) -> Any:
        return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x

    def feed(state: dict, row: dict) -> list[tuple]:
        out = []
        for name, spec in specs:
            x, old = value(row[spec[1]]) if len(spec) > 1 else None, state.get(name)
            if spec[0] == "lag":
                out.append(old)
                state[name] = x
                continue
            if spec[0] == "count":
                new = (old or 0) + 1
            elif x is None:
                new = old
            elif old is None:
                new = float(x) if spec[0] in ("ema", "sum") else x
            elif spec[0] == "ema":
                a = decay(spec[2])
                new = a * x + (1 - a) * old
            else:
                new = {"sum": lambda a, b: a + b, "max": max, "min": min}[spec[0]](old, x)
            state[name] = new
            out.append(new)
        return [(*(value(row[n]) for n in names), *out)]

    return carried(rows, keys, order, dict, feed, schema)


def orderbook_stream(updates: DataFrame, depth: int, arrival: str = "local_timestamp", allow_seq_reset: bool = False) -> DataFrame:
    """`orderbook_top_n` over a stream of updates."""
    missing = [c for c in REQUIRED if c not in updates.columns]
    if missing:
        raise ValueError(f"orderbook_top_n needs the column {missing[0]}")
    levels = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [updates.schema["exchange"], updates.schema["symbol"], T.StructField("time", T.LongType()), T.StructField("local_timestamp", T.LongType())]
        + [T.StructField(n, levels) for n in ("bid_price", "bid_amount", "ask_price", "ask_amount")]
    )

    def pairs(a: Any, b: Any) -> list[tuple[float, float]]:
        return list(zip([] if a is None else a, [] if b is None else b, strict=False))

    def feed(book: Book, row: dict) -> list[tuple]:
        top = book.message(Message(Place(int(row["time"]), int(row["venue_sequence"])), bool(row["is_snapshot"]), pairs(row["bid_price"], row["bid_amount"]), pairs(row["ask_price"], row["ask_amount"])))
        if top is None:
            return []
        return [(row["exchange"], row["symbol"], row["time"], row[arrival], *([x[k] for x in side] for side in top for k in (0, 1)))]

    return carried(updates, ["exchange", "symbol"], [arrival, "venue_sequence"], lambda: Book(depth, allow_seq_reset), feed, schema)
