"""Top of a level-two order book, rebuilt from snapshots and changes.

A book belongs to an exchange and symbol.  Its messages are read in arrival
order, one after the other along sorted partitions, so a book's length isn't
bounded by memory; what is held is the book itself.

A message's position is its venue's time and sequence.  One that lies before what was
taken last is old, and ignored, but for a snapshot: if every change since its position
is still at hand, the book becomes that snapshot with those changes after it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .ema import starts

REQUIRED = ("exchange", "symbol", "is_snapshot", "time", "venue_sequence", "bid_price", "bid_amount", "ask_price", "ask_amount")
# How many changes are kept for a late snapshot, and for how much venue time.
KEPT, KEPT_US = 256, 2_000_000
#: Beyond every level's place.
UNTOUCHED = 1 << 62


class Place(NamedTuple):
    """Where a message stands in its venue's order; sequence 0 is none."""

    time: int
    seq: int

    def before(self, other: Place, restarts: bool) -> bool:
        """By sequence if both have one (and by time first where sequences may restart), else by time."""
        if not (self.seq and other.seq):
            return self.time < other.time
        return self < other if restarts else self.seq < other.seq


class Message(NamedTuple):
    place: Place
    snapshot: bool
    bids: list[tuple[float, float]]
    asks: list[tuple[float, float]]


class Ladder:
    """One side's levels, best first.  A level's rank is its price, negated on the bid side."""

    def __init__(self, sign: int) -> None:
        self.sign = sign
        self.ranks: list[float] = []
        self.amounts: list[float] = []

    def put(self, levels: list[tuple[float, float]]) -> int:
        """Sets amounts; 0 takes a level away.  What isn't finite is refused.  Gives the best place
        among the levels that may have changed."""
        ranks, best = self.ranks, UNTOUCHED
        for price, amount in levels:
            if not (math.isfinite(price) and math.isfinite(amount)):
                continue
            rank = self.sign * price
            i = bisect_left(ranks, rank)
            best = min(best, i)
            known = i < len(ranks) and ranks[i] == rank
            if amount and known:
                self.amounts[i] = amount
            elif amount:
                ranks.insert(i, rank)
                self.amounts.insert(i, amount)
            elif known:
                del ranks[i], self.amounts[i]
        return best

    def drop(self, upto: float) -> None:
        """Takes away the best levels up to a rank."""
        i = bisect_right(self.ranks, upto)
        del self.ranks[:i], self.amounts[:i]

    def top(self, n: int) -> tuple[tuple[float, float], ...]:
        return tuple((self.sign * r + 0.0, a) for r, a in zip(self.ranks[:n], self.amounts[:n], strict=True))


class Book:
    """The two sides, the changes kept for late snapshots, and the top that was last given out."""

    def __init__(self, depth: int, restarts: bool = False) -> None:
        self.depth, self.restarts = depth, restarts
        self.bids, self.asks = Ladder(-1), Ladder(1)
        self.newest: Place | None = None  # of what was taken; none before the first snapshot
        self.complete_from = Place(0, 0)  # all changes after this place are kept
        self.kept: deque[Message] = deque()
        self.shown: tuple = ((), ())

    def message(self, m: Message) -> tuple | None:
        """Takes a message in; the new top if it changed."""
        best = UNTOUCHED
        for x in self.due(m):
            best = min(best, self.take(x))
        if best >= self.depth:
            return None
        top = (self.bids.top(self.depth), self.asks.top(self.depth))
        if top == self.shown:
            return None
        self.shown = top
        return top

    def due(self, m: Message) -> Sequence[Message]:
        """What is to be taken in on a message's arrival, in order."""
        if self.newest is None:
            if not m.snapshot:
                return []
            self.newest = m.place
        elif not self.restarts and m.place.seq > self.newest.seq > 0:
            # The usual case: next in sequence.
            self.newest = m.place
            self.remember(m)
            return (m,)
        old = m.place.before(self.newest, self.restarts)
        again = m.place.seq and not m.snapshot and not self.newest.before(m.place, self.restarts)
        if not (old or again):
            self.newest = Place(m.place.time, m.place.seq or self.newest.seq)
            self.remember(m)
            return [m]
        known = self.complete_from
        reaches = known.before(m.place, self.restarts) or (known.seq and m.place.seq and not m.place.before(known, self.restarts))
        if not (m.snapshot and reaches):
            return []
        self.kept = deque(k for k in self.kept if not k.place.before(m.place, self.restarts))
        self.complete_from = m.place
        return [m, *self.kept]

    def remember(self, m: Message) -> None:
        if m.snapshot:
            self.kept.clear()
            self.complete_from = m.place
            return
        self.kept.append(m)
        while len(self.kept) > KEPT or m.place.time - self.kept[0].place.time > KEPT_US:
            self.complete_from = self.kept.popleft().place

    def take(self, m: Message) -> int:
        """Takes in what is due; the best place among the levels that may have changed."""
        best = UNTOUCHED
        if m.snapshot:
            self.bids, self.asks, best = Ladder(-1), Ladder(1), 0
        if m.bids:
            best = min(best, self.bids.put(m.bids))
        if m.asks:
            best = min(best, self.asks.put(m.asks))
        if self.bids.ranks and self.asks.ranks and self.bids.ranks[0] + self.asks.ranks[0] <= 0:
            # Crossed: the side whose best this message set is the newer one, and stays.
            newer, older = (self.asks, self.bids) if any(p == self.asks.ranks[0] for p, _ in m.asks) else (self.bids, self.asks)
            older.drop(-newer.ranks[0])
            best = 0
        return best


def levels(prices: pa.Array, amounts: pa.Array) -> list[Sequence[tuple[float, float]]]:
    """Each message's pairs of price and amount; a null among them is no number."""
    out: list[Sequence[tuple[float, float]]] = [()] * len(prices)
    sides = []
    for c in (prices, amounts):
        n = pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sides.append((c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).tolist(), n, np.cumsum(n) - n))
    (p, pn, pat), (a, an, aat) = sides
    some = np.flatnonzero(np.minimum(pn, an))
    for i, j, m, k, n in zip(*(x.tolist() for x in (some, pat[some], pn[some], aat[some], an[some])), strict=True):
        out[i] = ((p[j], a[k]),) if m == n == 1 else list(zip(p[j : j + m], a[k : k + n], strict=False))
    return out


SCHEMA = "exchange {exchange}, symbol {symbol}, time long, local_timestamp long, bid_price array<double>, bid_amount array<double>, ask_price array<double>, ask_amount array<double>"


def orderbook_top_n(updates: DataFrame, depth: int, arrival: str = "local_timestamp", allow_seq_reset: bool = False) -> DataFrame:
    """A row whenever one of the best `depth` levels of a side changes."""
    ship(updates.sparkSession)
    missing = [c for c in REQUIRED if c not in updates.columns]
    if missing:
        raise ValueError(f"orderbook_top_n needs the column {missing[0]}")
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema}
    names = ["exchange", "symbol", "is_snapshot", "time", "venue_sequence", "bid_price", "bid_amount", "ask_price", "ask_amount", arrival]
    rows = updates.select(*names).repartition("exchange", "symbol").sortWithinPartitions("exchange", "symbol", arrival, "venue_sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book(depth, allow_seq_reset)
        for batch in batches:
            ex, sym, snapshot, time, seq, bp, ba, ap, aa, at = batch.columns
            snapshots = snapshot.cast(pa.bool_()).fill_null(False).to_numpy(zero_copy_only=False).tolist()
            times, seqs = (c.cast(pa.int64()).fill_null(0).to_numpy().tolist() for c in (time, seq))
            bids, asks = levels(bp, ba), levels(ap, aa)
            runs = starts([ex, sym], batch.num_rows).tolist()
            changed: list[int] = []
            out: list[list] = [[] for _ in range(4)]
            for a, e in zip(runs[:-1], runs[1:], strict=True):
                key = (ex[a].as_py(), sym[a].as_py())
                if key != now:
                    now, book = key, Book(depth, allow_seq_reset)
                for i in range(a, e):
                    top = book.message(Message(Place(times[i], seqs[i]), snapshots[i], bids[i], asks[i]))
                    if top is not None:
                        changed.append(i)
                        for c, v in zip(out, ([x[k] for x in side] for side in top for k in (0, 1)), strict=True):
                            c.append(v)
            which = pa.array(changed, pa.int64())
            told = [ex.take(which), sym.take(which), *(c.take(which).cast(pa.int64()) for c in (time, at))]
            yield pa.RecordBatch.from_arrays([*told, *(pa.array(c, pa.list_(pa.float64())) for c in out)], ["exchange", "symbol", "time", "local_timestamp", "bid_price", "bid_amount", "ask_price", "ask_amount"])

    return rows.mapInArrow(run, SCHEMA.format(**kinds))


def sides(updates: DataFrame, price: str, amount: str, side: str) -> DataFrame:
    """Level changes in a row each (a price, an amount and buy or sell) as messages of one level."""
    buy = F.col(side) == "buy"
    return updates.select(
        "*",
        F.when(buy, F.array(price)).otherwise(F.array()).alias("bid_price"),
        F.when(buy, F.array(amount)).otherwise(F.array()).alias("bid_amount"),
        F.when(~buy, F.array(price)).otherwise(F.array()).alias("ask_price"),
        F.when(~buy, F.array(amount)).otherwise(F.array()).alias("ask_amount"),
    )
