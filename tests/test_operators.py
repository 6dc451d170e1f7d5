"""Operators on tiny frames, with ties, nulls and empty inputs; brute force where it is short."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.functions.widths import micros, positive
from tickloom.operators.asof import asof_join, window_join
from tickloom.operators.bars import latest, ohlcv, ordered_aggregate, rolled_up, sessions
from tickloom.operators.ema import ema
from tickloom.operators.gapfill import gapfill
from tickloom.operators.orderbook import KEPT, KEPT_US, Book, Ladder, Message, Place, levels, orderbook_top_n
from tickloom.operators.ranges import range_aggregates


def stamps(spark, rows, extra):
    df = spark.createDataFrame(rows, f"t long, {extra}")
    return df.withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz"))


def test_widths():
    assert micros("5 minutes") == 300_000_000 and micros("1d") == 86_400_000_000 and micros("250us") == 250
    for bad in ("", "5 months", "x"):
        with pytest.raises(ValueError):
            micros(bad)
    with pytest.raises(ValueError):
        positive("0 s")


@pytest.mark.parametrize("slices", [None, "7 us"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_is_brute_force(spark, slices, strict):
    rng = random.Random(5)
    left = [(rng.randrange(60), rng.choice(["a", "b", None]), i) for i in range(80)]
    right = [(rng.randrange(60), rng.choice(["a", "b", None]), i) for i in range(50)]
    ls, rs = stamps(spark, left, "k string, i long"), stamps(spark, right, "k string, j long").coalesce(1)
    got = asof_join(ls, rs, "ts", "ts", [("k", "k")], strict=strict, slices=slices).select("l.i", "r.j").collect()
    want = {}
    for t, k, i in left:
        near = [(rt, j) for rt, rk, j in right if k is not None and rk == k and (rt < t or rt == t and not strict)]
        want[i] = max(near)[1] if near else None  # of equal times the last arrived, that is the largest j
    assert {r[0]: r[1] for r in got} == want


def test_asof_of_nothing(spark):
    ls = stamps(spark, [(1, "a")], "k string")
    rs = stamps(spark, [], "k string")
    assert asof_join(ls, rs, "ts", "ts", [("k", "k")]).select("r").collect()[0][0] is None
    assert asof_join(ls, rs, "ts", "ts", [("k", "k")], how="inner").count() == 0


def test_window_join_is_brute_force(spark):
    rng = random.Random(6)
    left = [(rng.randrange(100), rng.choice("ab"), i) for i in range(40)]
    right = [(rng.randrange(100), rng.choice("ab"), rng.randrange(9)) for i in range(60)]
    got = window_join(stamps(spark, left, "k string, i long"), stamps(spark, right, "k string, x long"), "ts", "ts", [("k", "k")], {"n": "count(r)", "s": "sum(r.x)"}, -10, 5, closed=(True, False))
    want = {i: [x for rt, rk, x in right if rk == k and t - 10 <= rt < t + 5] for t, k, i in left}
    assert {r[0]: (r[1], r[2]) for r in got.select("l.i", "w.n", "w.s").collect()} == {i: (len(v), sum(v) if v else None) for i, v in want.items()}


@pytest.mark.parametrize(("low", "high"), [(-7, 0), (0, 7), (-5, 3), (-9, -2), (2, 30), (-1, 0), (-1000, 0)])
def test_ranges_are_brute_force(spark, low, high):
    rng = random.Random(low)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 40)]), rng.choice([None, 1, 2, 3, 50])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k string, t long, x long").repartition(5)
    got = {r[0]: tuple(r)[4:] for r in range_aggregates(df, ["k"], "t", low, high, {"n": ("count", "1"), "c": ("count", "x"), "s": ("sum", "x"), "l": ("min", "x"), "h": ("max", "x")}).collect()}
    assert len(got) == len(rows)
    for i, (k, t, _) in enumerate(rows):
        near = [rx for rk, rt, rx in rows if rk == k and (rt is None if t is None else rt is not None and t + low <= rt <= t + high)]
        x = [v for v in near if v is not None]
        assert got[i] == (len(near), len(x), sum(x) if x else None, min(x, default=None), max(x, default=None))


def test_gapfill_edges(spark):
    rows = stamps(spark, [(0, "a", 1.0), (30, "a", 4.0), (10, "b", None)], "k string, v double").select("ts", "k", "v")
    got = sorted((r[1], r[2]) for r in gapfill(rows, "ts", 10, ["k"], interpolate=["v"]).collect() if r[1] == "a")
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0)]
    carried = gapfill(rows, "ts", 10, ["k"], locf=["v"], start="TIMESTAMP_NTZ'1970-01-01 00:00:00'", finish="TIMESTAMP_NTZ'1970-01-01 00:00:00.000050'")
    assert carried.groupBy("k").count().orderBy("k").collect() == [("a", 5), ("b", 5)]
    far = stamps(spark, [(0, "a", 1.0), (700_000 * 10, "a", 2.0)], "k string, v double").select("ts", "k", "v")
    assert gapfill(far, "ts", 10, ["k"]).agg(F.count("*"), F.countDistinct("ts"), F.max("ts") == F.timestamp_micros(F.lit(7_000_000)).cast("timestamp_ntz")).first() == (700_001, 700_001, True)


def test_ema_keeps_state_over_nulls(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, 20.0), ("b", 1, 5.0)], "k string, t long, x double")
    got = ema(rows, ["k"], ["t"], {"e": ("x", 0.5)}).orderBy("k", "t").select("e").collect()
    assert [r[0] for r in got] == [None, 10.0, 10.0, 15.0, 5.0]
    assert ema(rows.where("k = 'z'"), ["k"], ["t"], {"e": ("x", 0.5)}).count() == 0


def test_ema_is_the_recurrence(spark):
    rng = random.Random(9)
    rows = [(k, t, rng.choice([None, rng.gauss(0, 5), rng.gauss(0, 5)])) for k, n in (("a", 5000), ("b", 3), (None, 70), ("c", 500)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(5)
    want, state = {}, {}
    for k, t, x in rows:
        s = state.get(k)
        if x is not None:
            state[k] = s = x if s is None else 0.2 * x + 0.8 * s
        want[k, t] = s
    for rows_at_once in ("7", "2000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
        got = {(r.k, r.t): r.e for r in ema(df, ["k"], ["t"], {"e": ("x", 0.2)}).collect()}
        assert got == {key: v if v is None else pytest.approx(v) for key, v in want.items()}


def test_rolled_up_bars_equal_wide_ones(spark):
    rng = random.Random(7)
    rows = stamps(spark, [(i * 1_000_000, rng.choice("ab"), float(rng.randrange(100)), 1.0) for i in range(500)], "symbol string, price double, size double")
    narrow, wide = ohlcv(rows, "10s", ["symbol"]), ohlcv(rows, "1m", ["symbol"])
    assert sorted(rolled_up(narrow, "1m", ["symbol"]).collect()) == sorted(wide.collect())


def test_ordered_aggregates_over_keys(spark):
    rows = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, 1, 10.0), ("a", 3, 1, 20.0), ("b", 1, 1, 0.0)], "k string, t long, id long, x double")
    got = ordered_aggregate(rows, ["k"], d=("distinct_stats", "t", "id", "x")).orderBy("k").collect()
    assert got[0]["d"] == [15.0, pytest.approx(50**0.5), None] and got[1]["d"] == [0.0, None, None]


def test_latest_and_sessions(spark):
    rows = stamps(spark, [(0, "a"), (3, "a"), (20, "a"), (1, "b")], "k string")
    assert latest(rows, ["k"], "ts").orderBy("k").select("t").collect() == [(20,), (1,)]
    assert [r[0] for r in sessions(rows, ["k"], "ts", "5 us").orderBy("k", "ts").select("session").collect()] == [0, 0, 1, 0]


def said(place, snapshot, bids=(), asks=()):
    return Message(Place(*place), snapshot, list(bids), list(asks))


def test_book_rules():
    book = Book(2)
    assert book.message(said((7, 7), False, [(20.0, 1.0)])) is None  # nothing before a snapshot
    assert book.message(said((8, 8), True, [(20.0, 3.0), (19.5, 4.0)], [(20.5, 2.0)])) == (((20.0, 3.0), (19.5, 4.0)), ((20.5, 2.0),))
    assert book.message(said((9, 9), False, [(18.0, 5.0)])) is None  # below the top
    assert book.message(said((10, 10), False, [(20.75, 1.0)])) == (((20.75, 1.0), (20.0, 3.0)), ())  # crossed: the older side gives way
    assert book.message(said((9, 9), False, [(1.0, 1.0)])) is None  # old
    assert book.message(said((10, 10), False, [(20.75, 9.0)])) is None  # said already
    assert book.message(said((11, 11), False, [(float("inf"), 1.0), (21.0, float("nan"))])) is None
    assert book.message(said((12, 12), False, [(20.0, 0.0)])) == (((20.75, 1.0), (19.5, 4.0)), ())
    # A late snapshot is brought up to date with the changes after it.
    assert book.message(said((9, 9), True, [(20.0, 6.0)], [(21.5, 1.0)])) == (((20.75, 1.0), (18.0, 5.0)), ((21.5, 1.0),))


def test_levels_below_the_top_make_no_new_top(monkeypatch):
    made, top = [], Ladder.top
    monkeypatch.setattr(Ladder, "top", lambda self, n: made.append(n) or top(self, n))
    book = Book(2)
    book.message(said((1, 1), True, [(50.0, 1.0), (49.0, 1.0)], [(60.0, 1.0)]))
    assert all(book.message(said((k, k), False, [(float(40 - k), 1.0)])) is None for k in range(2, 30))
    assert len(made) == 2
    assert book.message(said((30, 30), False, [(49.0, 0.0)])) == (((50.0, 1.0), (38.0, 1.0)), ((60.0, 1.0),))


def test_levels_of_messages():
    kind = pa.list_(pa.float64())
    prices = pa.array([[9.0], [1.0, 2.0], None, [], [3.0], [None, 4.0]], kind).slice(1)
    amounts = pa.array([[9.0], [5.0], [1.0], [1.0], [4.0], [6.0, 7.0]], kind).slice(1)
    assert repr([tuple(x) for x in levels(prices, amounts)]) == "[((1.0, 5.0),), (), (), ((3.0, 4.0),), ((nan, 6.0), (4.0, 7.0))]"


def test_books_leave_out_null_levels(spark):
    rows = [("x", 1, True, 1, 1, [None, 5.0], [1.0, 2.0], None, None, 1), ("x", 1, None, 2, 2, None, None, [7.0], [None], 2), ("x", 1, False, 3, 3, None, None, [7.0, 8.0], [3.0, 4.0], 3)]
    df = spark.createDataFrame(rows, "exchange string, symbol long, is_snapshot boolean, time long, venue_sequence long, bid_price array<double>, bid_amount array<double>, ask_price array<double>, ask_amount array<double>, local_timestamp long")
    assert [tuple(r) for r in orderbook_top_n(df, 1).orderBy("time").collect()] == [("x", 1, 1, 1, [5.0], [2.0], [], []), ("x", 1, 3, 3, [5.0], [2.0], [7.0], [3.0])]


def test_late_snapshots_need_all_changes():
    book = Book(1)
    book.message(said((0, 1), True, [(5.0, 1.0)]))
    for k in range(2, KEPT + 4):
        book.message(said((0, k), False, [(5.0, float(k))]))
    assert book.message(said((0, 2), True, [(9.0, 1.0)])) is None  # changes since are gone
    assert book.message(said((0, 3), True, [(9.0, 1.0)])) == (((9.0, 1.0),), ())
    book.message(said((KEPT_US + 1, KEPT + 9), False, [(9.0, 2.0)]))
    assert book.message(said((0, KEPT + 1), True, [(3.0, 1.0)])) is None  # too long ago


def test_places_of_a_venue():
    assert Place(5, 2).before(Place(4, 3), False) and not Place(5, 2).before(Place(4, 3), True)
    assert Place(4, 0).before(Place(5, 1), True) and not Place(5, 0).before(Place(5, 9), False)
    book = Book(1, restarts=True)
    book.message(said((10, 90), True, [(5.0, 1.0)]))
    assert book.message(said((11, 1), False, [(6.0, 1.0)])) == (((6.0, 1.0),), ())  # sequences began again
    assert Book(1).due(said((1, 1), False)) == []


def test_books_are_brute_force(spark):
    """Random changes without old messages: each top is what a plain dict of levels says."""
    rng = random.Random(8)
    rows, want = [], []
    for sym in "ab":
        sides, shown = {"bid": {}, "ask": {}}, None
        for k in range(200):
            bids = [(float(rng.randint(1, 20)), float(rng.choice([0, 1, 2]))) for _ in range(rng.randint(0, 2))]
            asks = [(float(rng.randint(21, 40)), float(rng.choice([0, 1, 2]))) for _ in range(rng.randint(0, 2))]
            rows.append(("x", sym, k == 0, k, k + 1, [p for p, _ in bids], [a for _, a in bids], [p for p, _ in asks], [a for _, a in asks], k))
            for side, levels in (("bid", bids), ("ask", asks)):
                for price, amount in levels:
                    sides[side][price] = amount
            now = [sorted(((p, a) for p, a in sides[x].items() if a), reverse=x == "bid")[:3] for x in ("bid", "ask")]
            if now != (shown or [[], []]):
                want.append((sym, k, *([v[i] for v in side] for side in now for i in (0, 1))))
                shown = now
    df = spark.createDataFrame(rows, "exchange string, symbol string, is_snapshot boolean, time long, venue_sequence long, bid_price array<double>, bid_amount array<double>, ask_price array<double>, ask_amount array<double>, local_timestamp long")
    got = orderbook_top_n(df.repartition(5), 3).select("symbol", "time", "bid_price", "bid_amount", "ask_price", "ask_amount").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_orderbook_needs_its_columns(spark):
    with pytest.raises(ValueError, match="venue_sequence"):
        orderbook_top_n(spark.createDataFrame([(1, "a", True, 1)], "exchange long, symbol string, is_snapshot boolean, time long"), 5)
