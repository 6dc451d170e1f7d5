"""The dialect over small files: answers worked out by hand, and what is refused."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from tickloom.session import Session
from tickloom.sql.parser import SqlError, parse

SALES = """ts,shop,price,cups,way
2024-05-06T09:00:04,K,30,4,sell
2024-05-06T09:00:11,M,12,1,buy
2024-05-06T09:00:40,K,33,1,buy
2024-05-06T09:01:02,M,15,5,sell
2024-05-06T09:01:31,K,27,2,buy
2024-05-06T09:02:50,K,36,3,sell
2024-05-06T09:03:10,M,9,2,buy
"""
OFFERS = """ts,shop,low,high
2024-05-06T09:00:00,K,29,31
2024-05-06T09:00:10,M,11,13
2024-05-06T09:00:40,K,32,34
2024-05-06T09:01:20,K,26,28
2024-05-06T09:03:00,M,8,10
"""


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"2024-05-06T{text}")


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("base")
    (base / "sales.csv").write_text(SALES)
    (base / "offers.csv").write_text(OFFERS)
    (base / "shops.csv").write_text("shop,town\nM,Ulm\nK,Jena\nP,Kiel\nK,Bonn\n")
    out = Session(spark, str(base))
    out.register("nulls", spark.createDataFrame([("x", 1.0), ("x", None), (None, float("nan")), (None, 2.0)], "k string, v double"))
    return out


def rows(s: Session, sql: str) -> list[tuple]:
    return s.sql(sql).fetchall()


def test_bars(s):
    got = rows(s, "SELECT time_bucket('1m', ts) AS minute, shop, first(price, ts), max(price), min(price), last(price, ts), sum(cups) FROM sales GROUP BY minute, shop ORDER BY minute, shop LIMIT 3")
    assert got == [(at("09:00:00"), "K", 30, 33, 30, 33, 5), (at("09:00:00"), "M", 12, 12, 12, 12, 1), (at("09:01:00"), "K", 27, 27, 27, 27, 2)]


@pytest.mark.parametrize(
    ("join", "condition", "want"),
    [
        ("ASOF JOIN", "t.ts >= q.ts", [29, 11, 32, 11, 26, 26, 8]),
        ("ASOF JOIN", "t.ts > q.ts", [29, 11, 29, 11, 26, 26, 8]),
        ("ASOF LEFT JOIN", "t.ts >= q.ts AND t.ts - q.ts <= INTERVAL '12 seconds'", [29, 11, 32, None, 26, None, 8]),
        ("ASOF JOIN", "t.ts + INTERVAL '45 seconds' >= q.ts", [32, 11, 26, 11, 26, 26, 8]),
    ],
)
def test_asof_joins(s, join, condition, want):
    assert [low for (low,) in rows(s, f"SELECT q.low FROM sales t {join} offers q ON t.shop = q.shop AND {condition} ORDER BY t.ts")] == want


@pytest.mark.parametrize(
    "joins",
    [
        "ASOF LEFT JOIN offers q ON t.shop = q.shop AND t.ts >= q.ts",
        "ASOF JOIN offers q ON t.shop = q.shop AND t.ts + INTERVAL '45 seconds' >= q.ts AND t.ts - q.ts <= INTERVAL '8 seconds'",
        "ASOF LEFT JOIN offers q ON t.shop = q.shop AND t.ts > q.ts ASOF LEFT JOIN offers p ON t.shop = p.shop AND t.ts >= p.ts - INTERVAL '35 seconds' ASOF JOIN offers z ON t.shop = z.shop AND q.ts >= z.ts",
    ],
)
def test_asof_slices_change_nothing(spark, s, joins):
    """Sliced joins are made one by one, others together."""
    sliced = Session(spark, s.base, asof_slices="25 seconds")
    more = ", p.low AS b2, z.low AS b3" if " z " in joins else ""
    sql = f"SELECT t.ts, t.shop, q.low{more} FROM sales t {joins} ORDER BY t.ts"
    assert rows(sliced, sql) == rows(s, sql) and rows(s, sql)


def test_lookup_join_takes_the_last_match_once(s):
    got = rows(s, "SELECT t.shop, i.town, count(*) AS n FROM sales t JOIN shops i ON t.shop = i.shop GROUP BY t.shop, i.town ORDER BY t.shop")
    assert got == [("K", "Bonn", 4), ("M", "Ulm", 3)]


def test_window_join(s):
    sql = "SELECT t.ts, w.n, w.top FROM sales t LEFT JOIN LATERAL (SELECT count(*) AS n, max(q.low) AS top FROM offers q WHERE q.shop = t.shop AND q.ts BETWEEN t.ts - INTERVAL '45 seconds' AND t.ts) w ON true ORDER BY t.ts"
    assert [(n, top) for _, n, top in rows(s, sql)] == [(1, 29), (1, 11), (2, 32), (0, None), (1, 26), (0, None), (1, 8)]


def test_gap_filling(s):
    sql = "SELECT time_bucket_gapfill('40s', ts) AS b, shop, locf(last(price, ts)) AS c, interpolate(last(price, ts)) AS i, count(*) AS n FROM sales WHERE shop = 'K' GROUP BY b, shop ORDER BY b"
    assert [r[2:] for r in rows(s, sql)] == [(30, 30.0, 1), (33, 33.0, 1), (27, 27.0, 1), (27, 31.5, None), (36, 36.0, 1)]


def test_windows(s):
    sql = "SELECT shop, ema(price, 3) OVER w AS e, sum(cups) OVER w AS c, lag(price, 1, 0) OVER w AS l, row_number() OVER w AS n FROM sales WINDOW w AS (PARTITION BY shop ORDER BY ts) ORDER BY shop, n"
    assert rows(s, sql)[:3] == [("K", 30.0, 4, 0, 1), ("K", 31.5, 5, 30, 2), ("K", 29.25, 7, 33, 3)]


def test_ranges_of_time(s):
    over = "OVER (PARTITION BY shop ORDER BY ts {} RANGE BETWEEN {} AND {})"
    back, ahead = over.format("", "INTERVAL '1 minute' PRECEDING", "CURRENT ROW"), over.format("DESC", "INTERVAL '60 seconds' PRECEDING", "INTERVAL '5 s' FOLLOWING")
    got = rows(s, f"SELECT shop, price, sum(cups) {back} AS c, avg(price) FILTER (WHERE way = 'buy') {back} AS b, max(price) {ahead} + 1 AS m, count(*) {ahead} AS n FROM sales WHERE cups < 5 ORDER BY ts")
    assert got == [("K", 30, 4, None, 34, 2), ("M", 12, 1, 12.0, 13, 1), ("K", 33, 5, 33.0, 34, 2), ("K", 27, 3, 30.0, 28, 1), ("K", 36, 3, None, 37, 1), ("M", 9, 2, 9.0, 10, 1)]


def test_aggregates_over_windows(s):
    sql = """
      SELECT shop, corr(price, cups) OVER w AS c, count(DISTINCT way) OVER w AS d, uniq_exact(price) OVER w AS u, skewness(price) OVER w AS sk, kurtosis(price) OVER w AS ku,
             kurtosis_pop(price) OVER w AS kp, string_agg(way, '+') OVER w AS ways, vwap(price, cups) OVER w AS v, avg(price) FILTER (WHERE way = 'buy') OVER w AS b
      FROM sales WINDOW w AS (PARTITION BY shop ORDER BY ts) ORDER BY shop, ts"""
    got = rows(s, sql)[3]
    x, y = [30, 33, 27, 36], [4, 1, 2, 3]
    mx, my = sum(x) / 4, sum(y) / 4
    m2, m3, m4 = (sum((v - mx) ** k for v in x) / 4 for k in (2, 3, 4))
    corr = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    pop = m4 / m2**2 - 3
    assert got[:7] == ("K", pytest.approx(corr), 2, 4, pytest.approx(math.sqrt(12) / 2 * m3 / m2**1.5, abs=1e-9), pytest.approx(3 / 2 * (5 * pop + 6)), pytest.approx(pop))
    assert got[7:] == ("sell+buy+buy+sell", pytest.approx(sum(a * b for a, b in zip(x, y, strict=True)) / 10), 30.0)


def test_integers_wrap(s):
    s.register("big", s.spark.createDataFrame([(2**63 - 1,), (2**62,)], "i long"))
    assert sorted(r[0] for r in rows(s, "SELECT i + 1 FROM big")) == [-(2**63), 2**62 + 1]
    assert rows(s, "SELECT sum(i) FROM big") == [(2**63 - 1 + 2**62 - 2**64,)]
    assert rows(s, "SELECT i * 4 FROM big WHERE i = 4611686018427387904") == [(0,)]


def test_epochs_of_numbers_are_times(s):
    got = rows(s, "SELECT epoch_ms(1700000000000), epoch_us(1700000000000000), epoch_ns(1700000000000000000), epoch_ms(TIMESTAMP '2023-11-14 22:13:20')")[0]
    assert got == (dt.datetime(2023, 11, 14, 22, 13, 20),) * 3 + (1700000000000,)


def test_joins_read_what_is_asked_for(spark, s, tmp_path):
    spark.range(5).selectExpr("id AS k", "timestamp_micros(id) AS ts", "id AS v", "'x' AS unread").write.parquet(str(tmp_path / "t.parquet"))
    own = Session(spark, str(tmp_path))
    for join in ("ASOF JOIN (SELECT * FROM t) b ON a.k = b.k AND a.ts >= b.ts", "JOIN (SELECT * FROM t) b ON a.k = b.k"):
        plan = own.sql(f"EXPLAIN SELECT a.v, b.v AS w FROM (SELECT * FROM t) a {join}").message.split("Physical Plan")[1]
        assert "ReadSchema" in plan and "unread" not in plan


def test_default_frame_is_by_row(spark, s):
    s.register("ties", spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "t long, x long"))
    assert sorted(r[0] for r in rows(s, "SELECT sum(x) OVER (ORDER BY t, x) AS c FROM ties")) == [1, 3, 6]
    assert len({r[0] for r in rows(s, "SELECT sum(x) OVER (ORDER BY t) AS c FROM ties")}) == 3


def test_pivot_and_unpivot(s):
    assert rows(s, "PIVOT (SELECT shop, way, cups FROM sales) ON way USING sum(cups) GROUP BY shop ORDER BY shop") == [("K", 3, 7), ("M", 3, 5)]
    assert rows(s, "SELECT * FROM (SELECT shop, way, cups FROM sales) PIVOT (sum(cups) FOR way IN ('buy', 'sell')) ORDER BY shop") == [("K", 3, 7), ("M", 3, 5)]
    assert rows(s, "SELECT name, value FROM (SELECT price, cups FROM sales WHERE price = 30) UNPIVOT (value FOR name IN (price, cups)) ORDER BY name") == [("cups", 4), ("price", 30)]


def test_scalars(s):
    sql = "SELECT 1 / 0, 0 / 0, 7 % 0, log(100), substr('hello', 0, 2), split_part('a,b', ',', 0), regexp_replace('aXbX', 'X', '-'), regexp_extract('a12', '[0-9]+'), round(2.5), round(-2.5), 1 IN (2, NULL), 'a\\b' LIKE 'a\\b', length('é'), trim(' x\t'), dow(TIMESTAMP '2024-01-07 00:00:00'), date_diff('month', TIMESTAMP '2024-01-31 00:00:00', TIMESTAMP '2024-02-01 00:00:00')"
    got = rows(s, sql)[0]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] is None
    assert got[3:] == (2.0, "h", "", "a-bX", "12", 3.0, -3.0, False, True, 1, "x", 0, 1)


def test_nulls(s):
    assert rows(s, "SELECT count(*), count(v), median(v), sum(v) FILTER (WHERE k = 'x') FROM nulls") == [(4, 3, 1.5, 1.0)]
    assert [k for (k,) in rows(s, "SELECT DISTINCT k FROM nulls ORDER BY k")] == ["x", None]
    assert [k for (k,) in rows(s, "SELECT DISTINCT k FROM nulls ORDER BY k DESC")] == [None, "x"]


def test_alias_reuse_and_names(s):
    got = s.sql("SELECT price * 2 AS p, p + 1 AS q, price, price, price + 1 FROM sales ORDER BY ts LIMIT 1")
    assert got.columns == ["p", "q", "price", "price_1", "price + 1"] and got.fetchone() == (60, 61, 30, 30, 31)


def test_zones(s):
    sql = "SELECT time_bucket('1 day', TIMESTAMP '2024-03-10 12:00:00', 'America/New_York'), time_bucket('1 day', TIMESTAMP '2024-03-11 12:00:00', 'America/New_York'), time_bucket('1h', TIMESTAMP '2024-11-03 06:30:00', 'America/New_York')"
    assert rows(s, sql) == [(dt.datetime(2024, 3, 10, 5), dt.datetime(2024, 3, 11, 4), dt.datetime(2024, 11, 3, 6))]


def test_ordered_aggregates(s):
    sql = "SELECT shop, twap(price, ts), updownticks((ts, cups, price, cups)), run_structure((ts, cups, way, price)) FROM sales GROUP BY shop ORDER BY shop LIMIT 1"
    shop, twap, ticks, runs = rows(s, sql)[0]
    assert twap == pytest.approx((30 * 36 + 33 * 51 + 27 * 79) / 166)
    assert ticks == [2, 1, 0, 4, 2, 0]
    assert runs == pytest.approx([2, 1, 2, 1, 2, 4, (33 / 30 - 1 + 36 / 27 - 1) / 2])


def test_statements(s, tmp_path):
    s.sql("CREATE VIEW k_only AS SELECT * FROM sales WHERE shop = 'K'")
    assert rows(s, "SELECT count(*) FROM k_only") == [(4,)]
    with pytest.raises(SqlError):
        s.sql("CREATE VIEW k_only AS SELECT 1 AS x")
    out = str(tmp_path / "out.parquet")
    s.sql(f"COPY (SELECT * FROM k_only) TO '{out}'")
    assert rows(s, f"SELECT count(*) FROM '{out}'") == [(4,)]
    parts = str(tmp_path / "parts")
    s.sql(f"COPY sales TO '{parts}' (FORMAT parquet, PARTITION_BY (shop))")
    assert rows(s, f"SELECT sum(cups) FROM '{parts}' WHERE shop = 'M'") == [(8,)]
    with pytest.raises(ValueError):
        s.sql(f"COPY sales TO '{parts}' (FORMAT parquet, PARTITION_BY (shop))")
    assert ("ts", "timestamp") in rows(s, "DESCRIBE k_only")
    assert "Physical Plan" in s.sql("EXPLAIN SELECT count(*) FROM sales").message
    s.sql("DROP VIEW k_only")
    assert rows(s, "SHOW TABLES") and ("k_only",) not in rows(s, "SHOW TABLES")


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT nope FROM sales", "no column 'nope'"),
        ("SELECT * FROM nowhere", "no table 'nowhere'"),
        ("SELECT meadian(price) FROM sales", "did you mean median"),
        ("SELECT * FROM sales, offers", "comma between tables"),
        ("SELECT * FROM sales RIGHT JOIN offers ON sales.shop = offers.shop", "RIGHT JOIN"),
        ("SELECT * FROM sales CROSS JOIN offers", "CROSS JOIN"),
        ("SELECT * FROM sales t JOIN offers q ON t.ts > q.ts", "equalities"),
        ("SELECT * FROM sales t ASOF JOIN offers q ON t.shop = q.shop", "time condition"),
        ("SELECT shop FROM sales INTERSECT SELECT shop FROM offers", "INTERSECT"),
        ("SELECT DISTINCT ON (shop) * FROM sales", "DISTINCT ON"),
        ("SELECT shop FROM sales WHERE shop IN (SELECT shop FROM offers)", "IN (SELECT"),
        ("SELECT row_number() FROM sales", "OVER"),
        ("SELECT sum(DISTINCT price) FROM sales", "DISTINCT"),
        ("SELECT shop FROM sales WHERE sum(price) > 1", "HAVING"),
        ("SELECT * EXCEPT (price) FROM sales", "EXCEPT"),
        ("SELECT time_bucket('1 month', ts) FROM sales", "unit"),
        ("SELECT shop FROM sales t JOIN offers q ON t.shop = q.shop", "write t.shop"),
        ("SELECT price FROM sales QUALIFY price > 1", "QUALIFY"),
        ("SELECT (SELECT 1) FROM sales", "query as a value"),
        ("SELECT price FROM sales LIMIT 1 garbage", "unexpected"),
    ],
)
def test_refused(s, sql, message):
    with pytest.raises(ValueError, match="(?i)" + message.replace("(", r"\(")):
        s.sql(sql)


def test_parser_keeps_precedence():
    e = parse("SELECT a + b * c - d AND NOT x OR y").body.items[0].expr
    assert e.op == "OR" and e.left.op == "AND" and e.left.left.op == "-" and e.left.left.left.right.op == "*"


def test_deep_nesting_is_refused():
    with pytest.raises(SqlError, match="deeply"):
        parse("SELECT " + "(" * 5000 + "1" + ")" * 5000)
