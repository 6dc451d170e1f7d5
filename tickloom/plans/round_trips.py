"""Registered queries that write a table in another format, and read it back; and books over shipments."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Session
from ..shared import passing

#: What puts a supplier's lines in one order.
PLACE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
_EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM events"
_SUMS = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(ts) AS began, max(ts) AS ended, max(event_id) AS last_id FROM {rows} GROUP BY event_type"


def csv_round_trip(s: Session) -> DataFrame:
    """All events as compressed CSV without a header."""
    place = passing(s.spark, "csv")
    s.sql(f"COPY ({_EVENTS}) TO '{place}' (FORMAT csv, HEADER false, COMPRESSION gzip)")
    names = "{'event_id': 'BIGINT', 'ts': 'TIMESTAMP', 'user_id': 'BIGINT', 'event_type': 'VARCHAR', 'value': 'DOUBLE'}"
    return s.query(_SUMS.format(rows=f"read_csv('{place}', header = false, columns = {names})"))


def json_round_trip(s: Session) -> DataFrame:
    """All events as JSON lines."""
    place = passing(s.spark, "json")
    s.sql(f"COPY ({_EVENTS}) TO '{place}' (FORMAT json)")
    return s.query(_SUMS.format(rows=f"read_json('{place}')"))


def hive_round_trip(s: Session) -> DataFrame:
    """All shipments in folders by flag and status; one folder's files aren't read."""
    place = passing(s.spark, "hive")
    s.sql(f"COPY (SELECT l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem) TO '{place}' (FORMAT parquet, PARTITION_BY (l_returnflag, l_linestatus))")
    return s.query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS pieces, max(l_shipdate) AS latest FROM '{place}' WHERE l_returnflag <> 'N' GROUP BY l_returnflag, l_linestatus")


def delta_round_trip(s: Session) -> DataFrame:
    """All orders as a Delta table in two versions: the second takes the small orders' files away."""
    place = passing(s.spark, "delta")
    large = "o_totalprice > 200000"
    parts = [("small", f"NOT ({large})"), ("large", large)]
    for name, condition in parts:
        s.sql(f"COPY (SELECT * FROM orders WHERE {condition}) TO '{place}/{name}' (FORMAT parquet)")
    files = {name: _files(s.spark, f"{place}/{name}") for name, _ in parts}
    fields = [{"name": f.name, "type": {"bigint": "long", "timestamp_ntz": "timestamp_ntz"}.get(f.dataType.simpleString(), f.dataType.simpleString()), "nullable": True, "metadata": {}} for f in s.table("orders").schema]
    added = [{"add": {"path": f"{name}/{f}", "partitionValues": {}, "size": n, "dataChange": True}} for name, own in files.items() for f, n in own]
    _commit(s.spark, place, 0, [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": []}}, *added])
    _commit(s.spark, place, 1, [{"remove": {"path": f"small/{f}", "dataChange": True}} for f, _ in files["small"]])
    return s.query(f"SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_orderdate) AS latest FROM delta_scan('{place}') GROUP BY o_orderpriority")


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The data files of a folder, with their lengths."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return [(f.getPath().getName(), f.getLen()) for f in found if f.getPath().getName().endswith(".parquet")]


def _commit(spark: SparkSession, folder: str, version: int, actions: list[dict]) -> None:
    """A version of a Delta log."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_delta_log/{version:020d}.json")
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write("\n".join(map(json.dumps, actions)).encode())
    out.close()


def shipment_books(s: Session) -> DataFrame:
    """A book for each supplier: returned lines bid the negative of their price, others ask it, in the
    order of their columns.  A row whenever a best level changes."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*PLACE)).cast("long")
    s.register("placed_lines", s.table("lineitem").withColumn("place", place))
    s.sql("""
      CREATE OR REPLACE VIEW shipment_updates AS
      SELECT 'depot' AS exchange, l_suppkey AS symbol, place = 1 AS is_snapshot, place AS time, place AS venue_sequence, place AS local_timestamp,
             CASE WHEN l_returnflag = 'R' THEN [-l_extendedprice] END AS bid_price, CASE WHEN l_returnflag = 'R' THEN [l_quantity] END AS bid_amount,
             CASE WHEN l_returnflag <> 'R' THEN [l_extendedprice] END AS ask_price, CASE WHEN l_returnflag <> 'R' THEN [l_quantity] END AS ask_amount
      FROM placed_lines""")
    return s.query("SELECT symbol AS l_suppkey, local_timestamp AS place, bid_price[1] AS bid, bid_amount[1] AS bid_pieces, ask_price[1] AS ask, ask_amount[1] AS ask_pieces FROM orderbook_top_n(shipment_updates, 1)")


#: name: (the query, DuckDB's spelling over the table itself)
MADE: dict[str, tuple[Callable[[Session], DataFrame], str]] = {
    "csv_round_trip": (csv_round_trip, _SUMS.format(rows="events")),
    "json_round_trip": (json_round_trip, _SUMS.format(rows="events")),
    "hive_round_trip": (hive_round_trip, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS pieces, max(l_shipdate) AS latest FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag, l_linestatus"),
    "delta_round_trip": (delta_round_trip, "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_orderdate) AS latest FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority"),
    "shipment_books": (
        shipment_books,
        """
WITH told AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {place}) AS place, l_extendedprice AS price, l_quantity AS pieces, l_returnflag = 'R' AS back FROM lineitem),
best AS (SELECT l_suppkey, place,
    min(price) FILTER (WHERE back) OVER w AS bid, arg_min(pieces, (price, -place)) FILTER (WHERE back) OVER w AS bid_pieces,
    min(price) FILTER (WHERE NOT back) OVER w AS ask, arg_min(pieces, (price, -place)) FILTER (WHERE NOT back) OVER w AS ask_pieces
  FROM told WINDOW w AS (PARTITION BY l_suppkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (SELECT *, lag((bid, bid_pieces, ask, ask_pieces)) OVER (PARTITION BY l_suppkey ORDER BY place) AS before FROM best)
SELECT l_suppkey, place, -bid AS bid, bid_pieces, ask, ask_pieces FROM steps WHERE before IS DISTINCT FROM (bid, bid_pieces, ask, ask_pieces)""".replace("{place}", ", ".join(PLACE)),
    ),
}
