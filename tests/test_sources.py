"""Readers: CSV options, time texts, JSON, Hive partitions, Delta, Iceberg and DBN files made here."""

from __future__ import annotations

import datetime as dt
import json
import struct

import pytest

from tickloom.session import Session
from tickloom.sources.dbn import read_dbn
from tickloom.sources.files import SourceError, kind_of, sniffed
from tickloom.sources.iceberg import Avro


def test_kinds():
    assert [kind_of(x) for x in ("a.csv.gz", "b/c.parquet", "d.ndjson", "e", "s3://b/x.tsv")] == ["csv", "parquet", "json", "", "csv"]
    assert sniffed(["a;b", "1;2"]) == ";" and sniffed(["a", "b"]) == ","


def test_csv_options(spark, tmp_path):
    (tmp_path / "x.csv").write_text("junk line\nts|v|n\n2024.01.02D09:30:00.5|1|NA\n2024.01.02D09:31:00|2|3\n")
    got = Session(spark, str(tmp_path)).sql("SELECT * FROM read_csv('x.csv', skip = 1, delim = '|', nullstr = 'NA')").fetchall()
    assert got == [(dt.datetime(2024, 1, 2, 9, 30, 0, 500000), 1, None), (dt.datetime(2024, 1, 2, 9, 31), 2, 3)]
    (tmp_path / "y.csv").write_text("t,v\n1704067200,1\n")
    got = Session(spark, str(tmp_path)).sql("SELECT t FROM read_csv('y.csv', types = {'t': 'TIMESTAMP_S'})").fetchall()
    assert got == [(dt.datetime(2024, 1, 1),)]
    with pytest.raises(SourceError, match="unknown option"):
        Session(spark, str(tmp_path)).sql("SELECT * FROM read_csv('y.csv', bad = 1)")


def test_json_keeps_order_and_times(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"z": "2024-01-01T00:00:00Z", "a": 1}\n{"z": "2024-01-01T00:00:01Z", "a": 2}\n')
    r = Session(spark, str(tmp_path)).sql("SELECT * FROM x ORDER BY a")
    assert r.columns == ["z", "a"] and r.fetchall()[1] == (dt.datetime(2024, 1, 1, 0, 0, 1), 2)


def test_hive_partitions(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "v long, p string").write.partitionBy("p").parquet(str(tmp_path / "t"))
    assert sorted(Session(spark).sql(f"SELECT v, p FROM '{tmp_path}/t'").fetchall()) == [(1, "x"), (2, None)]


def test_missing(spark, tmp_path):
    with pytest.raises(SourceError):
        Session(spark, str(tmp_path)).sql("SELECT * FROM 'nothing_here'")


def test_delta(spark, tmp_path):
    root = tmp_path / "d"
    for day, v in (("1", 10), ("2", 20), ("1", 11)):
        spark.createDataFrame([(v,)], "v long").coalesce(1).write.parquet(str(root / f"w{v}"))
    log = root / "_delta_log"
    log.mkdir()
    schema = {"type": "struct", "fields": [{"name": "v", "type": "long", "nullable": True, "metadata": {}}, {"name": "day", "type": "string", "nullable": True, "metadata": {}}]}

    def add(v, day):
        part = next((root / f"w{v}").glob("*.parquet")).name
        return {"add": {"path": f"w{v}/{part}", "partitionValues": {"day": day}, "dataChange": True}}

    first = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"schemaString": json.dumps(schema), "partitionColumns": ["day"]}}, add(10, "1"), add(20, "2")]
    (log / f"{0:020d}.json").write_text("\n".join(map(json.dumps, first)))
    (log / f"{1:020d}.json").write_text("\n".join(map(json.dumps, [{"remove": {"path": add(10, "1")["add"]["path"]}}, add(11, "1")])))
    assert sorted(Session(spark).sql(f"SELECT v, day FROM delta_scan('{root}')").fetchall()) == [(11, "1"), (20, "2")]
    assert Session(spark).sql(f"SELECT count(*) FROM '{root}' WHERE day = '2'").fetchall() == [(1,)]


def zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def text(x: str) -> bytes:
    return zigzag(len(x.encode())) + x.encode()


def avro(schema: dict, rows: list[bytes]) -> bytes:
    sync = b"0123456789abcdef"
    body = b"".join(rows)
    head = b"Obj\x01" + zigzag(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text("null") + zigzag(0) + sync
    return head + zigzag(len(rows)) + zigzag(len(body)) + body + sync


def test_avro_and_iceberg(spark, tmp_path):
    record = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]}
    assert Avro(avro(record, [zigzag(-3) + zigzag(1) + text("x"), zigzag(300) + zigzag(0)])).rows() == [{"a": -3, "b": "x"}, {"a": 300, "b": None}]
    root = tmp_path / "ice"
    spark.createDataFrame([(1, "a"), (2, "b")], "v long, s string").coalesce(1).write.parquet(str(root / "data"))
    part = next((root / "data").glob("*.parquet"))
    (root / "metadata").mkdir()
    lists = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    entries = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}]}}]}
    (root / "metadata" / "list.avro").write_bytes(avro(lists, [text("s3://old/metadata/m.avro") + zigzag(0)]))
    (root / "metadata" / "m.avro").write_bytes(avro(entries, [zigzag(1) + text(f"s3://old/data/{part.name}") + text("PARQUET"), zigzag(2) + text("s3://old/data/gone.parquet") + text("PARQUET")]))
    meta = {"location": "s3://old", "current-snapshot-id": 5, "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"name": "v"}, {"name": "s"}]}], "snapshots": [{"snapshot-id": 5, "manifest-list": "s3://old/metadata/list.avro"}]}
    (root / "metadata" / "00001-x.metadata.json").write_text(json.dumps(meta))
    assert sorted(Session(spark).sql(f"SELECT * FROM iceberg_scan('{root}')").fetchall()) == [(1, "a"), (2, "b")]


def test_dbn(spark, tmp_path):
    def c(x: str, n: int = 22) -> bytes:
        return x.encode().ljust(n, b"\0")

    fixed = c("XNAS.ITCH", 16) + struct.pack("<H", 0) + struct.pack("<QQQ", 0, 0, 0) + b"\0\0\0"
    head = fixed.ljust(100, b"\0") + struct.pack("<I", 0) + struct.pack("<III", 0, 0, 0) + struct.pack("<I", 1) + c("ABC") + struct.pack("<I", 1) + struct.pack("<II", 20240101, 20240102) + c("7")
    record = struct.pack("<BBHIQ", 12, 0, 1, 7, 1_704_067_200_000_000_123) + struct.pack("<qIccBBQiI", 101_500_000_000, 5, b"T", b"B", 0, 0, 1_704_067_200_000_001_000, 7, 9)
    record = record[:0] + bytes([len(record) // 4]) + record[1:]
    (tmp_path / "x.dbn").write_bytes(b"DBN\x01" + struct.pack("<I", len(head)) + head + record + record)
    got = read_dbn(spark, str(tmp_path / "x.dbn")).select("ts_event", "price", "size", "side", "symbol").collect()
    assert got == [(dt.datetime(2024, 1, 1), 101.5, 5, "B", "ABC")] * 2
