"""Iceberg tables: the current snapshot's data files, from its manifests."""

from __future__ import annotations

import io
import json
import struct
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Avro:
    """A reader of Avro container files (null and deflate codecs)."""

    def __init__(self, data: bytes) -> None:
        self.at = io.BytesIO(data)
        if self.at.read(4) != b"Obj\x01":
            raise ValueError("not an Avro file")
        meta = self.map(lambda: self.bytes_())
        self.schema = json.loads(meta["avro.schema"])
        self.codec = meta.get("avro.codec", b"null").decode()
        self.sync = self.at.read(16)
        self.names: dict[str, Any] = {}

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.at.read(1)[0]
            out |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return (out >> 1) ^ -(out & 1)

    def bytes_(self) -> bytes:
        return self.at.read(self.long())

    def blocks(self, one) -> list:
        out = []
        while n := self.long():
            if n < 0:
                self.long()
            out += [one() for _ in range(abs(n))]
        return out

    def map(self, value) -> dict:
        return dict(self.blocks(lambda: (self.bytes_().decode(), value())))

    def value(self, schema: Any) -> Any:
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema if isinstance(schema, str) else schema["type"]
        if isinstance(kind, (dict, list)):
            return self.value(kind)
        if isinstance(schema, dict) and "name" in schema:
            self.names[schema["name"]] = schema
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if kind == "array":
            return self.blocks(lambda: self.value(schema["items"]))
        if kind == "map":
            return self.map(lambda: self.value(schema["values"]))
        if kind in ("int", "long"):
            return self.long()
        if kind == "string":
            return self.bytes_().decode()
        if kind == "bytes":
            return self.bytes_()
        if kind == "fixed":
            return self.at.read(schema["size"])
        if kind == "boolean":
            return self.at.read(1) == b"\x01"
        if kind == "float":
            return struct.unpack("<f", self.at.read(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.at.read(8))[0]
        if kind == "null":
            return None
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind in self.names:
            return self.value(self.names[kind])
        raise ValueError(f"unknown Avro type {kind!r}")

    def rows(self) -> list:
        import zlib

        out = []
        whole, end = self.at, self.at.getbuffer().nbytes
        while whole.tell() < end:
            self.at = whole
            n, data = self.long(), self.bytes_()
            if self.at.read(16) != self.sync:
                raise ValueError("a damaged Avro file")
            if self.codec == "deflate":
                data = zlib.decompress(data, -15)
            elif self.codec != "null":
                raise ValueError(f"Avro codec {self.codec} isn't supported")
            self.at = io.BytesIO(data)
            out += [self.value(self.schema) for _ in range(n)]
        self.at = whole
        return out


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_iceberg(spark: SparkSession, path: str) -> DataFrame:
    """The table at its current snapshot.  Paths below the table's old location are
    taken from where it lies now; delete files are refused."""
    root = path.rstrip("/")
    names = [r[0] for r in spark.read.format("binaryFile").load(f"{root}/metadata/*.metadata.json").select("path").collect()]
    newest = max(names, key=lambda n: (len(n.rsplit("/", 1)[-1].split("-")[0]), n.rsplit("/", 1)[-1]))
    meta = json.loads(_content(spark, newest))
    location = meta["location"].rstrip("/")

    def here(p: str) -> str:
        return root + p[len(location) :] if p.startswith(location) else p

    now = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == meta.get("current-snapshot-id")), None)
    schemas = {s["schema-id"]: s for s in meta.get("schemas", [])} or {0: meta["schema"]}
    fields = schemas[meta.get("current-schema-id", 0)]["fields"]
    if now is None:
        raise ValueError(f"{path}: the table has no snapshot")
    files: list[str] = []
    for manifest in Avro(_content(spark, here(now["manifest-list"]))).rows():
        if manifest.get("content", 0):
            raise ValueError(f"{path}: delete files aren't supported")
        for entry in Avro(_content(spark, here(manifest["manifest_path"]))).rows():
            if entry["status"] != 2:
                if entry["data_file"]["file_format"].upper() != "PARQUET":
                    raise ValueError(f"{path}: {entry['data_file']['file_format']} files aren't supported")
                files.append(here(entry["data_file"]["file_path"]))
    df = spark.read.option("mergeSchema", "true").parquet(*files)
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{f['name']}`") if f["name"].lower() in have else F.lit(None).alias(f["name"]) for f in fields])
