"""Delta Lake tables: the log replayed to the list of live files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reader features that change nothing for a plain read of files.
KNOWN_FEATURES = {"timestampNtz", "appendOnly", "invariants"}


def live_files(spark: SparkSession, path: str) -> tuple[dict[str, dict], dict]:
    """Live files (path to its add action) and the table's metadata, at the newest version."""
    log = f"{path.rstrip('/')}/_delta_log"
    files: dict[str, dict] = {}
    meta: dict = {}
    start = -1
    from .files import exists

    def act(a: dict) -> None:
        nonlocal meta
        if a.get("add"):
            if a["add"].get("deletionVector"):
                raise ValueError(f"{path}: deletion vectors aren't supported")
            files[a["add"]["path"]] = a["add"]
        elif a.get("remove"):
            files.pop(a["remove"]["path"], None)
        elif a.get("metaData"):
            meta = a["metaData"]
        elif a.get("protocol"):
            asked = set(a["protocol"].get("readerFeatures") or ()) - KNOWN_FEATURES
            if a["protocol"].get("minReaderVersion", 1) >= 3 and asked:
                raise ValueError(f"{path}: the table needs {', '.join(sorted(asked))}, which isn't supported")
            if a["protocol"].get("minReaderVersion", 1) == 2:
                raise ValueError(f"{path}: column mapping isn't supported")

    if exists(spark, f"{log}/_last_checkpoint"):
        last = json.loads(spark.read.text(f"{log}/_last_checkpoint").first()[0])
        start = int(last["version"])
        name = f"{log}/{start:020d}.checkpoint*.parquet"
        if exists(spark, name):
            for row in spark.read.parquet(name).select(F.to_json(F.struct("*")).alias("a")).toLocalIterator():
                act(json.loads(row[0]))
        else:
            start = -1
    lines = spark.read.text(f"{log}/*.json").withColumn("_file", F.input_file_name())
    version = F.regexp_extract("_file", r"(\d{20})\.json$", 1).cast("long")
    for row in lines.withColumn("v", version).where(f"v > {start}").orderBy("v", F.monotonically_increasing_id()).toLocalIterator():
        act(json.loads(row["value"]))
    return files, meta


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """The table at its newest version; partition columns come from the log."""
    files, meta = live_files(spark, path)
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    parts = meta.get("partitionColumns") or []
    root = path.rstrip("/")
    if not files:
        return spark.createDataFrame([], schema)
    if not parts:
        return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in files])
    # Files of one partition are read together; its values are constants of that scan.
    groups: dict[tuple, list[str]] = {}
    for f, a in files.items():
        groups.setdefault(tuple((p, (a.get("partitionValues") or {}).get(p)) for p in parts), []).append(f"{root}/{f}")
    inner = T.StructType([f for f in schema if f.name not in parts])
    out = None
    for values, paths in groups.items():
        df = spark.read.schema(inner).parquet(*paths)
        for name, value in values:
            df = df.withColumn(name, F.lit(value).cast(schema[name].dataType))
        df = df.select(*[f.name for f in schema])
        out = df if out is None else out.unionByName(df)
    return out
