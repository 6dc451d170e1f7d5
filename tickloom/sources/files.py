"""Files as DataFrames in the engine's types.

Any path Spark's readers take works: files, globs, directories of Hive
partitions, object stores.  Integers come out as BIGINT, decimals as DOUBLE,
dates and timestamps as TIMESTAMP_NTZ; struct, map and binary columns are left
out.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import delta

FORMATS = {
    "parquet": "parquet", "pq": "parquet", "parq": "parquet", "csv": "csv", "tsv": "csv", "txt": "csv",
    "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "dbn": "dbn",
}
READERS = {
    "read_parquet": "parquet", "parquet_scan": "parquet", "read_csv": "csv", "read_csv_auto": "csv", "read_json": "json", "read_ndjson": "json",
    "read_json_auto": "json", "delta_scan": "delta", "iceberg_scan": "iceberg", "read_dbn": "dbn",
}
CSV_OPTIONS = {
    "header", "delim", "sep", "delimiter", "quote", "escape", "skip", "columns", "types", "dtypes", "column_types", "timestampformat",
    "nullstr", "null_str", "na_values", "auto_detect", "union_by_name", "hive_partitioning", "compression", "sample_size",
}
#: Times as kdb+ writes them.
KDB = r"^\d{4}\.\d{2}\.\d{2}D\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


class SourceError(ValueError):
    """A source isn't there, or can't be read this way."""


def kind_of(path: str) -> str:
    """The format that a path's ending names."""
    name = re.sub(r"\.(gz|zst|bz2|snappy)$", "", path.rstrip("/").lower())
    ending = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    return FORMATS.get(ending, "")


def read(spark: SparkSession, path: str | list[str], reader: str | None = None, options: dict[str, Any] | None = None) -> DataFrame:
    """A table of files."""
    options = {k.lower(): v for k, v in (options or {}).items()}
    first = path[0] if isinstance(path, list) else path
    if reader is not None and reader not in READERS:
        raise SourceError(f"unknown table function {reader}(); known are {', '.join(READERS)}")
    kind = READERS[reader] if reader else kind_of(first) or guess(spark, first)
    if kind == "csv":
        df = read_csv(spark, path, options)
    elif kind == "json":
        df = read_json(spark, path, options)
    elif kind == "delta":
        df = delta.read_delta(spark, first)
    elif kind == "iceberg":
        from . import iceberg

        df = iceberg.read_iceberg(spark, first)
    elif kind == "dbn":
        from . import dbn

        df = dbn.read_dbn(spark, first)
    else:
        unknown = set(options) - {"union_by_name", "hive_partitioning", "compression"}
        if unknown:
            raise SourceError(f"unknown option {sorted(unknown)[0]} of a {kind} file")
        paths = path if isinstance(path, list) else [path]
        reader_ = spark.read.option("mergeSchema", str(bool(options.get("union_by_name", False))).lower()).format(kind)
        key = file_key(spark, paths[0]) if len(paths) == 1 and kind == "parquet" else None
        if key in _schemas:
            reader_ = reader_.schema(_schemas[key])
        df = reader_.load(paths)
        if key is not None and key not in _schemas:
            if len(_schemas) >= MOST_SCHEMAS:
                _schemas.clear()
            _schemas[key] = df.schema
    return normal(df)


#: Schemas of single files that haven't changed since: their footers needn't be read again.
_schemas: dict[tuple | None, T.StructType] = {}
MOST_SCHEMAS = 1000


def file_key(spark: SparkSession, path: str) -> tuple | None:
    """A file's path, time and length; None for anything but one plain file."""
    if any(c in path for c in "*?[{"):
        return None
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    return None if status.isDirectory() else (path, status.getModificationTime(), status.getLen())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path (or matches a glob)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def guess(spark: SparkSession, path: str) -> str:
    """The format of a path without a known ending: a table's log, or Parquet below it."""
    if not exists(spark, path):
        raise SourceError(f"no file or directory at {path}")
    if exists(spark, f"{path.rstrip('/')}/_delta_log"):
        return "delta"
    if exists(spark, f"{path.rstrip('/')}/metadata/*.metadata.json"):
        return "iceberg"
    for ending in ("csv", "json", "jsonl"):
        if exists(spark, f"{path.rstrip('/')}/*.{ending}") or exists(spark, f"{path.rstrip('/')}/*/*.{ending}"):
            return FORMATS[ending]
    return "parquet"


def normal(df: DataFrame) -> DataFrame:
    """The columns in the engine's types."""
    out = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.StructType, T.MapType, T.BinaryType)):
            continue
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def sniffed(lines: list[str]) -> str:
    """The separator that splits the first lines evenly."""
    best, most = ",", 0
    for sep in (",", "\t", ";", "|"):
        counts = [line.count(sep) for line in lines if line]
        if counts and min(counts) > most and min(counts) == max(counts):
            best, most = sep, min(counts)
    return best


def read_csv(spark: SparkSession, path: str | list[str], options: dict[str, Any]) -> DataFrame:
    unknown = set(options) - CSV_OPTIONS
    if unknown:
        raise SourceError(f"unknown option {sorted(unknown)[0]}; known are {', '.join(sorted(CSV_OPTIONS))}")
    first = path[0] if isinstance(path, list) else path
    sep = next((options[k] for k in ("delim", "sep", "delimiter") if k in options), None)
    skip = int(options.get("skip", 0))
    if sep is None:
        sep = "\t" if re.sub(r"\.gz$", "", first).endswith(".tsv") else sniffed([r[0] for r in spark.read.text(path).limit(skip + 20).collect()][skip:])
    nulls = next((options[k] for k in ("nullstr", "null_str", "na_values") if k in options), None)
    nulls = [nulls] if isinstance(nulls, str) else list(nulls or [])
    types = next((options[k] for k in ("columns", "types", "dtypes", "column_types") if k in options), {})
    r = spark.read.option("sep", sep).option("quote", options.get("quote", '"')).option("escape", options.get("escape", '"')).option("multiLine", "false")
    r = r.option("header", str(options.get("header", True)).lower()).option("inferSchema", "true").option("nullValue", nulls[0] if len(nulls) == 1 else "")
    r = r.option("timestampNTZFormat", "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS]").option("ignoreLeadingWhiteSpace", "false")
    if isinstance(options.get("columns"), dict):
        # All columns are named, in order: nothing is to be found out.
        r = r.option("inferSchema", "false").schema(T.StructType([T.StructField(c, T.StringType()) for c in options["columns"]]))
    if skip:
        # Lines before the header go: the rest is parsed as text lines.
        rows = spark.read.text(path, wholetext=False).withColumn("_i", F.monotonically_increasing_id())
        df = r.csv(rows.where(F.col("_i") >= skip).select("value").rdd.map(lambda x: x[0]))
    else:
        df = r.csv(path)
    if len(nulls) > 1:
        df = df.select(*[F.when(~F.col(f"`{c}`").cast("string").isin(nulls), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if isinstance(types, dict):
        df = typed(df, types, options.get("timestampformat"))
    return times(df)


def typed(df: DataFrame, types: dict[str, str], pattern: str | None = None) -> DataFrame:
    """Columns cast to the types that the caller names."""
    from ..sql.emit import spark_type

    per = {"TIMESTAMP_S": 1_000_000, "TIMESTAMP_MS": 1_000, "TIMESTAMP_US": 1}
    for name, kind in types.items():
        c = F.col(f"`{name}`")
        if kind.upper() == "TIMESTAMP_NS":
            c = F.timestamp_micros(F.floor(c.cast("long") / 1000))
        elif kind.upper() in per:
            c = F.timestamp_micros(c.cast("long") * per[kind.upper()])
        elif pattern and kind.upper() == "TIMESTAMP":
            c = F.try_to_timestamp(c.cast("string"), F.lit(java_pattern(pattern)))
        else:
            c = F.expr(f"try_cast(`{name}` AS {spark_type(kind)})")
        df = df.withColumn(name, c)
    return df


def java_pattern(pattern: str) -> str:
    from ..functions.times import STRFTIME

    marks = STRFTIME | {"g": "SSS", "n": "SSSSSSSSS"}
    return re.sub(r"%(.)", lambda m: marks.get(m[1], m[1]), re.sub(r"([A-Za-z]+)(?<!%[A-Za-z])", lambda m: m[0], pattern))


def times(df: DataFrame) -> DataFrame:
    """Text columns that hold nothing but times, as times."""
    head = df.limit(1).collect()
    if not head:
        return df
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    near = [c for c in texts if head[0][c] and (re.match(KDB, head[0][c]) or re.match(iso, head[0][c]))]
    if not near:
        return df
    bad = df.agg(*[F.sum((~F.col(f"`{c}`").rlike(KDB) & ~F.col(f"`{c}`").rlike(iso)).cast("long")).alias(c) for c in near]).first()
    for c in near:
        if not bad[c]:
            text = F.regexp_replace(F.col(f"`{c}`"), r"^(\d{4})\.(\d{2})\.(\d{2})D", "$1-$2-$3 ")
            df = df.withColumn(c, F.try_to_timestamp(text).cast("timestamp_ntz"))
    return df


def read_json(spark: SparkSession, path: str | list[str], options: dict[str, Any]) -> DataFrame:
    unknown = set(options) - {"union_by_name", "compression", "columns", "format", "auto_detect", "sample_size"}
    if unknown:
        raise SourceError(f"unknown option {sorted(unknown)[0]} of a JSON file")
    df = spark.read.option("primitivesAsString", "false").json(path)
    first = spark.read.text(path).limit(1).collect()
    if first:
        # Columns in the order in which the first row has them, then the others.
        import json

        try:
            order = [k for k in json.loads(first[0][0]) if k in df.columns]
        except ValueError:
            order = []
        df = df.select(*[f"`{c}`" for c in order], *[f"`{c}`" for c in df.columns if c not in order])
    if isinstance(options.get("columns"), dict):
        df = typed(df, options["columns"])
    return times(df)


def write(df: DataFrame, path: str, kind: str | None = None, partition_by: list[str] = (), overwrite: bool = False, header: bool | None = None, compression: str | None = None) -> None:
    """Rows to files: a directory of part files in Parquet, CSV or JSON lines.

    header: whether CSV files name their columns (they do unless told otherwise).
    compression: a codec of the format."""
    kind = kind or kind_of(path) or "parquet"
    if kind not in ("parquet", "csv", "json", "orc"):
        raise SourceError(f"can't write {kind}: write parquet, csv or json")
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if kind in ("csv", "json"):
        w = w.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if kind == "csv":
        w = w.option("header", str(header is not False).lower())
    elif header is not None:
        raise SourceError(f"HEADER is an option of csv, not of {kind}")
    if compression is not None:
        w = w.option("compression", {"zst": "zstd", "uncompressed": "none"}.get(compression, compression))
    w.format(kind).save(path)
