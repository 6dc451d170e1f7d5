"""A session: SQL of the dialect over files, DataFrames and named tables."""

from __future__ import annotations

import difflib
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .sources import files
from .sources.files import SourceError
from .sql.parser import Node, Parser, SqlError, parse
from .sql.planner import Planner

#: What DESCRIBE calls each of Spark's types.
TYPE_NAMES = {"bigint": "bigint", "int": "bigint", "double": "double", "float": "double", "string": "varchar", "timestamp_ntz": "timestamp", "timestamp": "timestamp", "boolean": "boolean"}
TRIED = ("parquet", "csv", "csv.gz", "tsv", "json", "jsonl", "ndjson", "jsonl.gz")


class Result:
    """What a statement gives: rows, or a message."""

    def __init__(self, df: DataFrame | None, message: str | None = None) -> None:
        self.df, self.message = df, message

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    def fetchone(self) -> tuple | None:
        row = self.df.first() if self.df is not None else None
        return tuple(row) if row is not None else None

    def __len__(self) -> int:
        return self.df.count() if self.df is not None else 0

    def arrow(self):
        return self.df.toArrow()

    def pandas(self):
        return self.df.toPandas()

    def show(self, n: int = 20) -> None:
        print(self.message) if self.df is None else self.df.show(n, truncate=False)

    def write(self, path: str, overwrite: bool = False) -> None:
        files.write(self.df, path, overwrite=overwrite)


class Session:
    """Tables by name, and statements over them.

    base: a directory in which bare names are looked for as files.  asof_slices: a
    duration by which as-of joins deal out each key's rows too (for very busy keys).
    """

    def __init__(self, spark: SparkSession, base: str | None = None, asof_slices: str | None = None) -> None:
        self.spark, self.base, self.asof_slices = spark, base, asof_slices
        self.tables: dict[str, DataFrame | Node | str] = {}
        self.emitted: list[str] = []
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # ------------------------------------------------------------ tables

    def register(self, name: str, data: Any) -> None:
        """A DataFrame (Spark's, pandas' or an Arrow table) as a table."""
        if not isinstance(data, DataFrame):
            data = self.spark.createDataFrame(data)
        self.tables[name.lower()] = files.normal(data)

    def table(self, name: str) -> DataFrame:
        return self.resolve(name, Planner(self))

    def resolve(self, name: str, planner: Planner) -> DataFrame:
        found = self.tables.get(name.lower())
        if isinstance(found, DataFrame):
            return found
        if isinstance(found, str):
            return files.read(self.spark, found)
        if isinstance(found, Node):
            return Planner(self).query(found)
        if self.base is not None:
            for ending in TRIED:
                path = f"{self.base.rstrip('/')}/{name}.{ending}"
                if files.exists(self.spark, path):
                    return files.read(self.spark, path)
            if files.exists(self.spark, f"{self.base.rstrip('/')}/{name}"):
                return files.read(self.spark, f"{self.base.rstrip('/')}/{name}")
        if self.spark.catalog.tableExists(name):
            return files.normal(self.spark.table(name))
        near = difflib.get_close_matches(name.lower(), [*self.tables, *planner.known], 1)
        raise SqlError(f"no table {name!r}{f'; did you mean {near[0]}?' if near else ''}")

    def read(self, path: Any, reader: str | None, options: dict) -> DataFrame:
        def full(p: str) -> str:
            if self.base is None or "://" in p or p.startswith("/"):
                return p
            return f"{self.base.rstrip('/')}/{p}"

        return files.read(self.spark, [full(p) for p in path] if isinstance(path, list) else full(path), reader, options)

    # ------------------------------------------------------------ statements

    def sql(self, text: str) -> Result:
        """One statement."""
        text = text.strip().rstrip(";").strip()
        word = re.match(r"[A-Za-z]*", text)[0].upper()
        self.emitted = []
        handler = getattr(self, f"_{word.lower()}", None)
        if handler is not None and word not in ("SELECT", "WITH", "FROM", "PIVOT"):
            return handler(text)
        return Result(Planner(self).query(parse(text)))

    def query(self, text: str) -> DataFrame:
        """The rows of a query."""
        return Planner(self).query(parse(text))

    def _create(self, text: str) -> Result:
        m = re.match(r"(?is)CREATE\s+(OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(TABLE|VIEW)\s+(IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)\s+AS\s+(.*)$", text)
        if m is None:
            raise SqlError("write CREATE [OR REPLACE] TABLE|VIEW name AS query, or AS 'location'")
        name = m[4].strip('"`').lower()
        if name in self.tables and not m[1]:
            if m[3]:
                return Result(None, f"{name} is there already")
            raise SqlError(f"{name} is there already: write CREATE OR REPLACE")
        body = m[5].strip()
        if body.startswith("'") and body.endswith("'"):
            location = body[1:-1]
            self.tables[name] = location if self.base is None or "://" in location or location.startswith("/") else f"{self.base.rstrip('/')}/{location}"
            self.table(name)
        else:
            q = parse(body)
            Planner(self).query(q)  # refused now rather than when first read
            self.tables[name] = q
        return Result(None, f"created {m[2].lower()} {name}")

    def _drop(self, text: str) -> Result:
        m = re.match(r"(?is)DROP\s+(?:TABLE|VIEW)\s+(IF\s+EXISTS\s+)?([\w.\"`]+)$", text)
        if m is None:
            raise SqlError("write DROP TABLE|VIEW [IF EXISTS] name")
        name = m[2].strip('"`').lower()
        if self.tables.pop(name, None) is None and not m[1]:
            raise SqlError(f"no table {name!r}")
        return Result(None, f"dropped {name}")

    def _show(self, text: str) -> Result:
        if not re.fullmatch(r"(?is)SHOW\s+TABLES", text):
            raise SqlError("write SHOW TABLES")
        return Result(self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "name string"))

    def _describe(self, text: str) -> Result:
        of = re.sub(r"(?is)^DESCRIBE\s+", "", text)
        df = self.query(of) if re.match(r"(?i)(SELECT|WITH|FROM|PIVOT)\b", of) else self.query(f"SELECT * FROM {of}")
        rows = [(n, "array" if t.startswith("array") else "map" if t.startswith("map") else TYPE_NAMES.get(t, t)) for n, t in df.dtypes]
        return Result(self.spark.createDataFrame(rows, "column_name string, column_type string"))

    def _explain(self, text: str) -> Result:
        df = self.query(re.sub(r"(?is)^EXPLAIN\s+", "", text))
        plan = df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(None, "\n".join([*self.emitted, "", plan]))

    def _copy(self, text: str) -> Result:
        p = Parser(text)
        p.need("COPY")
        if p.take("("):
            q = p.query()
            p.need(")")
        else:
            name = p.name()
            q = parse(f"SELECT * FROM {name}")
        p.need("TO")
        path = p.string()
        kind, parts, overwrite, options = None, [], False, {}
        if p.take("("):
            while True:
                option = p.name().upper()
                if option == "FORMAT":
                    kind = p.string() if p.now.kind == "string" else p.name()
                elif option == "PARTITION_BY":
                    p.need("(")
                    parts = p.listed(p.name)
                    p.need(")")
                elif option == "OVERWRITE_OR_IGNORE":
                    overwrite = True
                    if p.now.upper in ("TRUE", "FALSE"):
                        overwrite = p.next().upper == "TRUE"
                elif option == "HEADER":
                    options["header"] = not (p.now.upper in ("TRUE", "FALSE") and p.next().upper == "FALSE")
                elif option == "COMPRESSION":
                    options["compression"] = (p.string() if p.now.kind == "string" else p.name()).lower()
                else:
                    raise SqlError(f"COPY's option {option} isn't supported")
                if not p.take(","):
                    break
            p.need(")")
        if p.now.kind != "end":
            raise p.error("unexpected text")
        if self.base is not None and "://" not in path and not path.startswith("/"):
            path = f"{self.base.rstrip('/')}/{path}"
        df = Planner(self).query(q)
        if parts and not overwrite and files.exists(self.spark, path):
            raise SourceError(f"{path} isn't empty: write OVERWRITE_OR_IGNORE")
        files.write(df, path, kind.lower() if kind else None, parts, overwrite, **options)
        return Result(None, f"copied to {path}")
