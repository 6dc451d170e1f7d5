"""Pipelines: streams, sinks and views in DDL, run over DataFrames.

A pipeline file declares external streams (sources and sinks), streams between
views, external tables (Parquet sinks) and materialized views, each a query INTO
a target.  `Pipeline` checks it and builds a DataFrame for every sink, over
batch DataFrames (a backfill) or streaming ones alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Session
from ..sql.emit import Emit, quoted, spark_type
from ..sql.parser import Node, Parser, SqlError, parse, walk

#: Settings that external streams may have; those of storage mean nothing here.
SETTINGS = {
    "type", "topic", "brokers", "data_format", "format_schema", "one_message_per_row", "seek_to", "properties", "group_name",
    "security_protocol", "sasl_mechanism", "username", "password", "uri", "endpoint", "region", "bucket", "access_key_id", "secret_access_key",
}
DEFAULTS = {"STRING": "''", "BOOLEAN": "false", "TIMESTAMP_NTZ": "TIMESTAMP_NTZ'1970-01-01'"}


@dataclass
class Column:
    name: str
    type: str
    default: str | None = None
    materialized: bool = False

    @property
    def nullable(self) -> bool:
        return self.type.lower().startswith("nullable")


@dataclass
class Stream:
    name: str
    kind: str  # stream, external or table
    columns: list[Column]
    settings: dict[str, str] = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)


@dataclass
class View:
    name: str
    target: str
    query: str
    delay: str | None = None
    settings: dict[str, str] = field(default_factory=dict)

    def reads(self) -> set[str]:
        q = parse(self.query)
        names = {x.name.lower() for x in walk(q, True) if x.kind == "named"}
        names |= {x.args[0].parts[-1].lower() for x in walk(q, True) if x.kind == "tablefn" and x.args[0].kind == "col"}
        return names - {n.lower() for x in walk(q, True) if x.kind == "query" for n, _ in x.ctes}


def statements(text: str) -> list[str]:
    """The statements of a file."""
    p, out, start = Parser(text), [], 0
    for t in p.tokens:
        if t.text == ";" or t.kind == "end":
            part = text[start : t.at].strip()
            if re.sub(r"--[^\n]*", "", part).strip():
                out.append(part)
            start = t.at + 1
    return out


def expression(text: str) -> Node:
    return Parser(text).expr()


class Pipeline:
    """A pipeline's declarations, checked."""

    def __init__(self, text: str) -> None:
        self.streams: dict[str, Stream] = {}
        self.views: list[View] = []
        for s in statements(text):
            self.declare(s)
        written = {v.target.lower() for v in self.views}
        for v in self.views:
            if v.target.lower() not in self.streams:
                raise SqlError(f"view {v.name}: no stream {v.target}")
            for n in v.reads():
                if n not in self.streams:
                    raise SqlError(f"view {v.name}: no stream {n}")
                if n in written and self.streams[n].kind != "stream":
                    raise SqlError(f"view {v.name} reads the sink {n} back: put a stream between")
        self.order()

    @property
    def sources(self) -> list[str]:
        written = {v.target.lower() for v in self.views}
        return [n for n, s in self.streams.items() if s.kind != "table" and n not in written]

    @property
    def sinks(self) -> list[str]:
        written = {v.target.lower() for v in self.views}
        return [n for n, s in self.streams.items() if s.kind != "stream" and n in written]

    def declare(self, text: str) -> None:
        p = Parser(text)
        p.need("CREATE")
        if p.take("MATERIALIZED", "VIEW"):
            p.take("IF", "NOT", "EXISTS")
            name = p.name()
            p.need("INTO")
            target = p.name()
            p.need("AS")
            start = p.now.at
            depth, stop, delay, settings = 0, len(text), None, {}
            while p.now.kind != "end":
                depth += (p.now.text == "(") - (p.now.text == ")")
                if not depth and (p.at("EMIT") or p.at("SETTINGS")):
                    stop = min(stop, p.now.at)
                    if p.take("EMIT"):
                        p.need("AFTER", "WINDOW", "CLOSE")
                        if p.take("WITH", "DELAY"):
                            delay = p.unary().text
                    else:
                        p.next()
                        settings = self.settings(p)
                else:
                    p.next()
            self.views.append(View(name, target, text[start:stop].strip(), delay, settings))
            return
        kind = "external" if p.take("EXTERNAL", "STREAM") else "table" if p.take("EXTERNAL", "TABLE") else "stream" if p.take("STREAM") else None
        if kind is None:
            raise p.error("expected STREAM, EXTERNAL STREAM, EXTERNAL TABLE or MATERIALIZED VIEW")
        p.take("IF", "NOT", "EXISTS")
        name = p.name()
        p.need("(")
        columns = p.listed(lambda: self.column(p))
        p.need(")")
        out = Stream(name, kind, columns)
        while p.now.kind != "end":
            if p.take("PARTITION", "BY"):
                e = p.expr()
                out.partition_by = [n.parts[-1] for n in walk(e) if n.kind == "col"]
            elif p.take("SETTINGS"):
                out.settings = self.settings(p)
                if kind == "external":
                    unknown = set(out.settings) - SETTINGS
                    if unknown:
                        raise SqlError(f"stream {name}: unknown setting {sorted(unknown)[0]}")
            else:
                p.next()  # TTL and the like are about storage
        self.streams[name.lower()] = out

    @staticmethod
    def settings(p: Parser) -> dict[str, str]:
        def one() -> tuple[str, str]:
            key = p.name()
            p.need("=")
            t = p.next()
            return key, t.text[1:-1] if t.kind == "string" else t.text

        return dict(p.listed(one))

    @staticmethod
    def column(p: Parser) -> Column:
        name, kind = p.name(), p.type_name()
        out = Column(name, kind)
        if p.now.upper in ("MATERIALIZED", "DEFAULT"):
            out.materialized = p.next().upper == "MATERIALIZED"
            start = p.now.at
            p.expr()
            out.default = p.sql[start : p.now.at]
        return out

    def order(self) -> list[View]:
        """The views, each after those whose targets it reads."""
        done: list[View] = []
        left = list(self.views)
        while left:
            open_ = {v.target.lower() for v in left}
            ready = [v for v in left if not (v.reads() & open_)]
            if not ready:
                raise SqlError(f"views read each other in a circle: {', '.join(v.name for v in left)}")
            done += ready
            left = [v for v in left if v not in ready]
        return done

    # ------------------------------------------------------------ building

    def typed(self, name: str, df: DataFrame) -> DataFrame:
        """Rows as a stream's columns: by name, cast, with defaults for what is missing or null."""
        have = {c.lower(): c for c in df.columns}
        emit = Emit(lambda n: quoted(have.get(n.parts[-1].lower(), n.parts[-1])))
        out = []
        for c in self.streams[name.lower()].columns:
            kind = spark_type(c.type)
            absent = f"CAST({DEFAULTS.get(kind, '0')} AS {kind})" if not kind.startswith(("ARRAY", "MAP")) else f"CAST(NULL AS {kind})"
            given = emit(expression(c.default)) if c.default else ("NULL" if c.nullable else absent)
            if c.materialized or c.name.lower() not in have:
                e = F.expr(given).cast(kind.lower()) if given != "NULL" else F.lit(None).cast(kind.lower())
            else:
                e = F.expr(f"try_cast(`{have[c.name.lower()]}` AS {kind})")
            if not c.nullable and not kind.startswith(("ARRAY", "MAP")):
                e = F.coalesce(e, F.expr(absent))
            out.append(e.alias(c.name))
        return df.select(*out)

    def build(self, session: Session, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A DataFrame for every sink, from one for every source (batch or streaming)."""
        missing = set(self.sources) - {k.lower() for k in sources}
        if missing:
            raise SqlError(f"no rows for the source {sorted(missing)[0]}")
        made: dict[str, DataFrame] = {}
        own = Session(session.spark, session.base, session.asof_slices)
        own.tables = dict(session.tables) | {k.lower(): v for k, v in sources.items()}
        for v in self.order():
            rows = self.typed(v.target, own.query(v.query))
            target = v.target.lower()
            made[target] = made[target].unionByName(rows) if target in made else rows
            own.tables[target] = made[target]
        return {n: made[n] for n in self.sinks}

    def source(self, name: str) -> Stream:
        return self.streams[name.lower()]


def validate(text: str) -> dict[str, list[str]]:
    """The sources and sinks of a pipeline, or an error that says what is wrong."""
    p = Pipeline(text)
    return {"sources": p.sources, "sinks": p.sinks}




def mapped(df: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """Rows laid out otherwise, as a source's columns: name to an expression of the dialect."""
    emit = Emit(lambda n: quoted(n.parts[-1]))
    if where:
        df = df.where(emit(expression(where)))
    kept = [quoted(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[F.expr(emit(expression(e))).alias(c) for c, e in columns.items()])


def backfill(
    session: Session,
    text: str,
    sources: dict[str, str],
    out: str,
    *,
    columns: dict[str, dict[str, str]] | None = None,
    where: dict[str, str] | None = None,
    partition_by: str | None = "symbol",
    fmt: str = "parquet",
) -> dict[str, str]:
    """Runs a pipeline over files: source name to path or glob.  Each sink becomes a directory
    under `out`, split by `partition_by` where the sink has that column; Spark marks a whole
    one with _SUCCESS.  columns, where: per source, how its files' columns and rows map."""
    p = Pipeline(text)
    rows = {}
    for name, path in sources.items():
        df = session.read(path, None, {})
        rows[name] = p.typed(name, mapped(df, (columns or {}).get(name, {}), (where or {}).get(name)))
    made = {}
    for sink, df in p.build(session, rows).items():
        made[sink] = f"{out.rstrip('/')}/{sink}"
        w = df.write.mode("overwrite").format(fmt)
        (w.partitionBy(partition_by) if partition_by in df.columns else w).save(made[sink])
    return made
