"""Queries of the dialect as DataFrames.

A SELECT becomes one Spark SQL statement over one relation.  Joins, gap filling,
moving averages and ordered aggregates are the operators' work; Catalyst does the
rest.  A relation of several tables has a struct column for each, named by its
alias, so qualified names resolve as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ORDERED
from ..functions.registry import AGGREGATE_ALIASES, width_us
from ..functions.times import us
from ..functions.widths import micros
from ..operators.asof import Side, asof_join, asof_joins, lookup_join, window_join
from ..operators.ema import decay, ema
from ..operators.gapfill import gapfill
from ..operators.ranges import range_aggregates
from .emit import Emit, has_aggregate, is_aggregate, quoted
from .parser import Node, SqlError, rewrite, walk

if TYPE_CHECKING:
    from ..session import Session

_numbers = itertools.count()


@dataclass
class Scope:
    """A relation: its rows, and the columns of each alias (in order)."""

    df: DataFrame
    tables: dict[str, list[str]]
    structs: bool
    extra: list[str] = field(default_factory=list)

    def type_of(self, node: Node) -> str:
        """The name of a column's type; '' where it isn't a plain column."""
        if node.kind != "col":
            return ""
        if not self.structs:
            return next((t for n, t in self.df.dtypes if n.lower() == node.parts[-1].lower()), "")
        alias = node.parts[0] if len(node.parts) > 1 else self.owner(node.parts[0])
        side = next((f for f in self.df.schema if f.name.lower() == alias.lower()), None)
        return next((f.dataType.simpleString() for f in side.dataType if f.name.lower() == node.parts[-1].lower()), "") if side is not None else ""

    def owner(self, name: str) -> str:
        found = [a for a, cols in self.tables.items() if name.lower() in {c.lower() for c in cols}]
        if not found:
            every = ", ".join(c for cols in self.tables.values() for c in cols)
            raise SqlError(f"no column {name!r}; there are {every}")
        if len(found) > 1:
            raise SqlError(f"column {name!r} is in {' and '.join(found)}: write {found[0]}.{name}")
        return found[0]

    def has(self, name: str) -> bool:
        return any(name.lower() in {c.lower() for c in cols} for cols in self.tables.values())

    def column(self, node: Node) -> str:
        parts = node.parts
        if len(parts) == 1:
            if parts[0] in self.extra:
                return quoted(parts[0])
            if not self.structs:
                self.owner(parts[0])
                return quoted(parts[0])
            return f"{quoted(self.owner(parts[0]))}.{quoted(parts[0])}"
        alias = next((a for a in self.tables if a.lower() == parts[0].lower()), None)
        if alias is None:
            self.owner(parts[0])
            return ".".join(map(quoted, parts))
        if parts[1].lower() not in {c.lower() for c in self.tables[alias]}:
            raise SqlError(f"no column {parts[1]!r} in {alias}; there are {', '.join(self.tables[alias])}")
        return ".".join([quoted(alias), *map(quoted, parts[1:])])


class Planner:
    def __init__(self, session: Session, known: dict[str, DataFrame] | None = None) -> None:
        self.session, self.spark = session, session.spark
        self.known = dict(known or {})
        self.read: set[tuple[str, str]] = {("", "*")}

    # ------------------------------------------------------------ queries

    def query(self, q: Node) -> DataFrame:
        own = Planner(self.session, self.known)
        for name, cte in q.ctes:
            own.known[name.lower()] = own.query(cte)
        return own.body(q.body, q)

    def body(self, body: Node, q: Node) -> DataFrame:
        if body.kind == "query":
            inner = self.query(body)
            return self.finished(inner, q)
        if body.kind == "union":
            none = Node("query", ctes=[], body=None, order=[], limit=None, offset=None)
            left, right = self.body(body.left, none), self.body(body.right, none)
            if len(left.columns) != len(right.columns):
                raise SqlError(f"UNION of {len(left.columns)} and {len(right.columns)} columns")
            both = left.union(right)
            return self.finished(both if body.every else both.distinct(), q)
        if body.kind == "pivot":
            return self.finished(self.pivot(body), q)
        return self.select(body, q)

    def finished(self, df: DataFrame, q: Node) -> DataFrame:
        """ORDER BY and LIMIT over output columns."""
        if not (q.order or q.limit or q.offset):
            return df
        scope = Scope(df, {"_": df.columns}, False)
        return self.run(f"SELECT * FROM {{rel}}{self.tail(q, Emit(scope.column), df.columns)}", df)

    def tail(self, q: Node, emit: Emit, names: list[str], items: list[Node] | None = None) -> str:
        out = []
        shown = {n.lower() for n in names}
        for o in q.order:
            e = o.expr
            nulls = o.nulls or ("FIRST" if o.down else "LAST")
            way = f"{'DESC' if o.down else 'ASC'} NULLS {nulls}"
            if e.kind == "all":
                out += [f"{quoted(n)} {way}" for n in names]
            elif e.kind == "lit" and e.text.isdigit():
                if not 1 <= int(e.text) <= len(names):
                    raise SqlError(f"ORDER BY {e.text}: there are {len(names)} columns")
                out.append(f"{quoted(names[int(e.text) - 1])} {way}")
            elif e.kind == "col" and len(e.parts) == 1 and e.parts[0].lower() in shown:
                out.append(f"{quoted(e.parts[0])} {way}")
            else:
                out.append(f"{emit(e)} {way}")
        text = f" ORDER BY {', '.join(out)}" if out else ""
        if q.limit is not None:
            text += f" LIMIT {emit(q.limit)}"
        if q.offset is not None:
            text += f" OFFSET {emit(q.offset)}"
        return text

    def run(self, text: str, df: DataFrame | None, alias: str = "rel") -> DataFrame:
        """A statement over one relation, which stands for {rel} in it."""
        if df is None:
            return self.statement(text)
        view = f"_tickloom_{next(_numbers)}"
        df.createOrReplaceTempView(view)
        try:
            self.session.emitted.append(text.replace("{rel}", alias))
            return self.statement(text.replace("{rel}", f"{view} AS {quoted(alias)}"))
        finally:
            self.spark.catalog.dropTempView(view)

    def statement(self, text: str) -> DataFrame:
        """A Spark statement in which integers wrap; the way of adding is settled as it is read."""
        with self.wrapping():
            return self.spark.sql(text)

    @contextmanager
    def wrapping(self) -> Iterator[None]:
        """Integers wrap in what is made meanwhile."""
        conf, ansi = self.spark.conf, "spark.sql.ansi.enabled"
        before = conf.get(ansi)
        conf.set(ansi, "false")
        try:
            yield
        finally:
            conf.set(ansi, before)

    # ------------------------------------------------------------ tables

    def table(self, t: Node) -> tuple[DataFrame, str]:
        """A table's rows and alias."""
        if t.kind == "derived":
            return self.query(t.query), t.alias or f"_t{next(_numbers)}"
        if t.kind == "named":
            df = self.known.get(t.name.lower())
            if df is None:
                df = self.session.resolve(t.name, self)
            return df, t.alias or t.name.split(".")[-1]
        if t.kind == "file":
            if isinstance(t.path, Node):
                return self.query(t.path), t.alias or "rows"
            stem = re.split(r"[/.]", t.path.rstrip("/").rsplit("/", 1)[-1])[0] if isinstance(t.path, str) else "file"
            return self.session.read(t.path, t.reader, t.options), t.alias or stem or "file"
        if t.kind == "tablefn":
            return self.table_function(t)
        if t.kind == "unpivot":
            df, _ = self.table(t.source)
            keep = [c for c in df.columns if c.lower() not in {x.lower() for x in t.columns}]
            out = df.unpivot(keep, t.columns, t.name, t.value)
            return (out if t.nulls else out.where(F.col(t.value).isNotNull())), t.alias or "unpivoted"
        if t.kind == "pivot":
            return self.pivot(t), t.alias or "pivoted"
        raise SqlError(f"unexpected {t.kind} in FROM")

    def table_function(self, t: Node) -> tuple[DataFrame, str]:
        """tumble(stream, time, width), gap_fill(...) and orderbook_top_n(stream, depth) in FROM."""
        source = t.args[0]
        if source.kind != "col":
            raise SqlError(f"{t.name}() takes the name of a stream first")
        df, alias = self.table(Node("named", name=".".join(source.parts), alias=None))
        alias = t.alias or alias
        plain = Emit(lambda n: quoted(n.parts[-1]))
        if t.name == "tumble":
            width = width_us(plain(t.args[2]))
            w = F.window(F.expr(plain(t.args[1])), f"{width} microseconds")
            return df.withColumn("window", w).select("*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")), alias
        if t.name == "orderbook_top_n":
            from ..operators.orderbook import orderbook_top_n

            reset = len(t.args) > 2 and t.args[2].kind == "lit" and t.args[2].text == "TRUE" or len(t.args) > 2 and t.args[2].kind == "col"
            return orderbook_top_n(df, int(literal_number(t.args[1])), allow_seq_reset=bool(reset)), alias
        ts, width = t.args[1].parts[-1], plain(t.args[2])
        bounds, keys, carried, lines = [], [], [], []
        for a in t.args[3:]:
            if a.kind in ("string", "timestamp"):
                bounds.append(self.moment(plain(a)))
            elif a.kind == "func" and a.name in ("locf", "interpolate"):
                (carried if a.name == "locf" else lines).append(a.args[0].parts[-1])
            else:
                keys.append(a.parts[-1])
        bounds += [None] * (2 - len(bounds))
        return gapfill(df, ts, width_us(width), keys, locf=carried, interpolate=lines, start=bounds[0], finish=bounds[1]), alias

    def relation(self, s: Node, q: Node) -> Scope | None:
        if s.table is None:
            return None
        if s.table.kind == "lateral":
            raise SqlError("LATERAL needs a table before it")
        df, alias = self.table(s.table)
        if s.joins:
            # Joined rows travel as structs, which the optimizer doesn't look into: what isn't
            # read later is dropped, and what only the first table decides is filtered, before.
            self.read = self.mentioned(s, q)
            df = self.early(self.pruned(df, alias), alias, s)
        scope = Scope(df, {alias: df.columns}, False)
        at = 0
        while at < len(s.joins):
            if s.joins[at].how == "asof" and self.session.asof_slices is None:
                scope, n = self.asof_run(scope, s.joins[at:])
            else:
                scope, n = self.join(scope, s.joins[at]), 1
            at += n
        return scope

    @staticmethod
    def mentioned(s: Node, q: Node) -> set[tuple[str, str]]:
        """The columns that a SELECT reads: (alias or '' for any, name or '*')."""
        out = set()
        # A derived table's own columns and stars say nothing of what is read from it; a
        # LATERAL query's do.
        parts = [*s.items, s.where, *(s.group or []), s.having, *s.windows.values(), *q.order]
        for j in s.joins:
            parts += [j.on, j.match, j.table.query.body if j.how == "lateral" else None]
        if s.table.kind == "tablefn":
            parts.append(s.table)
        for part in parts:
            for n in walk(part, True) if part is not None else ():
                if n.kind == "col":
                    out |= {("", n.parts[0].lower())} if len(n.parts) == 1 else {(n.parts[0].lower(), n.parts[1].lower()), ("", n.parts[0].lower())}
                elif n.kind == "star":
                    out.add(((n.of or "").lower(), "*"))
        return out

    def pruned(self, df: DataFrame, alias: str) -> DataFrame:
        a = alias.lower()
        if {("", "*"), (a, "*")} & self.read:
            return df
        kept = [c for c in df.columns if {("", c.lower()), (a, c.lower())} & self.read]
        return df.select(*map(quoted, kept or df.columns[:1]))

    def early(self, df: DataFrame, alias: str, s: Node) -> DataFrame:
        """The first table's rows that conditions on it alone let through."""
        scope = Scope(df, {alias: df.columns}, False)
        emit = Emit(self.lcolumn(scope))
        for c in conjuncts(s.where):
            columns = [n for n in walk(c) if n.kind == "col"]
            own = all(len(n.parts) > 1 and n.parts[0].lower() == alias.lower() and scope.has(n.parts[1]) for n in columns)
            if columns and own and not any(n.kind == "func" and (n.over is not None or is_aggregate(n)) for n in walk(c)):
                df = df.where(emit(c))
        return df

    def join(self, scope: Scope, j: Node) -> Scope:
        if j.how == "lateral":
            return self.lateral(scope, j)
        right, alias = self.table(j.table)
        right = self.pruned(right, alias)
        if alias in scope.tables:
            raise SqlError(f"two tables are called {alias}: give one another name")
        rscope = Scope(right, {alias: right.columns}, False)
        if j.on is None and j.match is None:
            raise SqlError("a join needs ON")
        conds = conjuncts(j.on) + ([j.match] if j.match else [])
        left, multi = scope.df, scope.structs
        keys, times = [], []
        for c in conds:
            pair = self.sides(c, scope, rscope)
            if c.kind == "binary" and c.op == "=" and pair:
                keys.append(pair[:2])
            else:
                times.append((c, pair))
        lex = Emit(self.lcolumn(scope))
        rex = Emit(lambda n: quoted(n.parts[-1]))
        pairs = [(F.expr(lex(a)), F.expr(rex(b))) for a, b in keys]
        if j.how == "lookup":
            if times or not pairs:
                raise SqlError("a join's ON must be equalities of keys; for a time write ASOF JOIN")
            for _, b in keys:
                if b.kind != "col":
                    raise SqlError("a join's keys must be columns")
            made = lookup_join(left, right, pairs, aliases=("_l", "_r"), how="left" if j.left else "inner")
        else:
            made = self.asof(scope, left, right, pairs, times, lex, rex, j)
        return self.merged(scope, made, alias, right.columns, multi)

    @staticmethod
    def merged(scope: Scope, made: DataFrame, alias: str, columns: list[str], multi: bool) -> Scope:
        """The joined rows with a struct for each alias."""
        if multi:
            kept = [F.col(f"_l.{quoted(a)}").alias(a) for a in scope.tables]
        else:
            kept = [F.col("_l").alias(a) for a in scope.tables]
        return Scope(made.select(*kept, F.col("_r").alias(alias)), scope.tables | {alias: columns}, True)

    @staticmethod
    def lcolumn(scope: Scope):
        """Columns of a relation as its own rows name them, without its alias."""

        def column(n: Node) -> str:
            text = scope.column(n)
            return text if scope.structs or len(n.parts) == 1 else ".".join(map(quoted, n.parts[1:]))

        return column

    def sides(self, c: Node, left: Scope, right: Scope) -> tuple[Node, Node, str] | None:
        """The left and right expression of a comparison, and its operator seen from the left."""
        if c.kind != "binary" or c.op not in ("=", "<", "<=", ">", ">="):
            return None
        a, b = self.of(c.left, left, right), self.of(c.right, left, right)
        if (a, b) == ("l", "r"):
            return c.left, c.right, c.op
        if (a, b) == ("r", "l"):
            return c.right, c.left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(c.op, c.op)
        return None

    @staticmethod
    def of(e: Node, left: Scope, right: Scope) -> str:
        """Which side an expression's columns are of: l, r, both or none ('')."""
        out = set()
        for n in walk(e):
            if n.kind == "col":
                if len(n.parts) > 1 and n.parts[0].lower() in {a.lower() for a in right.tables}:
                    out.add("r")
                elif len(n.parts) > 1 and n.parts[0].lower() in {a.lower() for a in left.tables}:
                    out.add("l")
                else:
                    inl, inr = left.has(n.parts[0]), right.has(n.parts[0])
                    if inl and inr:
                        raise SqlError(f"column {n.parts[0]!r} is on both sides of the join: qualify it")
                    if not (inl or inr):
                        raise SqlError(f"no column {'.'.join(n.parts)!r}")
                    out.add("l" if inl else "r")
        return "".join(sorted(out))

    def asof_run(self, scope: Scope, joins: list[Node]) -> tuple[Scope, int]:
        """As-of joins that follow each other on the same keys and time of what is left of
        them, made together; and how many they are."""
        base, rights, columns = None, [], {}
        lex, rex = Emit(self.lcolumn(scope)), Emit(lambda n: quoted(n.parts[-1]))
        for j in joins:
            if j.how != "asof":
                break
            try:
                right, alias = self.table(j.table)
                right = self.pruned(right, alias)
                keys, main, tolerance = self.asof_parts(scope, right, alias, j)
                lt, shift = self.linear(main[0])
                rt, back = self.linear(main[1])
                own = (lex(lt), [lex(a) for a, _ in keys])
            except SqlError:
                if not rights:
                    raise
                break
            if (base is not None and own != base) or alias in columns or alias in scope.tables:
                break
            base = own
            columns[alias] = right.columns
            rights.append(Side(right, F.expr(rex(rt)), [F.expr(rex(b)) for _, b in keys], alias, shift - back, main[2] == ">", tolerance, not j.left))
        if not rights:
            raise SqlError(f"two tables are called {alias}: give one another name")
        made = asof_joins(scope.df, F.expr(base[0]), [F.expr(k) for k in base[1]], rights, "_l")
        kept = [F.col(f"_l.{quoted(a)}" if scope.structs else "_l").alias(a) for a in scope.tables]
        return Scope(made.select(*kept, *map(quoted, columns)), scope.tables | columns, True), len(rights)

    def asof_parts(self, scope: Scope, right: DataFrame, alias: str, j: Node) -> tuple[list, tuple, int | None]:
        """An as-of join's pairs of keys, its time condition and its tolerance."""
        if j.on is None and j.match is None:
            raise SqlError("a join needs ON")
        rscope = Scope(right, {alias: right.columns}, False)
        keys, main, tolerance = [], None, None
        for c in conjuncts(j.on) + ([j.match] if j.match else []):
            pair = self.sides(c, scope, rscope)
            near = self.distance(c, scope, rscope) if c.kind == "binary" else None
            if c.kind == "binary" and c.op == "=" and pair:
                keys.append(pair[:2])
            elif near is not None:
                tolerance = near if tolerance is None else min(tolerance, near)
            elif pair and pair[2] in (">", ">=") and main is None:
                main = pair
            else:
                raise SqlError("ASOF JOIN's ON must be equalities of keys, one time condition like t.ts >= q.ts, and at most a tolerance like t.ts - q.ts <= INTERVAL '1 second'")
        if main is None:
            raise SqlError("ASOF JOIN needs a time condition like t.ts >= q.ts")
        return keys, main, tolerance

    def asof(self, scope: Scope, left: DataFrame, right: DataFrame, pairs: list, times: list, lex: Emit, rex: Emit, j: Node) -> DataFrame:
        main = tolerance = None
        for c, pair in times:
            near = self.distance(c, scope, Scope(right, {j.table.alias or getattr(j.table, "name", ""): right.columns}, False)) if c.kind == "binary" else None
            if near is not None:
                tolerance = near if tolerance is None else min(tolerance, near)
            elif pair and pair[2] in (">", ">=") and main is None:
                main = pair
            else:
                raise SqlError("ASOF JOIN's ON must be equalities of keys, one time condition like t.ts >= q.ts, and at most a tolerance like t.ts - q.ts <= INTERVAL '1 second'")
        if main is None:
            raise SqlError("ASOF JOIN needs a time condition like t.ts >= q.ts")
        rtime, offset = self.plain_time(main[1])
        if tolerance is not None:  # it is between the times themselves, not the moved ones
            tolerance += self.linear(main[0])[1] - self.linear(main[1])[1]
        lt = f"({lex(main[0])})" if not offset else f"({lex(main[0])} - ({rex(offset)}))"
        return asof_join(left, right, F.expr(lt), F.expr(rex(rtime)), pairs, aliases=("_l", "_r"), how="left" if j.left else "inner", strict=main[2] == ">", tolerance=tolerance, slices=self.session.asof_slices)

    @staticmethod
    def plain_time(e: Node) -> tuple[Node, Node | None]:
        """A right time and what is added to it, so that it can be moved to the left."""
        if e.kind == "binary" and e.op in "+-" and e.right.kind == "interval":
            off = e.right if e.op == "+" else Node("interval", text=f"{-micros(e.right.text)} us")
            return e.left, off
        return e, None

    def distance(self, c: Node, left: Scope, right: Scope) -> int | None:
        """A tolerance's microseconds, of t.ts - q.ts <= INTERVAL or the like."""
        op, a, b = c.op, c.left, c.right
        if op in (">", ">="):
            op, a, b = {">": "<", ">=": "<="}[op], b, a
        if op in ("<", "<=") and a.kind == "binary" and a.op == "-" and b.kind == "interval":
            if self.of(a.left, left, right) == "l" and self.of(a.right, left, right) == "r":
                return micros(b.text) - (op == "<")
        return None

    def lateral(self, scope: Scope, j: Node) -> Scope:
        """A window join: aggregates over a table's rows in a range of time around each left row."""
        s, alias = j.table.query.body, j.table.alias or "lateral"
        if s.kind != "select" or s.group or s.joins or s.table is None or not all(i.kind == "item" and has_aggregate(i.expr) for i in s.items):
            raise SqlError("LATERAL must select aggregates from one table, without GROUP BY")
        right, ralias = self.table(s.table)
        right = self.pruned(right, ralias)
        inner = Scope(right, {ralias: right.columns}, False)
        keys, ends, own = [], {}, []
        lex, rex = Emit(self.lcolumn(scope)), Emit(lambda n: quoted(n.parts[-1]))
        for c in conjuncts(s.where):
            if c.kind == "between":
                parts = [Node("binary", op=">=", left=c.x, right=c.low), Node("binary", op="<=", left=c.x, right=c.high)]
            else:
                parts = [c]
            for p in parts:
                if self.of_inner(p, scope, inner) == "r":
                    own.append(p)
                    continue
                pair = self.sides_inner(p, scope, inner)
                if pair is None:
                    raise SqlError("LATERAL's WHERE may hold equalities of keys, a range of time, and conditions on its own table")
                l, r, op = pair
                if op == "=":
                    keys.append((l, r))
                    continue
                base, shift = self.linear(l)
                rbase, rshift = self.linear(r)
                end = "high" if op in (">", ">=") else "low"
                ends[end] = (base, rbase, shift - rshift, op in (">=", "<="))
        if set(ends) != {"low", "high"}:
            raise SqlError("LATERAL's WHERE needs both ends of a range of time, like q.ts BETWEEN t.ts - INTERVAL '1 second' AND t.ts")
        (lt, rt, low, lc), (_, _, high, hc) = ends["low"], ends["high"]
        if own:
            right = right.where(" AND ".join(rex(p) for p in own))
        names, aggs = [], {}
        agg = Emit(lambda n: f"r.{quoted(n.parts[-1])}")
        for i in s.items:
            n = i.alias or name_of(i)
            names.append(n)
            # Rows that an outer join padded have no right row.
            text = agg(i.expr)
            aggs[n] = re.sub(r"\bcount\(\*\)", "count(r)", text)
        lcols = {f"_k{i}": F.expr(lex(l)) for i, (l, _) in enumerate(keys)} | {"_at": F.expr(lex(lt))}
        left = scope.df.select(F.struct(*[F.col(quoted(c)) for c in scope.df.columns]).alias("_row"), *[c.alias(n) for n, c in lcols.items()])
        rights = [rex(r).strip("`") for _, r in keys]
        made = window_join(left, right, "_at", rex(rt), [(f"_k{i}", r) for i, r in enumerate(rights)], aggs, low, high, closed=(lc, hc), aliases=("_l", "_r"))
        made = made.select(F.col("_l._row").alias("_l"), "_r")
        return self.merged(scope, made, alias, names, scope.structs)

    def of_inner(self, e: Node, outer: Scope, inner: Scope) -> str:
        """As `of`, where an unqualified name is the inner table's if it has it."""
        out = set()
        for n in walk(e):
            if n.kind == "col":
                if len(n.parts) > 1:
                    out.add("r" if n.parts[0].lower() in {a.lower() for a in inner.tables} else "l")
                else:
                    out.add("r" if inner.has(n.parts[0]) else "l")
        return "".join(sorted(out))

    def sides_inner(self, c: Node, outer: Scope, inner: Scope) -> tuple[Node, Node, str] | None:
        if c.kind != "binary" or c.op not in ("=", "<", "<=", ">", ">="):
            return None
        a, b = self.of_inner(c.left, outer, inner), self.of_inner(c.right, outer, inner)
        if (a, b) == ("l", "r"):
            return c.left, c.right, c.op
        if (a, b) == ("r", "l"):
            return c.right, c.left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(c.op, c.op)
        return None

    @staticmethod
    def linear(e: Node) -> tuple[Node, int]:
        """A time as a column and microseconds added to it."""
        shift = 0
        while e.kind == "binary" and e.op in "+-" and e.right.kind == "interval":
            shift += micros(e.right.text) * (1 if e.op == "+" else -1)
            e = e.left
        return e, shift

    # ------------------------------------------------------------ SELECT

    def select(self, s: Node, q: Node) -> DataFrame:
        scope = self.relation(s, q)
        if scope is None:
            items = [f"{Emit(_no_column)(i.expr)} AS {quoted(i.alias or name_of(i))}" for i in s.items]
            return self.run(f"SELECT {', '.join(items)}{self.tail(q, Emit(_no_column), [])}", None)
        items = self.expanded(s, scope)
        names = unique([i.alias or name_of(i) for i in items])
        items, s = self.reused(items, s, scope)
        group = self.group(s, items, scope)
        grouped = group is not None
        if any(x.kind == "func" and x.name == "time_bucket_gapfill" for i in items for x in walk(i.expr)):
            return self.filled(s, q, scope, items, names, group)
        from_ = "{rel}"
        alias = next(iter(scope.tables)) if not scope.structs else "rel"
        emit = Emit(scope.column, s.windows)
        emit.streaming = scope.df.isStreaming
        emit.type_of = scope.type_of
        if s.table.kind == "tablefn" and s.table.name == "tumble":
            emit.clock = emit(s.table.args[1])
        if any(x.kind == "func" and x.over is not None and not emit.window(x.over).order and x.name in ("lag", "lead", "row_number", "ema") for i in items for x in walk(i.expr)):
            # Without ORDER BY rows stand in the order in which they came.
            scope = Scope(scope.df.withColumn("_seq", F.monotonically_increasing_id()), scope.tables, scope.structs, [*scope.extra, "_seq"])
            emit.arrival, emit.column = "_seq", scope.column
        if emit.streaming and (q.order or q.limit is not None or q.offset is not None):
            raise SqlError("a live query can't have ORDER BY or LIMIT")
        where = s.where
        moving = [x for i in items for x in walk(i.expr) if x.kind == "func" and x.name == "ema" and x.over is not None]
        if moving:
            scope, where = self.averaged(scope, alias, where, moving, emit)
        order_nodes = [o.expr for o in q.order]
        used = [i.expr for i in items] + ([s.having] if s.having else []) + order_nodes
        if not (grouped or emit.streaming or where is not None and has_aggregate(where)):
            ranges = {x: found for e in used for x in walk(e) if (found := self.time_range(x, emit))}
            if ranges:
                scope, where = self.ranged(scope, alias, where, ranges, emit)
        ordered = list(dict.fromkeys(x for e in used for x in walk(e) if x.kind == "func" and x.name in ORDERED and x.over is None))
        if ordered:
            from_, where = self.staged(ordered, group or [], emit, where, alias)
        selected = ", ".join(f"{emit(i.expr)} AS {quoted(n)}" for i, n in zip(items, names, strict=True))
        text = f"SELECT {'DISTINCT ' if s.distinct else ''}{selected} FROM {from_}"
        if where is not None:
            if has_aggregate(where):
                raise SqlError("aggregates belong in HAVING, not in WHERE")
            text += f" WHERE {emit(where)}"
        if grouped and group:
            by = [re.sub(r"^CAST\((window\(.*\))\.start AS TIMESTAMP_NTZ\)$", r"\1", x) if emit.streaming else x for x in emit.many(group)]
            if emit.streaming and "window" in scope.df.columns:
                by = ["`window`", *by]
            text += f" GROUP BY {', '.join(by)}"
        if s.having is not None:
            by_alias = {(i.alias or "").lower(): i.expr for i in items if i.alias}
            having = rewrite(s.having, lambda n: by_alias.get(n.parts[0].lower()) if n.kind == "col" and len(n.parts) == 1 and not scope.has(n.parts[0]) else None)
            text += f" HAVING {emit(having)}"
        text += self.tail(q, emit, names, items)
        return self.run(text, scope.df, alias)

    @staticmethod
    def reused(items: list[Node], s: Node, scope: Scope) -> tuple[list[Node], Node]:
        """The items, and WHERE, with aliases of earlier items in place of names that no table has."""
        known: dict[str, Node] = {}

        def put(n: Node) -> Node | None:
            if n.kind == "col" and len(n.parts) == 1 and n.parts[0].lower() in known and not scope.has(n.parts[0]):
                return known[n.parts[0].lower()]
            if n.kind == "func" and n.name == "avg" and n.over is not None and len(n.args) == 3:
                return moving_average(n)
            return None

        out = []
        for i in items:
            e = rewrite(i.expr, put)
            out.append(i.copy(expr=e))
            if i.alias:
                known[i.alias.lower()] = e
        return out, s.copy(where=rewrite(s.where, put) if s.where is not None else None)

    def expanded(self, s: Node, scope: Scope) -> list[Node]:
        out = []
        for i in s.items:
            if i.kind != "star":
                out.append(i)
                continue
            aliases = list(scope.tables) if i.of is None else [a for a in scope.tables if a.lower() == i.of.lower()]
            if not aliases:
                raise SqlError(f"no table {i.of}")
            for a in aliases:
                out += [Node("item", expr=Node("col", parts=[a, c]), alias=None, text=c) for c in scope.tables[a]]
        return out

    def group(self, s: Node, items: list[Node], scope: Scope) -> list[Node] | None:
        """The expressions to group by; None without groups, [] for one group of all rows."""
        some = any(has_aggregate(i.expr) for i in items) or (s.having is not None and has_aggregate(s.having))
        if not s.group:
            if some and s.distinct:
                raise SqlError("DISTINCT with aggregates isn't supported")
            return [] if some else None
        out = []
        for g in s.group:
            if g.kind == "all":
                out += [i.expr for i in items if not has_aggregate(i.expr)]
            elif g.kind == "lit" and g.text.isdigit():
                if not 1 <= int(g.text) <= len(items):
                    raise SqlError(f"GROUP BY {g.text}: there are {len(items)} items")
                out.append(items[int(g.text) - 1].expr)
            elif g.kind == "col" and len(g.parts) == 1 and not scope.has(g.parts[0]):
                named = next((i.expr for i in items if (i.alias or "").lower() == g.parts[0].lower()), None)
                if named is None:
                    scope.owner(g.parts[0])
                out.append(named)
            else:
                out.append(g)
        for g in out:
            if has_aggregate(g):
                raise SqlError("GROUP BY an aggregate isn't possible")
        return list(dict.fromkeys(out))

    def staged(self, ordered: list[Node], group: list[Node], emit: Emit, where: Node | None, alias: str) -> tuple[str, None]:
        """FROM with the window columns that ordered aggregates need; fills in their texts."""
        from_ = "{rel}"
        if where is not None:
            from_ = f"(SELECT * FROM {from_} WHERE {emit(where)}) AS {quoted(alias)}"
        part = ", ".join(emit.many(group))
        part = f"PARTITION BY {part} " if part else ""
        for k, n in enumerate(ordered):
            build, params, one = ORDERED[n.name]
            args = n.args
            if one:
                if len(args) != 1 or args[0].kind != "tuple":
                    raise SqlError(f"{n.name}() takes a tuple: {n.name}((time, ...))")
                args = args[0].items
            try:
                made = build(*emit.many(list(n.params or [])[:params]), *emit.many(args))
            except TypeError:
                raise SqlError(f"wrong number of arguments for {n.name}(): {len(args)}") from None
            if n.filter is not None:
                raise SqlError(f"FILTER isn't supported with {n.name}(): filter in a query below")
            marks = {"over": f"OVER ({part}ORDER BY {made.order})", "upto": f"OVER ({part}ORDER BY {made.order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "all": f"OVER ({part.strip()})", "k": k}
            for stage in made.stages:
                cols = ", ".join(f"{x.format(**marks)} AS {c.format(k=k)}" for c, x in stage.items())
                from_ = f"(SELECT *, {cols} FROM {from_}) AS {quoted(alias)}"
            emit.special[n] = made.result.format(k=k)
        return from_, None

    def averaged(self, scope: Scope, alias: str, where: Node | None, moving: list[Node], emit: Emit) -> tuple[Scope, None]:
        """The relation with columns for the moving averages; fills in their texts."""
        for n in dict.fromkeys(moving):
            w = emit.window(n.over)
            if not w.order and emit.arrival:
                w = w.copy(order=[Node("ordering", expr=Node("col", parts=[emit.arrival]), down=False, nulls=None)])
            if len(w.order) != 1 or w.frame is not None:
                raise SqlError("ema() OVER needs ORDER BY the time, and no frame")
            k = next(_numbers)
            keys = [f"_p{k}_{i}" for i in range(len(w.partition))]
            cols = [f"{emit(p)} AS {c}" for p, c in zip(w.partition, keys, strict=True)] + [f"CAST({emit(n.args[0])} AS DOUBLE) AS _x{k}", f"{emit(w.order[0].expr)} AS _o{k}"]
            rows = self.run(f"SELECT *, {', '.join(cols)} FROM {{rel}}{f' WHERE {emit(where)}' if where is not None else ''}", scope.df, alias)
            where = None
            rows = ema(rows, keys, [f"_o{k}"], {f"_ema{k}": (f"_x{k}", decay(float(literal_number(n.args[1]))))})
            scope = Scope(rows, scope.tables, scope.structs, scope.extra)
            emit.special[n] = f"_ema{k}"
        return scope, None

    @staticmethod
    def time_range(n: Node, emit: Emit) -> tuple[int, int] | None:
        """The microseconds from and to which a call's frame reaches around each row, in its window's
        order, if it is a range of time over which `ranged` can work the call out."""
        if n.kind != "func" or n.over is None or AGGREGATE_ALIASES.get(n.name.removesuffix("_if"), n.name.removesuffix("_if")) not in ("count", "sum", "avg", "min", "max") or n.name == "count_if":
            return None
        w = emit.window(n.over)
        if w.frame is None or w.frame[0] != "RANGE" or len(w.order) != 1 or n.params or n.within or (n.distinct and n.name not in ("min", "max")) or len(n.args) > 1 + n.name.endswith("_if"):
            return None
        ends = []
        for way, x in w.frame[1:]:
            if x is None and way == "CURRENT ROW":
                ends.append(0)
            elif x is not None and x.kind == "interval" and way in ("PRECEDING", "FOLLOWING"):
                ends.append(micros(x.text) * (1 if way == "FOLLOWING" else -1))
            else:
                return None
        return (ends[0], ends[1]) if ends[0] < ends[1] else None

    def ranged(self, scope: Scope, alias: str, where: Node | None, ranges: dict[Node, tuple[int, int]], emit: Emit) -> tuple[Scope, None]:
        """The relation with columns for aggregates over ranges of time; fills in their texts."""
        together: dict[tuple, list[Node]] = {}
        for n, ends in ranges.items():
            w = emit.window(n.over)
            together.setdefault((tuple(emit.many(w.partition)), emit(w.order[0].expr), bool(w.order[0].down), *ends), []).append(n)
        for (by, order, down, low, high), calls in together.items():
            k = next(_numbers)
            keys = [f"_p{k}_{i}" for i in range(len(by))]
            cols = [f"{p} AS {c}" for p, c in zip(by, keys, strict=True)] + [f"{'-' if down else ''}{us(order)} AS _o{k}"]
            made: dict[str, tuple[str, str]] = {}
            for i, n in enumerate(calls):
                name, args, cond = emit.arguments(n)
                name = AGGREGATE_ALIASES.get(name, name)
                x = args[0] if args and not n.star else "1"
                x = f"CAST({x} AS DOUBLE)" if name == "avg" else x
                cols.append(f"{f'CASE WHEN {cond} THEN {x} END' if cond else x} AS _x{k}_{i}")
                for part in ("sum", "count") if name == "avg" else (name,):
                    made[f"_{part}{k}_{i}"] = (part, f"_x{k}_{i}")
                emit.special[n] = f"(_sum{k}_{i} / _count{k}_{i})" if name == "avg" else f"_{name}{k}_{i}"
            rows = self.run(f"SELECT *, {', '.join(cols)} FROM {{rel}}{f' WHERE {emit(where)}' if where is not None else ''}", scope.df, alias)
            where = None
            with self.wrapping():
                rows = range_aggregates(rows, keys, f"_o{k}", low, high, made)
            scope = Scope(rows, scope.tables, scope.structs, scope.extra)
        return scope, None

    # ------------------------------------------------------------ gap filling

    def filled(self, s: Node, q: Node, scope: Scope, items: list[Node], names: list[str], group: list[Node] | None) -> DataFrame:
        calls = list(dict.fromkeys(x for i in items for x in walk(i.expr) if x.kind == "func" and x.name == "time_bucket_gapfill"))
        if len(calls) != 1 or not group or calls[0] not in group:
            raise SqlError("time_bucket_gapfill() must be one of the GROUP BY expressions, once")
        call = calls[0]
        emit = Emit(scope.column, s.windows)
        width = width_us(emit(call.args[0]))
        plain = call.copy(name="time_bucket", args=call.args[:2])
        keys = [g for g in group if g != call]
        special = {call: "_bucket"} | {k: f"_key{i}" for i, k in enumerate(keys)}
        columns = [f"{emit(plain)} AS _bucket"] + [f"{emit(k)} AS _key{i}" for i, k in enumerate(keys)]
        carried, lines = [], []
        found: list[Node] = []
        for e in [i.expr for i in items] + [o.expr for o in q.order]:
            for x in walk(e):
                if x.kind == "func" and x.name in ("locf", "interpolate") and len(x.args) == 1:
                    found.append(x)
        for n, x in enumerate(dict.fromkeys(found)):
            name = f"_f{n}"
            (carried if x.name == "locf" else lines).append(name)
            columns.append(f"{emit(x.args[0])} AS {name}")
            special[x] = name
        inner = {y for x in found for y in walk(x.args[0])}
        others = dict.fromkeys(x for e in [i.expr for i in items] for x in walk(e) if is_aggregate(x) and x.name not in ("locf", "interpolate") and x not in inner)
        for n, x in enumerate(others):
            columns.append(f"{emit(x)} AS _a{n}")
            special[x] = f"_a{n}"
        alias = next(iter(scope.tables)) if not scope.structs else "rel"
        text = f"SELECT {', '.join(columns)} FROM {{rel}}" + (f" WHERE {emit(s.where)}" if s.where is not None else "")
        rows = self.run(text + f" GROUP BY {', '.join([emit(plain), *emit.many(keys)])}", scope.df, alias)
        bounds = [self.moment(emit(a)) for a in call.args[2:4]] + [None, None]
        rows = gapfill(rows, "_bucket", width, [f"_key{i}" for i in range(len(keys))], locf=carried, interpolate=lines, start=bounds[0], finish=bounds[1])
        out = Emit(lambda n: _unknown(n), special=special)
        selected = ", ".join(f"{out(i.expr)} AS {quoted(n)}" for i, n in zip(items, names, strict=True))
        having = f" WHERE {out(s.having)}" if s.having is not None else ""
        return self.run(f"SELECT {selected} FROM {{rel}}{having}{self.tail(q, out, names)}", rows)

    @staticmethod
    def moment(text: str) -> str:
        return f"TIMESTAMP_NTZ{text}" if text.startswith("'") else text

    # ------------------------------------------------------------ PIVOT

    def pivot(self, p: Node) -> DataFrame:
        """Groups by the other columns (or `group`) and spreads the aggregates over the values of `on`."""
        df, alias = self.table(p.table)
        scope = Scope(df, {alias: df.columns}, False)
        emit = Emit(scope.column)
        used = {n.parts[-1].lower() for e in [p.on, *(i.expr for i in p.using)] for n in walk(e) if n.kind == "col"}
        group = p.group if p.group is not None else [Node("col", parts=[c]) for c in df.columns if c.lower() not in used]
        group_names = unique([g.parts[-1] if g.kind == "col" else f"g{i}" for i, g in enumerate(group)])
        rows = self.run("SELECT *, " + ", ".join([f"{emit(p.on)} AS _on", *[f"{emit(g)} AS _g{i}" for i, g in enumerate(group)]]) + " FROM {rel}", df, alias)
        if p.values is None:
            # The values are found first: one row each.
            values = [(r[0], None) for r in rows.select("_on").where("_on IS NOT NULL").distinct().orderBy("_on").limit(1001).collect()]
            if len(values) > 1000:
                raise SqlError("PIVOT over more than 1000 values: name the ones you need with IN")
        elif isinstance(p.values, Node):
            values = [(r[0], None) for r in self.query(p.values).limit(1001).collect()]
        else:
            values = [(constant(v.expr if v.kind == "item" else v), v.alias if v.kind == "item" else None) for v in p.values]
        aggs, labels = [], []
        plain = Emit(lambda n: quoted(n.parts[-1]))
        for i, u in enumerate(p.using):
            # A pivot can't count all rows; counting a constant is the same.
            aggs.append(F.expr(plain(u.expr).replace("count(*)", "count(1)")).alias(f"_v{i}"))
            labels.append(u.alias or (name_of(u) if len(p.using) > 1 else None))
        grouped = rows.groupBy(*[f"_g{i}" for i in range(len(group))])
        out = grouped.pivot("_on", [v for v, _ in values]).agg(*aggs)
        made = [F.col(f"_g{i}").alias(n) for i, n in enumerate(group_names)]
        position = len(group)
        columns = out.columns
        for v, name in values:
            for label in labels:
                base = name or str(v)
                made.append(F.col(quoted(columns[position])).alias(f"{base}_{label}" if label and len(labels) > 1 else base if not label or len(labels) == 1 and p.using[0].alias is None else f"{base}_{label}"))
                position += 1
        return out.select(*made)


def moving_average(n: Node) -> Node:
    """avg(x, 'alpha', a) and avg(x, 'period', n) as ema."""
    x, how, value = n.args
    if how.kind != "string" or how.value not in ("alpha", "period"):
        raise SqlError("avg() with three arguments is avg(x, 'alpha', a) or avg(x, 'period', n)")
    if how.value == "period":
        value = Node("lit", text=repr(decay(float(literal_number(value)))))
    return n.copy(name="ema", args=[x, value])


def conjuncts(e: Node | None) -> list[Node]:
    if e is None:
        return []
    if e.kind == "binary" and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def name_of(i: Node) -> str:
    return i.expr.parts[-1] if i.expr.kind == "col" else i.text


def unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        new, k = n, 0
        while new.lower() in {x.lower() for x in out}:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def constant(e: Node) -> object:
    if e.kind == "string":
        return e.value
    if e.kind == "lit":
        return {"TRUE": True, "FALSE": False, "NULL": None}.get(e.text, float(e.text) if "." in e.text else int(e.text) if e.text.lstrip("-").isdigit() else e.text)
    raise SqlError("expected a constant")


def literal_number(e: Node) -> str:
    if e.kind != "lit":
        raise SqlError("expected a number")
    return e.text


def _no_column(n: Node) -> str:
    raise SqlError(f"no column {'.'.join(n.parts)!r}: there is no FROM")


def _unknown(n: Node) -> str:
    raise SqlError(f"column {'.'.join(n.parts)!r} must be grouped by, or in an aggregate")

