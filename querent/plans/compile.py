"""From an analysed query to DataFrames: one declarative plan that Catalyst optimises.

Every alias's attributes are columns alias__attribute, so self joins and correlation need no qualifiers.
"""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.catalog.schema import Backend, Catalog
from querent.catalog.types import Type, decode, interval, wider
from querent.errors import QueryError
from querent.functions import temporal as tm
from querent.functions.registry import AGGREGATE, Given
from querent.lang import tree as t
from querent.plans.analyze import Analysis, Binding, BlockInfo, SelectInfo, SetInfo, attribute_name
from querent.plans.typing import OPERATORS, Typing
from querent.sources.store import Rounds

FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: window functions that give tied rows one value, and those that tell them apart whatever the frame
PEERS, PLACED = {"rank", "dense_rank", "percent_rank", "cume_dist"}, {"row_number", "ntile", "lag", "lead", "first_value"}


def column_name(alias: str, attribute: str) -> str:
    return f"{alias}__{attribute}"


class Env:
    """Where an expression is built: its select, and columns that stand for whole expressions after grouping."""

    def __init__(self, info: SelectInfo, known: dict | None = None):
        self.info, self.known = info, known or {}


class Compiler:
    def __init__(self, spark: SparkSession, analysis: Analysis, typing: Typing, backend: Backend):
        self.spark, self.a, self.types, self.backend = spark, analysis, typing.types, backend
        self.catalog: Catalog = analysis.catalog
        self.blocks: dict[str, DataFrame] = {}
        self.kept: list = []
        self.used: set[tuple[str, str]] = set()
        for b in self.a.blocks.values():
            self.note_set(b.body)
        self.note_set(self.a.body)

    def note_set(self, s: SetInfo) -> None:
        for info in s.selects():
            self.note(info)

    def note(self, info: SelectInfo) -> None:
        """Remembers which attributes a select uses: scans project only those."""
        for e in info.edges:
            for x, y in e.pairs:
                self.used |= {(e.parent, x), (e.child, y)}
        for node in [i.value for i in info.items] + info.conditions + info.having + [x for v in info.inside.values() for x in v]:
            self.used |= {(x.alias, x.name) for x in t.walk(node, into_selects=False) if isinstance(x, t.Attr)}
            if not info.grouped and any(self.placed(x) for x in t.walk(node, into_selects=False)):
                self.used |= {(b.alias, name) for b in info.bindings.values() for name in self.key(b)}
        for inner in info.inner.values():
            self.note(inner)

    def placed(self, x) -> bool:
        """A window call that depends on which of two rows comes first that its ORDER leaves equal."""
        return isinstance(x, t.Call) and x.window is not None and bool(x.window.order) and x.name not in PEERS and (x.name in PLACED or x.window.frame is not None)

    def key(self, b: Binding) -> list[str]:
        """The attributes of its primary key. Of a block all, and of a table without a key what is read: rows equal in these are the same to the query."""
        if b.block:
            return b.block.names()
        columns = self.catalog.tables[b.entity.table].primary_key
        return [attribute_name(b.entity, c.name) for c in columns] or [name for name, _ in self.attributes(b) if (b.alias, name) in self.used]

    def attributes(self, b: Binding) -> list[tuple[str, str]]:
        """An entity's attributes with their columns, then @column for those that the model does not show."""
        shown = {a.column for a in b.entity.attributes}
        return [(a.name, a.column) for a in b.entity.attributes] + [(f"@{c.name}", c.name) for c in self.catalog.tables[b.entity.table].columns if c.name not in shown]

    def query(self) -> DataFrame:
        for b in self.a.blocks.values():
            self.blocks[b.name] = self.recursive(b) if b.recursive else self.set(b.body)
        df = self.set(self.a.body)
        first = self.a.body.selects()[0]
        hidden = [n for n, i in zip(first.names(), first.items) if i.hidden]
        return df.drop(*hidden) if hidden else df

    # sets

    def set(self, s: SetInfo) -> DataFrame:
        if s.select:
            return self.select(s.select)
        left, right = self.set(s.left), self.set(s.right)
        return self.combined(s.op, left, right)

    def combined(self, op: str, left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.toDF(*left.columns)
        if op == "UNION":
            return left.unionAll(right).distinct()
        if op == "UNIONALL":
            return left.unionAll(right)
        return left.subtract(right) if op == "MINUS" else left.intersect(right)

    def recursive(self, b: BlockInfo) -> DataFrame:
        """The rows of the branches without the block, then again and again what its other branches make of the newest rows, until there are none."""
        top = b.body
        uses = lambda s: any(x.block is b for x in s.bindings.values())
        if top.op not in ("UNION", "UNIONALL") or any(map(uses, top.left.selects())):
            raise QueryError(f"recursive block {b.name} is a UNION or UNIONALL of a start and the branch that uses it", b.node.span, self.a.text)
        start = self.set(top.left)
        distinct = top.op == "UNION"
        rounds = Rounds(self.spark)
        newest = rounds.add(start.distinct() if distinct else start)
        names = newest.columns
        while not newest.isEmpty():
            self.blocks[b.name] = newest
            after = self.set(top.right).toDF(*names)
            after = after.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in newest.schema])
            if distinct:
                after = self.unseen(after.distinct(), rounds.all())
            newest = rounds.add(after)
        return rounds.all()

    def unseen(self, df: DataFrame, seen: DataFrame) -> DataFrame:
        """Rows of df that seen does not hold; nulls are equal to each other."""
        right = seen.toDF(*[f"__{i}" for i in range(len(seen.columns))])
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(df.columns)]
        return df.join(right, reduce(and_, same), "left_anti")

    # selects

    def scan(self, info: SelectInfo, alias: str) -> DataFrame:
        b = info.bindings[alias]
        if b.block:
            df = self.blocks[b.block.name]
            return df.select(*[F.col(f"`{n}`").alias(column_name(alias, n)) for n in df.columns])
        table = self.catalog.tables[b.entity.table]
        df = self.backend.frame(table.name)
        out = []
        for name, column in self.attributes(b):
            c = table.column(column) if (alias, name) in self.used else None
            if c is not None and c.encoding:
                out.append(F.col(f"`{column}`").alias(column_name(alias, name) + "__raw"))  # for comparisons with literals
            if c is not None:
                out.append(decode(F.col(f"`{column}`"), c.type.family or "", c.encoding, df.schema[column].dataType, self.backend.zone).alias(column_name(alias, name)))
        return df.select(*out) if out else df.select(F.lit(1).alias(column_name(alias, "@none")))

    def joined(self, info: SelectInfo) -> DataFrame:
        down: dict[str, list] = {}
        for e in info.edges:
            if not e.back and e.parent in info.bindings:
                down.setdefault(e.parent, []).append(e)
        env = Env(info)

        def grow(df: DataFrame, alias: str) -> DataFrame:
            for e in down.get(alias, ()):
                condition = [F.col(column_name(e.parent, x)) == F.col(column_name(e.child, y)) for x, y in e.pairs]
                if not e.optional:
                    df = grow(df.join(self.scan(info, e.child), condition, "inner"), e.child)
                else:
                    # the optional part is complete, with its conditions, before it is joined
                    part = grow(self.scan(info, e.child), e.child)
                    if info.inside.get(e.child):
                        part = part.where(reduce(and_, [self.logical(x, env) for x in info.inside[e.child]]))
                    df = df.join(part, condition, "left")
            return df

        df = grow(self.scan(info, info.start), info.start)
        for e in info.edges:
            if e.back:
                df = df.where(reduce(and_, [F.col(column_name(e.parent, x)) == F.col(column_name(e.child, y)) for x, y in e.pairs]))
        return df

    def filtered(self, info: SelectInfo) -> DataFrame:
        df, env = self.joined(info), Env(info)
        return df.where(reduce(and_, [self.logical(x, env) for x in info.conditions])) if info.conditions else df

    def select(self, info: SelectInfo) -> DataFrame:
        df, names = self.filtered(info), info.names()
        values = [i.value for i in info.items]
        if info.grouped:
            df, env = self.grouped(info, df, values)
        else:
            env = Env(info)
        if not values:
            df = df.select(F.lit(1).alias("_1"))
        else:
            df = df.select(*[self.typed(v, env).alias(n, metadata=self.metadata(info, i)) for i, v, n in zip(info.items, values, names)])
        if info.node.distinct:
            df = df.distinct()
        order = sorted(((i.priority if i.priority else k + 1, k, i.direction) for k, i in enumerate(info.items) if i.direction), key=lambda x: (x[0], x[1]))
        if order:
            df = df.orderBy(*[F.col(f"`{names[k]}`").desc_nulls_last() if d == "DESC" else F.col(f"`{names[k]}`").asc_nulls_last() for _, k, d in order])
        return df.limit(info.node.limit) if info.node.limit is not None else df

    def metadata(self, info: SelectInfo, item: t.Item) -> dict:
        """The label of an output column: its own, else that of its attribute."""
        label = item.label
        if label is None and isinstance(item.value, t.Attr):
            b, _ = info.find(item.value.alias)
            a = b and b.entity and b.entity.attribute(item.value.name)
            label = a.label if a else None
        return {"label": label} if label else {}

    def grouped(self, info: SelectInfo, df: DataFrame, values: list) -> tuple[DataFrame, Env]:
        """Groups by every output without aggregates; returns what outputs and HAVING are built from."""
        env, known, keys, aggregates = Env(info), {}, [], []
        windowed = lambda v: any(isinstance(x, t.Call) and x.window is not None for x in t.walk(v, into_selects=False))
        for v in values:
            if self.a.has_aggregate(v) or windowed(v) or isinstance(v, (t.Number, t.Text, t.Null)) or v in known:
                continue
            known[v] = f"__k{len(keys)}"
            keys.append(self.column(v, env).alias(known[v]))
        for v in [*values, *info.having]:
            for x in t.walk(v, into_selects=False):
                if self.a.is_aggregate(x) and x not in known:
                    known[x] = f"__a{len(aggregates)}"
                    aggregates.append(self.column(x, env).alias(known[x]))
        if not aggregates:
            aggregates = [F.count(F.lit(1)).alias("__rows")]
        if info.node.rollup and keys:
            named = [F.col(n) for v, n in known.items() if n.startswith("__k")]
            df = df.select("*", *keys).rollup(*named).agg(*aggregates)
        else:
            df = df.groupBy(*keys).agg(*aggregates) if keys else df.select(*aggregates)
        env = Env(info, known)
        for x in info.having:
            df = df.where(self.logical(x, env))
        return df, env

    # conditions

    def logical(self, node, env: Env) -> Column:
        if isinstance(node, t.And):
            return reduce(and_, [self.logical(x, env) for x in node.items])
        if isinstance(node, t.Or):
            return reduce(or_, [self.logical(x, env) for x in node.items])
        if isinstance(node, t.Not):
            x = node.item
            if isinstance(x, t.Predicate) and OPERATORS.get(x.op, x.op) == "IN" and isinstance(x.right[0], t.SubSelect):
                return self.not_in(x, env)
            return ~self.logical(x, env)
        if isinstance(node, t.Exists):
            return self.exists(node, env)
        return self.predicate(node, env)

    def exists(self, node: t.Exists, env: Env) -> Column:
        info = env.info.inner[id(node)]
        edge = info.edges[0]
        df = self.filtered(info)
        df = df.where(reduce(and_, [F.col(column_name(edge.child, y)) == F.col(column_name(edge.parent, x)).outer() for x, y in edge.pairs]))
        return df.exists()

    def inner_value(self, node: t.SubSelect, env: Env) -> tuple[DataFrame, Column]:
        info = env.info.inner[id(node)]
        return self.select(info), F.col(f"`{info.names()[0]}`")

    def outer_value(self, node, env: Env) -> Column:
        """An expression of this select, seen from inside a sub-select."""
        return self.column(node, env).outer() if isinstance(node, t.Attr) else self._outer_tree(node, env)

    def _outer_tree(self, node, env: Env) -> Column:
        return self.column(node, OuterEnv(env))

    def predicate(self, node: t.Predicate, env: Env) -> Column:
        op = OPERATORS.get(node.op, node.op)
        if op == "IN" and isinstance(node.right[0], t.SubSelect):
            df, value = self.inner_value(node.right[0], env)
            return df.where(value == self.outer_value(node.left, env)).exists()
        left = self.column(node.left, env)
        kind = self.types.get(id(node.left), Type())
        if op == "holds":
            return left
        if op == "ISNULL":
            return left.isNull()
        if op == "LIKE":
            right = node.right[0]
            if isinstance(right, t.Text):
                return left.like(right.value.replace("\\", "\\\\"))
            return F.call_function("like", left, F.replace(self.column(right, env), F.lit("\\"), F.lit("\\\\")))
        if op == "BETWEEN":
            low, high = node.right
            if isinstance(high, (t.DateLiteral, t.TimestampLiteral)) and kind.family in ("DATE", "TIMESTAMP", None):
                # an upper bound takes its whole day
                day = high.value if isinstance(high, t.DateLiteral) else high.value.date()
                above = self.compared("<", node.left, self.made(t.DateLiteral(day + timedelta(days=1)), Type("DATE")), env)
            else:
                above = self.compared("<=", node.left, high, env)
            return self.compared(">=", node.left, low, env) & above
        if op == "IN":
            return reduce(or_, [self.compared("=", node.left, x, env) for x in node.right]) if kind.family in ("DATE", "TIMESTAMP", "INTERVAL") else left.isin(*[self.column(x, env) for x in node.right])
        if op in ("=", "<", "<=", ">", ">="):
            return self.compared(op, node.left, node.right[0], env)
        return F.call_function(op, left, *[self.column(x, env) for x in node.right])

    def not_in(self, node: t.Predicate, env: Env) -> Column:
        """SQL's NOT IN without its null trap for the planner: an anti join, and checks for nulls beside it."""
        df, value = self.inner_value(node.right[0], env)
        x = self.outer_value(node.left, env)
        missing = ~df.where(value == x).exists()
        return missing & ~df.where(value.isNull()).exists() & (self.column(node.left, env).isNotNull() | ~df.exists())

    def made(self, node, kind: Type):
        """A node of our own, with its type; it stays alive so that its id stays its own."""
        self.kept.append(node)
        self.types[id(node)] = kind
        return node

    def raw_compared(self, op: str, a, b, env: Env) -> Column | None:
        """An encoded column against a literal as a comparison of what is stored, which reaches the scan; None where that isn't the same."""
        if not isinstance(a, t.Attr) or a in env.known:
            return None
        binding, outer = env.info.find(a.alias)
        if binding is None or binding.entity is None or outer or isinstance(env, OuterEnv):
            return None
        c = self.catalog.column_of(binding.entity.name, a.name)
        kind, _, detail = ((c and c.encoding) or "").partition(":")
        if kind == "DATE_FROM_EPOCH_DAY" and isinstance(b, t.DateLiteral):
            value = Fraction((b.value - date(1970, 1, 1)).days)
        elif kind == "EPOCH" and detail in ("SECONDS", "MILLIS", "MICROS") and self.backend.zone == "UTC" and isinstance(b, (t.DateLiteral, t.TimestampLiteral)):
            at = b.value if isinstance(b, t.TimestampLiteral) else datetime.combine(b.value, datetime.min.time())
            value = Fraction((at - datetime(1970, 1, 1)) // timedelta(microseconds=1), {"SECONDS": 1_000_000, "MILLIS": 1000, "MICROS": 1}[detail])
        elif kind == "SCALED" and isinstance(b, t.Number):
            value = Fraction(b.value) * 10 ** int(detail)
        else:
            return None
        raw = F.col(column_name(a.alias, a.name) + "__raw")
        if op == "=" and value.denominator != 1:
            return F.when(raw.isNotNull(), False)
        # a value between two stored ones moves to the one that keeps the comparison
        n = math.ceil(value) if op in ("<", ">=") else math.floor(value)
        return {"=": raw == n, "<": raw < n, "<=": raw <= n, ">": raw > n, ">=": raw >= n}[op]

    def compared(self, op: str, a, b, env: Env) -> Column:
        direct = self.raw_compared(op, a, b, env)
        if direct is None and op in FLIPPED:
            direct = self.raw_compared(FLIPPED[op], b, a, env)
        if direct is not None:
            return direct
        x, y = self.column(a, env), self.column(b, env)
        p, q = self.types.get(id(a), Type()), self.types.get(id(b), Type())
        if {p.family, q.family} == {"DATE", "TIMESTAMP"}:
            x, y = x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
        elif p.family == q.family == "INTERVAL":
            x, y = self.durations(a, b, x, y, p, q, op)
        return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def durations(self, a, b, x: Column, y: Column, p: Type, q: Type, op: str) -> tuple[Column, Column]:
        literal = b if isinstance(b, t.Duration) else a if isinstance(a, t.Duration) else None
        if p.seconds or q.seconds:
            return self.seconds(a, x, p), self.seconds(b, y, q)
        if literal is not None and op != "=":
            name = {"months": "months", "days": "days", "clock": "nanos"}[tm.unit_class(literal.parts) or "clock"]
            return x[name], y[name]
        return x, y

    def seconds(self, node, c: Column, kind: Type) -> Column:
        if kind.seconds:
            return c
        if isinstance(node, t.Duration):
            _, days, ms = tm.totals(node.parts)
            return F.lit(days * tm.DAY + ms // 1000).cast("bigint")
        return (c["days"] * tm.DAY + F.floor(c["nanos"] / 1_000_000_000)).cast("bigint")

    # expressions

    def typed(self, node, env: Env) -> Column:
        """An output column; a NULL of no type is a string."""
        if isinstance(node, t.Null):
            return F.lit(None).cast("string")
        return self.column(node, env)

    def column(self, node, env: Env) -> Column:
        if node in env.known:
            return F.col(env.known[node])
        if isinstance(node, t.Number):
            return F.lit(node.value)
        if isinstance(node, t.Text):
            return F.lit(node.value)
        if isinstance(node, t.Null):
            return F.lit(None)
        if isinstance(node, t.DateLiteral):
            return F.lit(node.value)
        if isinstance(node, t.TimestampLiteral):
            return F.lit(node.value.isoformat(sep=" ")).cast("timestamp_ntz")
        if isinstance(node, t.TimeLiteral):
            return F.lit(int(node.seconds)).cast("bigint")
        if isinstance(node, t.Duration):
            return tm.literal(node.parts)
        if isinstance(node, t.Attr):
            b, outer = env.info.find(node.alias)
            if b is None:
                raise QueryError(f"unknown alias {node.alias}", node.span, self.a.text)
            c = F.col(column_name(node.alias, node.name))
            return c.outer() if outer or isinstance(env, OuterEnv) else c
        if isinstance(node, t.Negative):
            return self.negative(node, env)
        if isinstance(node, t.Arithmetic):
            return self.arithmetic(node, env)
        if isinstance(node, t.SubSelect):
            df, _ = self.inner_value(node, env)
            return df.scalar()
        if isinstance(node, t.Call):
            return self.call(node, env)
        return self.logical(node, env)

    def type(self, node) -> Type:
        return self.types.get(id(node), Type())

    def negative(self, node: t.Negative, env: Env) -> Column:
        c, kind = self.column(node.value, env), self.type(node.value)
        if kind.family == "INTERVAL" and not kind.seconds:
            return F.when(c.isNotNull(), interval(-c["months"], -c["days"], -c["nanos"]))
        return -c

    def arithmetic(self, node: t.Arithmetic, env: Env) -> Column:
        a, b, op = self.type(node.left), self.type(node.right), node.op
        x, y = self.column(node.left, env), self.column(node.right, env)
        sign = -1 if op == "-" else 1
        if a.family in ("DATE", "TIMESTAMP", "TIME") and b.family == "INTERVAL":
            if isinstance(node.right, t.Duration):
                return tm.plus_duration(x, a, node.right.parts, sign)[0]
            return tm.plus_interval(x, a, y, b, sign)[0]
        if {a.family, b.family} == {"DATE", "TIME"}:
            day, time = (x, y) if a.family == "DATE" else (y, x)
            return day.cast("timestamp_ntz") + tm.dt(0, time)
        if op == "-" and a.family == b.family == "DATE":
            days = F.datediff(x, y)
            return F.when(days.isNotNull(), interval(0, days))
        if op == "-" and a.family in ("DATE", "TIMESTAMP") and b.family in ("DATE", "TIMESTAMP"):
            return tm.elapsed(x.cast("timestamp_ntz"), y.cast("timestamp_ntz"))
        if a.family == "INTERVAL" and b.family == "INTERVAL":
            if a.seconds or b.seconds:
                return self.seconds(node.left, x, a) + sign * self.seconds(node.right, y, b)
            return F.when(x.isNotNull() & y.isNotNull(), interval(x["months"] + sign * y["months"], x["days"] + sign * y["days"], x["nanos"] + sign * y["nanos"]))
        if op == "*" and "INTERVAL" in (a.family, b.family):
            span, kind, n = (x, a, y) if a.family == "INTERVAL" else (y, b, x)
            return span * n if kind.seconds else F.when(span.isNotNull() & n.isNotNull(), interval(span["months"] * n, span["days"] * n, span["nanos"] * n))
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op]()

    def call(self, node: t.Call, env: Env) -> Column:
        if node.name in ("coalesce", "case"):
            out = self.conditional(node, env)
        else:
            types = [self.type(x) for x in node.args]
            columns = [self.column(x, env) for x in node.args]
            f = self.a.registry.find(node.name, types)
            if f is None:
                out = F.call_function(node.name, *columns)
            else:
                literals = [x.value if isinstance(x, (t.Number, t.Text)) else None for x in node.args]
                literals = [float(v) if isinstance(v, Decimal) else v for v in literals]
                out = f.build(Given(columns, types, literals, self.backend.zone))
                if f.kind == AGGREGATE and node.window is None:
                    return out
        if node.window is None:
            return out
        out = out.over(self.window(node.window, env, self.ties(node.window, env) if self.placed(node) else []))
        return out.cast("bigint") if node.name in ("row_number", "rank", "dense_rank", "ntile") else out

    def ties(self, w: t.Window, env: Env) -> list[Column]:
        """What decides after ORDER, so that a result does not hang on the order in which rows arrive: a group's keys, else the keys of all that is joined."""
        given = {*w.partition, *w.order}
        if env.info.grouped:
            return [F.col(name) for v, name in env.known.items() if name.startswith("__k") and v not in given]
        had = {(x.alias, x.name) for x in given if isinstance(x, t.Attr)}
        return [F.col(column_name(b.alias, name)) for b in env.info.bindings.values() for name in self.key(b) if (b.alias, name) not in had]

    def window(self, w: t.Window, env: Env, ties: list[Column]):
        out = W.partitionBy(*[self.column(x, env) for x in w.partition])
        if w.order:
            keys = [self.column(x, env) for x in w.order]
            last = len(keys) - 1  # the direction stands for the last key
            out = out.orderBy(*[k.desc_nulls_last() if w.descending and i == last else k.asc_nulls_last() for i, k in enumerate(keys)], *[k.asc_nulls_last() for k in ties])
        if w.frame is not None:
            out = out.rowsBetween(W.unboundedPreceding if w.frame.low is None else w.frame.low, W.unboundedFollowing if w.frame.high is None else w.frame.high)
        return out

    def conditional(self, node: t.Call, env: Env) -> Column:
        args, kind = node.args, self.type(node)

        def branch(x) -> Column:
            c, own = self.column(x, env), self.type(x)
            if kind.family and own != kind and wider(own, kind) is not None and own.family is not None:
                return c.cast(kind.spark())
            return c

        if node.name == "coalesce":
            return F.coalesce(*[branch(x) for x in args])
        last = len(args) - len(args) % 2
        out = F
        for i in range(0, last, 2):
            condition = args[i]
            c = self.logical(condition, env) if isinstance(condition, (t.And, t.Or, t.Not, t.Predicate, t.Exists)) else self.column(condition, env)
            out = out.when(c, branch(args[i + 1]))
        return out.otherwise(branch(args[-1])) if len(args) % 2 else out


class OuterEnv(Env):
    """Attributes are marked as an outer select's."""

    def __init__(self, env: Env):
        super().__init__(env.info, env.known)
