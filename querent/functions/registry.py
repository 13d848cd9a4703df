"""Functions by name: overloads with argument families, a result type and the column they build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from querent.catalog.types import ANY, Type

SCALAR, AGGREGATE, WINDOW = "scalar", "aggregate", "window"


@dataclass(frozen=True)
class Param:
    name: str
    families: frozenset[str] = ANY
    optional: bool = False
    repeated: bool = False


@dataclass
class Given:
    """What a builder gets: columns, their types, literal values (None for others) and the model's zone."""

    columns: list[Column]
    types: list[Type]
    literals: list
    zone: str = "UTC"


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[Param, ...]
    result: Callable[[list[Type]], Type]
    build: Callable[[Given], Column]
    kind: str = SCALAR

    def takes(self, count: int) -> bool:
        least = sum(not p.optional and not p.repeated for p in self.params)
        return least <= count and (count <= len(self.params) or any(p.repeated for p in self.params))

    def param(self, i: int) -> Param:
        return self.params[min(i, len(self.params) - 1)]

    def fits(self, types: list[Type]) -> bool:
        return self.takes(len(types)) and all(x.family is None or x.family in self.param(i).families for i, x in enumerate(types))

    def __str__(self) -> str:
        names = [f"{p.name}..." if p.repeated else f"[{p.name}]" if p.optional else p.name for p in self.params]
        return f"{self.name}({', '.join(names)})"


class CallError(Exception):
    pass


@dataclass
class Registry:
    functions: dict[str, list[Function]] = field(default_factory=dict)
    refused: set[str] = field(default_factory=set)

    def register(self, *functions: Function) -> Registry:
        for f in functions:
            self.functions.setdefault(f.name, []).append(f)
        return self

    def override(self, name: str, build: Callable[[Given], Column], count: int | None = None) -> Registry:
        """Other columns for all overloads, or for those of one number of arguments."""
        self.functions[name] = [replace(f, build=build) if count is None or f.takes(count) else f for f in self.functions[name]]
        return self

    def unsupported(self, name: str) -> Registry:
        self.refused.add(name)
        return self

    def copy(self) -> Registry:
        return Registry({k: list(v) for k, v in self.functions.items()}, set(self.refused))

    def kind(self, name: str) -> str:
        found = self.functions.get(name)
        return found[0].kind if found else SCALAR

    def find(self, name: str, types: list[Type]) -> Function | None:
        """The overload for arguments of these types; None for a name that isn't known, which is passed on to Spark."""
        if name in self.refused:
            raise CallError(f"function '{name}' is not supported by this dialect")
        every = self.functions.get(name)
        if every is None:
            return None
        some = [f for f in every if f.takes(len(types))]
        if not some:
            raise CallError(f"no overload of '{name}' matches {len(types)} argument(s) — candidates: {', '.join(map(str, every))}")
        fit = [f for f in some if f.fits(types)]
        if not fit:
            given = ", ".join(map(str, types))
            raise CallError(f"no overload of '{name}' takes ({given}) — candidates: {', '.join(f'{f} of {_families(f)}' for f in some)}")
        if len(fit) > 1:
            for i, x in enumerate(types):
                if x.family is None and len({f.param(i).families for f in fit}) > 1:
                    raise CallError(f"ambiguous call to '{name}': argument {i + 1} is untyped (NULL) — candidates: {', '.join(f'{f} of {_families(f)}' for f in fit)}")
        return fit[0]

    def from_sql(self, spark: SparkSession, name: str, params: dict[str, Type], result: Type, sql: str) -> Registry:
        """A function written as a SQL expression over its parameters' names."""
        listed = ", ".join(f"{k} {v.spark()}" for k, v in params.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {result.spark()} RETURN {sql}")
        given = tuple(Param(k, frozenset({v.family})) for k, v in params.items())
        return self.register(Function(name, given, lambda _: result, lambda g: F.call_function(name, *g.columns)))

    def from_spark(self, name: str, params: dict[str, Type], result: Type, kind: str = AGGREGATE) -> Registry:
        """A function that the session knows, built in or registered there by a user, as a scalar, aggregate or window function."""
        given = tuple(Param(k, frozenset({v.family})) for k, v in params.items())
        return self.register(Function(name, given, lambda _: result, lambda g: F.call_function(name, *g.columns), kind))


def _families(f: Function) -> str:
    return "(" + ", ".join("ANY" if p.families == ANY else "|".join(sorted(p.families)) for p in f.params) + ")"
