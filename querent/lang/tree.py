"""The query tree. Nodes carry the span of text they were read from, which does not count in comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from querent.errors import Span

SPAN: Any = field(default=(0, 0), compare=False, repr=False)


# expressions


@dataclass(frozen=True)
class Number:
    value: int | Decimal
    span: Span = SPAN


@dataclass(frozen=True)
class Text:
    value: str
    span: Span = SPAN


@dataclass(frozen=True)
class Null:
    span: Span = SPAN


@dataclass(frozen=True)
class DateLiteral:
    value: date
    span: Span = SPAN


@dataclass(frozen=True)
class TimestampLiteral:
    value: datetime
    span: Span = SPAN


@dataclass(frozen=True)
class TimeLiteral:
    seconds: Decimal  # of the day
    span: Span = SPAN


@dataclass(frozen=True)
class Duration:
    """Components in the order they were written, such as ((1, "mo"), (2, "d"))."""

    parts: tuple[tuple[int, str], ...]
    span: Span = SPAN


@dataclass(frozen=True)
class Attr:
    alias: str
    name: str
    span: Span = SPAN


@dataclass(frozen=True)
class Identity:
    """A bare alias as an argument: stands for the primary key of its entity."""

    alias: str
    span: Span = SPAN


@dataclass(frozen=True)
class Frame:
    """Row offsets; None is unbounded."""

    low: int | None
    high: int | None


@dataclass(frozen=True)
class Window:
    partition: tuple = ()
    order: tuple = ()
    descending: bool = False
    frame: Frame | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    window: Window | None = None
    span: Span = SPAN


@dataclass(frozen=True)
class Arithmetic:
    op: str  # + - * /
    left: Any
    right: Any
    span: Span = SPAN


@dataclass(frozen=True)
class Negative:
    value: Any
    span: Span = SPAN


@dataclass(frozen=True)
class SubSelect:
    select: Select
    span: Span = SPAN


# conditions


@dataclass(frozen=True)
class And:
    items: tuple
    span: Span = SPAN


@dataclass(frozen=True)
class Or:
    items: tuple
    span: Span = SPAN


@dataclass(frozen=True)
class Not:
    item: Any
    span: Span = SPAN


@dataclass(frozen=True)
class Predicate:
    """left op right...; op "holds" is a boolean expression by itself."""

    left: Any
    op: str
    right: tuple = ()
    span: Span = SPAN


@dataclass(frozen=True)
class Exists:
    link: Link
    links: tuple = ()
    filter: Any = None
    span: Span = SPAN


@dataclass(frozen=True)
class Placeholder:
    left: Any
    op: str | None
    name: str
    span: Span = SPAN


# queries


@dataclass(frozen=True)
class Source:
    name: str
    alias: str
    span: Span = SPAN


@dataclass(frozen=True)
class Link:
    source: Source
    start: str | None = None  # alias it starts from; the source before it where None
    via: str | None = None
    optional: bool = False
    span: Span = SPAN


@dataclass(frozen=True)
class Item:
    value: Any
    header: str | None = None
    label: str | None = None
    direction: str | None = None  # ASC, DESC
    priority: int | None = None
    hidden: bool = False
    span: Span = SPAN


@dataclass(frozen=True)
class Select:
    source: Source
    links: tuple[Link, ...] = ()
    filter: Any = None
    items: tuple[Item, ...] = ()
    distinct: bool = False
    rollup: bool = False
    limit: int | None = None
    span: Span = SPAN


@dataclass(frozen=True)
class SetOperation:
    op: str  # UNION UNIONALL MINUS INTERSECT
    left: Any
    right: Any
    span: Span = SPAN


@dataclass(frozen=True)
class Block:
    name: str
    body: Any = None
    placeholder: str | None = None
    span: Span = SPAN


# charts


@dataclass(frozen=True)
class Mapping:
    channel: str
    value: Any = None  # a column's name, a literal; "*" as channel maps all
    literal: bool = False
    span: Span = SPAN


@dataclass(frozen=True)
class Layer:
    mark: str
    mappings: tuple = ()
    remappings: tuple = ()
    settings: tuple = ()
    placed: bool = False
    span: Span = SPAN


@dataclass(frozen=True)
class Scale:
    channel: str
    kind: str | None = None
    domain: tuple | None = None
    range: Any = None
    transform: str | None = None
    settings: tuple = ()
    renaming: tuple = ()
    span: Span = SPAN


@dataclass(frozen=True)
class Facet:
    rows: tuple
    columns: tuple = ()
    settings: tuple = ()
    span: Span = SPAN


@dataclass(frozen=True)
class Projection:
    aesthetics: tuple
    system: str
    settings: tuple = ()
    span: Span = SPAN


@dataclass(frozen=True)
class Chart:
    mappings: tuple = ()
    layers: tuple = ()
    scales: tuple = ()
    facet: Facet | None = None
    projection: Projection | None = None
    labels: tuple = ()
    span: Span = SPAN


@dataclass(frozen=True)
class Query:
    body: Any
    blocks: tuple[Block, ...] = ()
    chart: Chart | None = None
    description: str | None = None
    span: Span = SPAN


def children(node: Any):
    """The nodes directly below a node, in order."""
    for name in getattr(node, "__dataclass_fields__", ()):
        value = getattr(node, name)
        for x in value if isinstance(value, tuple) else (value,):
            if hasattr(x, "__dataclass_fields__"):
                yield x


def walk(node: Any, into_selects: bool = True):
    """A node and all below it; sub-selects and EXISTS are yielded but not entered unless into_selects."""
    yield node
    if not into_selects and isinstance(node, (SubSelect, Exists)):
        return
    for x in children(node):
        yield from walk(x, into_selects)


def rebuilt(node: Any, change) -> Any:
    """A copy of a tree in which change(node) replaces every node, from below; None keeps it."""
    from dataclasses import replace

    def part(value):
        if isinstance(value, tuple):
            return tuple(part(x) for x in value)
        return rebuilt(value, change) if hasattr(value, "__dataclass_fields__") else value

    new = {name: part(getattr(node, name)) for name in node.__dataclass_fields__}
    if any(new[k] is not getattr(node, k) and new[k] != getattr(node, k) for k in new):
        node = replace(node, **new)
    out = change(node)
    return node if out is None else out
