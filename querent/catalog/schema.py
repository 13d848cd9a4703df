"""Physical tables and relations, and the semantic model of entities, attributes and links above them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from querent.catalog.types import Type, check_encoding, declared, of_spark


@dataclass(frozen=True)
class Column:
    name: str
    type: Type
    encoding: str | None = None
    key: int = 0  # place in the primary key from 1, 0 outside
    unit: str | None = None
    quantity: str | None = None
    nullable: bool = True
    label: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    label: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary_key(self) -> list[Column]:
        return sorted((c for c in self.columns if c.key), key=lambda c: c.key)


@dataclass(frozen=True)
class Relation:
    name: str
    start: str
    end: str
    start_columns: tuple[str, ...]
    end_columns: tuple[str, ...]
    symmetric: bool = True


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    label: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    attributes: tuple[Attribute, ...]
    label: str | None = None

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def attribute_of(self, column: str) -> Attribute | None:
        return next((a for a in self.attributes if a.column == column), None)


@dataclass(frozen=True)
class NamedLink:
    name: str
    relations: tuple[str, ...]
    nature: str = ""
    canonical: str | None = None

    @property
    def inverse(self) -> bool:
        return "inverse" in self.nature


class LinkError(Exception):
    pass


@dataclass
class Catalog:
    tables: dict[str, Table]
    relations: dict[str, Relation]
    entities: dict[str, Entity]
    links: dict[str, NamedLink]
    strict: bool = False
    name: str = ""

    def __post_init__(self):
        for t in self.tables.values():
            for c in t.columns:
                check_encoding(c.type.family or "", c.encoding)

    def entity(self, name: str) -> Entity | None:
        return self.entities.get(name)

    def table_of(self, entity: str) -> Table:
        return self.tables[self.entities[entity].table]

    def column_of(self, entity: str, attribute: str) -> Column | None:
        e = self.entities.get(entity)
        a = e and e.attribute(attribute)
        return self.tables[e.table].column(a.column) if a else None

    # links

    def _directed(self, start: str, end: str, among: Iterable[Relation]) -> list[tuple[Relation, tuple, tuple]]:
        """Relations from one table to another as written, else, where they are symmetric, the other way round."""
        found = [(r, r.start_columns, r.end_columns) for r in among if (r.start, r.end) == (start, end)]
        if not found:
            found = [(r, r.end_columns, r.start_columns) for r in among if r.symmetric and (r.end, r.start) == (start, end)]
        return found

    def resolve(self, start: str, end: str, via: str | None) -> tuple[Relation, tuple[str, ...], tuple[str, ...]]:
        """The relation between two entities and the columns that are equal, first those of the start."""
        a, b = self.entities[start].table, self.entities[end].table
        if via is not None:
            link = self.links.get(via)
            if link is None:
                raise LinkError(f"unknown link {via}")
            among = [self.relations[r] for r in link.relations if r in self.relations]
            if link.inverse:
                found = [(r, y, x) for r, x, y in self._directed(b, a, among)]
            else:
                found = self._directed(a, b, among)
            if not found:
                raise LinkError(f"link {via} does not lead from {start} to {end}")
            return found[0]
        among = [r for r in self.relations.values() if r.start != r.end or r.start_columns != r.end_columns]
        found = self._directed(a, b, among)
        if not found and a == b:
            found = self._directed(a, b, self.relations.values())
        if not found:
            raise LinkError(f"no link between {start} and {end}")
        if len({(x, y) for _, x, y in found}) > 1:
            names = ", ".join(sorted({k for k, link in self.links.items() for r, _, _ in found if r.name in link.relations}) or [r.name for r, _, _ in found])
            raise LinkError(f"several links between {start} and {end}, choose one by VIA: {names}")
        return found[0]

    # what there is to link

    def links_between(self, start: str, end: str) -> list[str]:
        out = []
        for name in self.links:
            try:
                self.resolve(start, end, name)
                out.append(name)
            except LinkError:
                pass
        return out

    def links_from(self, entity: str) -> list[str]:
        return sorted({n for e in self.entities for n in self.links_between(entity, e)})

    def links_to(self, entity: str) -> list[str]:
        return sorted({n for e in self.entities for n in self.links_between(e, entity)})

    def link_targets(self, entity: str, link: str) -> list[str]:
        return sorted(e for e in self.entities if link in self.links_between(entity, e))

    def linked_entities(self, entity: str) -> list[str]:
        out = []
        for e in self.entities:
            try:
                self.resolve(entity, e, None)
                out.append(e)
            except LinkError as x:
                if "several" in str(x):
                    out.append(e)
        return sorted(out)

    # reading and deriving

    @classmethod
    def from_json(cls, schema: str | Path | dict, model: str | Path | dict | None = None, units: dict | None = None, strict: bool = False) -> Catalog:
        """From a schema file, and a model file (without one every table is an entity)."""
        load = lambda x: x if isinstance(x, dict) else json.loads(Path(x).read_text(encoding="utf-8"))
        s = load(schema)
        tables = {}
        for t in s.get("tables", ()):
            columns = [Column(c["name"], declared(c["typeFamily"], c.get("dialectType")), c.get("typeEncoding") or None, int(c.get("pkPos") or 0), c.get("unit"), c.get("quantity"), c.get("nullable", True), c.get("label")) for c in t["columns"]]
            tables[t["name"]] = Table(t["name"], tuple(columns), t.get("label"))
        relations = {r["name"]: Relation(r["name"], r["startTable"], r["endTable"], tuple(r["startColumns"]), tuple(r["endColumns"]), r.get("symmetric", True)) for r in s.get("relations", ())}
        if model is None:
            return cls(tables, relations, *default_model(tables, relations), strict=strict, name=s.get("name") or "")
        m = load(model)
        entities = {}
        for e in m.get("entities", ()):
            attributes = tuple(Attribute(a["name"], a.get("column") or a["name"], a.get("label")) for a in e.get("attributes", ()))
            entities[e["name"]] = Entity(e["name"], e.get("table") or e["name"], attributes, e.get("label"))
        links = {x["name"]: NamedLink(x["name"], tuple(x.get("relations", ())), x.get("nature") or "", x.get("canonical")) for x in m.get("links", ())}
        return cls(tables, relations, entities, links, strict, m.get("name") or "")

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None, relations: Iterable[Relation] = ()) -> Catalog:
        """A catalog of the columns that DataFrames have; keys and relations are declared."""
        tables = {}
        for name, df in frames.items():
            key = (keys or {}).get(name, ())
            tables[name] = Table(name, tuple(Column(f.name, of_spark(f.dataType), None, key.index(f.name) + 1 if f.name in key else 0, nullable=f.nullable) for f in df.schema.fields))
        named = {r.name: r for r in relations}
        return cls(tables, named, *default_model(tables, named))

    def to_json(self) -> dict:
        """The schema in the form that from_json() reads."""
        column = lambda c: {"name": c.name, "label": c.label, "typeFamily": c.type.family, "typeEncoding": c.encoding, "dialectType": c.type.spark().upper(), "nullable": c.nullable, "pkPos": c.key, "unit": c.unit, "quantity": c.quantity}
        relation = lambda r: {"name": r.name, "startTable": r.start, "endTable": r.end, "symmetric": r.symmetric, "startColumns": list(r.start_columns), "endColumns": list(r.end_columns)}
        return {"name": self.name, "tables": [{"name": t.name, "label": t.label, "columns": [column(c) for c in t.columns]} for t in self.tables.values()], "relations": [relation(r) for r in self.relations.values()]}


def default_model(tables: dict[str, Table], relations: dict[str, Relation]) -> tuple[dict[str, Entity], dict[str, NamedLink]]:
    """One entity for each table and one link for each relation."""
    entities = {t.name: Entity(t.name, t.name, tuple(Attribute(c.name, c.name, c.label) for c in t.columns), t.label) for t in tables.values()}
    return entities, {r: NamedLink(r, (r,)) for r in relations}


@dataclass
class Backend:
    """Where a catalog's tables are read."""

    table: Callable[[str], DataFrame]
    zone: str = "UTC"
    cache: dict[str, DataFrame] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = self.table(name)
        return self.cache[name]
