"""The semantic model of the sales, event and corpus tables that the driver provides."""

from __future__ import annotations

from querent.catalog.schema import Attribute, Catalog, Column, Entity, NamedLink, Relation, Table
from querent.catalog.types import Type

I, X, F, D, B = Type("INTEGER"), Type("TEXT"), Type("FLOAT"), Type("TIMESTAMP"), Type("BLOB")

#: table: (entity, prefix, columns with type, key place, unit, quantity)
TABLES = {
    "customer": ("customers", "c_", [("c_custkey", I, 1), ("c_name", X), ("c_nationkey", I), ("c_acctbal", F, 0, "EUR", "amount"), ("c_mktsegment", X)]),
    "orders": ("orders", "o_", [("o_orderkey", I, 1), ("o_custkey", I), ("o_orderstatus", X), ("o_totalprice", F, 0, "EUR", "amount"), ("o_orderdate", D), ("o_orderpriority", X)]),
    "lineitem": ("lineitems", "l_", [("l_orderkey", I, 1), ("l_partkey", I), ("l_suppkey", I), ("l_linenumber", I, 2), ("l_quantity", F, 0, "1", "count"), ("l_extendedprice", F, 0, "EUR", "amount"), ("l_discount", F, 0, "1", "ratio"), ("l_tax", F, 0, "1", "ratio"), ("l_returnflag", X), ("l_linestatus", X), ("l_shipdate", D)]),
    "part": ("parts", "p_", [("p_partkey", I, 1), ("p_name", X), ("p_brand", X), ("p_type", X), ("p_size", I), ("p_retailprice", F, 0, "EUR", "unit-price")]),
    "supplier": ("suppliers", "s_", [("s_suppkey", I, 1), ("s_name", X), ("s_nationkey", I), ("s_acctbal", F, 0, "EUR", "amount")]),
    "nation": ("nations", "n_", [("n_nationkey", I, 1), ("n_name", X), ("n_regionkey", I)]),
    "region": ("regions", "r_", [("r_regionkey", I, 1), ("r_name", X)]),
    "events": ("events", "", [("event_id", I, 1), ("ts", D), ("user_id", I), ("event_type", X), ("value", F), ("props", Type("JSON"))]),
    "documents": ("documents", "", [("doc_id", I, 1), ("text", X), ("lang", X), ("source", X), ("n_chars", I)]),
    "labels": ("labels", "", [("doc_id", I, 1), ("quality", I), ("toxic", I)]),
    "pages": ("pages", "", [("page_id", I, 1), ("url", X), ("html", X)]),
    "conversations": ("conversations", "", [("conv_id", I, 1), ("turn", I, 2), ("role", X), ("text", X)]),
    "benchmark": ("benchmark", "", [("item_id", I, 1), ("text", X)]),
    "embeddings": ("embeddings", "", [("vec_id", I, 1), ("label", I)]),
}
RENAMED = {"o_orderdate": "order_date", "l_shipdate": "ship_date"}
RELATIONS = [
    ("fk_orders_customer", "orders", "customer", "o_custkey", "c_custkey"),
    ("fk_lineitem_orders", "lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("fk_lineitem_part", "lineitem", "part", "l_partkey", "p_partkey"),
    ("fk_lineitem_supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("fk_customer_nation", "customer", "nation", "c_nationkey", "n_nationkey"),
    ("fk_supplier_nation", "supplier", "nation", "s_nationkey", "n_nationkey"),
    ("fk_nation_region", "nation", "region", "n_regionkey", "r_regionkey"),
    ("fk_labels_documents", "labels", "documents", "doc_id", "doc_id"),
    ("fk_events_customer", "events", "customer", "user_id", "c_custkey"),
    # the keys of regions are those of the first nations, their hubs
    ("fk_nation_hub", "nation", "nation", "n_regionkey", "n_nationkey"),
]
LINKS = {
    "same_customer": ("fk_orders_customer", "fk_events_customer"),
    "same_order": ("fk_lineitem_orders",),
    "same_part": ("fk_lineitem_part",),
    "same_supplier": ("fk_lineitem_supplier",),
    "same_nation": ("fk_customer_nation", "fk_supplier_nation"),
    "same_region": ("fk_nation_region",),
    "same_document": ("fk_labels_documents",),
    "lives_in": ("fk_customer_nation",),
    "hub": ("fk_nation_hub",),
    "same_turn": ("fk_turn",),
}
INVERSE = {"home_of": ("fk_customer_nation",), "hub_of": ("fk_nation_hub",)}
COMPOSITE = [("fk_turn", "conversations", "conversations", ("conv_id", "turn"), ("conv_id", "turn"))]


def catalog() -> Catalog:
    tables, entities = {}, {}
    for name, (entity, prefix, columns) in TABLES.items():
        full = [(*c, *(0, None, None)[len(c) - 2 :]) if len(c) < 5 else c for c in columns]
        cols = tuple(Column(n, kind, None, key, unit, quantity) for n, kind, key, unit, quantity in full)
        tables[name] = Table(name, cols)
        attributes = tuple(Attribute(RENAMED.get(c.name, c.name.removeprefix(prefix)), c.name) for c in cols)
        entities[entity] = Entity(entity, name, attributes)
    relations = {n: Relation(n, a, b, (x,), (y,)) for n, a, b, x, y in RELATIONS} | {r[0]: Relation(*r) for r in COMPOSITE}
    links = {n: NamedLink(n, r) for n, r in LINKS.items()}
    links |= {n: NamedLink(n, r, "inverse") for n, r in INVERSE.items()}
    return Catalog(tables, relations, entities, links, name="driver")
