"""Reading, writing, resolving and checking queries; no Spark session."""

import pytest

from querent.catalog.builtin import catalog
from querent.catalog.types import Type
from querent.catalog.schema import Attribute, Catalog, Entity, NamedLink, Relation, Table
from querent.engine import Engine
from querent.errors import QueryError
from querent.functions.registry import Function, Param
from querent.lang import tree as t
from querent.lang.explicit import explicit
from querent.lang.format import formatted
from querent.lang.parser import parse
from querent.plans.examples import EXAMPLES

ENGINE = Engine(catalog())

CHARTS = [
    "FIND orders o FETCH o.orderstatus s, sum(o.totalprice) t VISUALISE s AS x, t AS y DRAW bar SETTING position => 'stack' LABEL title => 'A', x => NULL",
    "FIND orders o FETCH o.totalprice p VISUALISE p AS x DRAW histogram SETTING bins => 10 PLACE rule SETTING x => 100, color => 'red'",
    "FIND orders o FETCH o.totalprice p, o.orderstatus s VISUALISE * DRAW point MAPPING p AS y, 'blue' AS color SCALE CONTINUOUS y FROM (0, 10) TO viridis VIA log SETTING reverse => true RENAMING 'a' => 'b', NULL => 'c' FACET s SETTING free => 'y' PROJECT y, x TO cartesian",
]


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples_are_valid_and_round_trip(name):
    text = EXAMPLES[name][0]
    assert ENGINE.validate(text) == []
    query = parse(text)
    for width in (30, 80, 1000):
        assert parse(formatted(query, width)) == query
    assert formatted(parse(formatted(query))) == formatted(query)


@pytest.mark.parametrize("text", CHARTS)
def test_charts_round_trip(text):
    assert parse(formatted(parse(text))) == parse(text)


def test_spans_and_positions():
    with pytest.raises(QueryError) as e:
        parse("FIND customers c\nFETCH c.name,, c.acctbal")
    assert (e.value.line, e.value.column) == (2, 14) and "2:14" in str(e.value)
    q = parse("FIND customers c FETCH c.name")
    assert q.body.items[0].value.span == (23, 29)


@pytest.mark.parametrize(
    "text,part",
    [
        ("FIND customers c FETCH c.name SELECT", "unknown keyword"),
        ("FIND customers c FETCH c.name !", "unexpected character"),
        ('FIND orders o FILTER o.order_date > "2024-01-31 14:30:00Z" FETCH o.orderkey', "no offset"),
        ('FIND orders o FILTER o.order_date > "2024-02-31" FETCH o.orderkey', "is no date"),
        ("FIND orders o FETCH o.order_date + ", "expected an expression"),
    ],
)
def test_reading_errors(text, part):
    with pytest.raises(QueryError, match=part):
        parse(text)


def only(text, **values):
    found = ENGINE.validate(text, values or None)
    assert len(found) == 1, found
    return found[0].message


@pytest.mark.parametrize(
    "text,message",
    [
        ("FIND customers c FETCH position(c.name)", "no overload of 'position' matches 1 argument(s) — candidates: position(substr, str)"),
        ("FIND orders o FETCH o.order_date + 4h2d", "largest-unit-first: '2d4h'"),
        ("FIND orders o FETCH 2d + o.order_date", "INTERVAL add DATE/TIMESTAMP is not valid"),
        ("FIND orders o FETCH 2d - o.order_date", "INTERVAL minus DATE/TIMESTAMP is not valid"),
        ("FIND customers c FETCH coalesce(c.name, 1)", "different family-groups: TEXT and INTEGER"),
        ("FIND customers c FETCH case(c.acctbal > 0, c.name > 'x', c.name)", "only valid as a condition"),
        ("FIND customers c FILTER c.acctbal LIKE 'a%' FETCH c.name", "operator LIKE needs TEXT"),
        ("FIND customers c FILTER c.acctbal = 'a' FETCH c.name", "cannot compare FLOAT with TEXT"),
        ("FIND parts p FETCH p.retailprice + count(p.size)", "invalid aggregation"),
        ("FIND parts p FILTER p.retailprice = count(p.size) FETCH p.name", "invalid aggregation"),
        ("FIND orders o FILTER calendar_distance(o.order_date, o.order_date) = 1y FETCH o.orderkey", "projection-only"),
        ("FIND orders o FETCH time(o.order_date) + 1d", "TIME add a calendar unit is not valid"),
        ("FIND orders o FETCH o.order_date + 1", "TIMESTAMP add INTEGER is not valid"),
        ("FIND orders o FILTER o.order_date - o.order_date > 1mo2d FETCH o.orderkey", "mixed units"),
        ("FIND customers c FETCH c.nothing", "no attribute nothing"),
        ("FIND customers c FETCH x.name", "unknown alias x"),
        ("FIND customers c, + orders o FILTER o.totalprice > c.acctbal FETCH c.name", "cannot be filtered together"),
        ("FIND customers c FETCH upper(c)", "identity is not allowed here"),
        ("FIND customers c FETCH rank()", "rank needs OVER"),
        ("FIND customers c FETCH c.name UNION FIND nations n FETCH n.name, n.nationkey", "same number of columns"),
        ("FIND customers c FETCH (FIND orders o FETCH o.orderkey, o.custkey)", "one column"),
        ("FIND customers c, lineitems l FETCH c.name", "no link between customers and lineitems"),
        ("FIND customers c, nobody n FETCH c.name", "unknown entity or block nobody"),
        ("FIND customers c, c VIA unknown orders o FETCH c.name", "unknown link unknown"),
        ("FIND customers c FILTER c.custkey = #k FETCH c.name", "placeholder #k has no value"),
    ],
)
def test_violations(text, message):
    assert message in only(text)


@pytest.mark.parametrize(
    "text",
    [
        "FIND customers c, c orders o, o customers c FETCH c.name",
        "FIND parts p FETCH count(p.size) + 1",
        "FIND parts p FETCH p.name, count(upper(p.name)), my_native_fn(p.name)",
        "FIND orders o FETCH o.order_date + 2d4h, calendar_distance(o.order_date, o.order_date)",
        "FIND customers c FETCH to_text(c.name), case(c.acctbal > 0 AND NOT c.name ISNULL, c.name, c.mktsegment)",
        "FIND customers c FETCH sum(sum(c.acctbal)) OVER (PARTITION c.mktsegment), c.mktsegment",
        "FIND customers c FILTER c.name LIKE 'a%' AND c.custkey IN (1, 2) FETCH DATE '2020-01-01', c.name",
    ],
)
def test_valid(text):
    assert ENGINE.validate(text) == []


def test_untyped_arguments():
    assert ENGINE.validate("FIND customers c FETCH to_text(NULL)") == []
    r = ENGINE.registry.copy()
    for family in ("INTEGER", "FLOAT"):
        r.register(Function("spell", (Param("value", frozenset({family})),), lambda _: Type("TEXT"), lambda g: g.columns[0]))
    engine = Engine(catalog(), registry=r)
    assert engine.validate("FIND customers c FETCH c.name, spell(NULL)")[0].message.startswith("ambiguous call to 'spell': argument 1 is untyped (NULL)")
    assert engine.validate("FIND customers c FETCH spell(c.acctbal)") == []


def test_unsupported_function():
    r = ENGINE.registry.copy().unsupported("random")
    found = Engine(catalog(), registry=r).validate("FIND customers c FETCH c.name, random()")
    assert [v.message for v in found] == ["function 'random' is not supported by this dialect"]


def test_join_columns_need_not_be_shown():
    c = catalog()
    orders = Entity("orders", "orders", (Attribute("price", "o_totalprice"),))
    people = Entity("people", "customer", (Attribute("name", "c_name"),))
    hidden = Catalog(c.tables, c.relations, {"orders": orders, "people": people}, {})
    engine = Engine(hidden)
    assert engine.validate("WITH big AS (FIND orders o FILTER o.price > 10 FETCH sum(o.price) s) FIND people p, + big b FETCH p.name, count(b) n, count(p) m") == []
    a, _ = engine.analyse("FIND people p, orders o FETCH p.name, count(o) n")
    assert "JOIN orders o ON p.@c_custkey = o.@o_custkey" in explicit(a) and "count(o.@o_orderkey)" in explicit(a)


def test_placeholders():
    assert ENGINE.validate("FIND customers c FILTER c.custkey #ids AND c.name = #n FETCH c.name", {"ids": [1, 2], "n": "x"}) == []
    assert ENGINE.validate("WITH a #q FIND a x FETCH x.k", {"q": "FIND customers c FETCH c.custkey k"}) == []


def test_inference_is_written_out():
    a, _ = ENGINE.analyse("WITH sales AS (FIND orders o, lineitems l FETCH sum(l.extendedprice) revenue) FIND customers c, + sales s FILTER s.revenue > 5 AND count(s) > 1 FETCH c.name DESC, sum(s.revenue) r")
    text = explicit(a)
    assert "OUT o.custkey custkey HIDDEN" in text and "GROUP o.custkey" in text.replace("GROUP sum", "")
    assert "OPTIONAL sales s ON c.custkey = s.custkey AND s.revenue > 5" in text
    assert "HAVING count(s.orderkey) > 1" in text and "GROUP c.name" in text


def test_description():
    assert parse("// one\n// two\nFIND nations n").description == "one\ntwo"
    assert parse("/* three */ FIND nations n /* no */").description == "three"


def test_translation():
    c = catalog()
    entities = {"kunden": Entity("kunden", "customer", (Attribute("nummer", "c_custkey"), Attribute("name", "c_name"))), "bestellungen": Entity("bestellungen", "orders", (Attribute("nummer", "o_orderkey"), Attribute("kunde", "o_custkey"), Attribute("summe", "o_totalprice")))}
    german = Catalog(c.tables, c.relations, entities, {"gleicher_kunde": NamedLink("gleicher_kunde", ("fk_orders_customer", "fk_events_customer"))})
    text = "FIND customers c, VIA same_customer + orders o\nFILTER o.totalprice > 100\nFETCH c.name, count(o) n\n"
    there = Engine(c).translate(text, german)
    assert there == "FIND kunden c, VIA gleicher_kunde + bestellungen o\nFILTER o.summe > 100\nFETCH c.name, count(o) n\n"
    assert Engine(german).translate(there, c) == text
    with pytest.raises(QueryError, match="no attribute"):
        Engine(c).translate("FIND customers c FETCH c.acctbal", german)


def test_links():
    c = catalog()
    assert c.links_between("customers", "nations") == ["same_nation", "lives_in", "home_of"]  # symmetric relations lead both ways
    assert c.link_targets("nations", "home_of") == ["customers"]
    assert "nations" in c.linked_entities("suppliers") and "same_nation" in c.links_from("customers") and "lives_in" in c.links_to("nations")
    tables = {"a": Table("a", ()), "b": Table("b", ())}
    two = {n: Relation(n, "a", "b", (n,), ("k",)) for n in ("x", "y")}
    twice = Catalog(tables, two, {n: Entity(n, n, ()) for n in tables}, {n: NamedLink(n, (n,)) for n in two})
    from querent.catalog.schema import LinkError

    with pytest.raises(LinkError, match="choose one by VIA: x, y"):
        twice.resolve("a", "b", None)
    assert twice.resolve("b", "a", "y")[1:] == (("k",), ("y",))


def test_catalog_json_round_trip():
    c = catalog()
    again = Catalog.from_json(c.to_json())
    assert again.tables["orders"].primary_key[0].name == "o_orderkey"
    assert again.resolve("orders", "customer", None)[1:] == (("o_custkey",), ("c_custkey",))


def test_walk_and_rebuild():
    q = parse("FIND customers c FILTER NOT EXISTS (c orders o FILTER o.totalprice > 5) FETCH c.name")
    assert sum(isinstance(x, t.Exists) for x in t.walk(q)) == 1
    assert t.rebuilt(q, lambda n: None) is q
