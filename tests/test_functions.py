"""Functions without an equal in the other engine, and every function once."""

import datetime as dt

import pytest

from querent.engine import driver_engine
from querent.functions.registry import CallError, Function, Param, Registry
from querent.functions.standard import standard
from querent.catalog.types import Type

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return driver_engine(spark, SF)


VALUES = [
    ("initcap('river bank')", "River Bank"),
    ("overlay('abcdef', 'XY', 3)", "abXYef"),
    ("overlay('abcdef', 'XY', 3, 1)", "abXYdef"),
    ("printf('%s-%d', 'a', 5)", "a-5"),
    ("split('a.b.c', '.')", ["a", "b", "c"]),
    ("list(1, 2, 3)", [1, 2, 3]),
    ("instr('hello', 'l')", 3),
    ("concat('a', NULL, 1)", "a1"),
    ("concat_ws('-', 'a', 2)", "a-2"),
    ("lpad('7', 3, '0')", "007"),
    ("regexp_count('aXbXc', 'X', 3)", 1),
    ("regexp_replace('aAa', 'a', 'b', 'i')", "bbb"),
    ("bit_count(7)", 3),
    ("truncate(-2.7)", -2),
    ("round(2.5)", 3),
    ("power(2, 10)", 1024.0),
    ("to_integer(2.7)", 2),
    ("to_smallint('12')", 12),
    ("to_bigint('12')", 12),
    ("to_boolean('false')", False),
    ("to_varchar(12, 5)", "12"),
    ("to_text(12.50)", "12.50"),
    ('to_text("2024-01-31")', "2024-01-31"),
    ('to_text("13:05:09")', "13:05:09"),
    ("to_text(1y2mo3d)", "1y2mo3d"),
    ('to_char("2024-01-31", \'DD.MM.YYYY\')', "31.01.2024"),
    ("to_char(1234.5, '9,999.00')", "1,234.50"),
    ("to_number('1,234.50', '9,999.00')", 1234.5),
    ("make_time(1, 2, 3)", 3723),
    ("to_time('01:02:03')", 3723),
    ("to_time(1, 2, 3)", 3723),
    ("to_time('02-01', 'MI-HH24')", 3720),
    ("parse_time('01:02', 'HH24:MI')", 3720),
    ("to_date('31.01.2024', 'DD.MM.YYYY')", dt.date(2024, 1, 31)),
    ("to_date(2024, 1, 31)", dt.date(2024, 1, 31)),
    ('to_date("2024-01-31 23:30:00", \'Asia/Tokyo\')', dt.date(2024, 2, 1)),
    ("to_timestamp('2024-01-31 10:00:00')", dt.datetime(2024, 1, 31, 10)),
    ("to_timestamp('31.01.2024 10', 'DD.MM.YYYY HH24', 'Asia/Tokyo')", dt.datetime(2024, 1, 31, 1)),
    ("to_timestamp(2024, 1, 31, 10, 5, 7)", dt.datetime(2024, 1, 31, 10, 5, 7)),
    ("to_timestamp(2024, 1, 31, 10, 5, 7, 'Asia/Tokyo')", dt.datetime(2024, 1, 31, 1, 5, 7)),
    ("timestamp('2024-01-31 10:00:00')", dt.datetime(2024, 1, 31, 10)),
    ("time('10:00:00')", 36000),
    ("to_interval(3, 'MONTH')", (3, 0, 0)),
    ("to_interval(1, 2, 3, 4, 5, 6)", (14, 3, 14706 * 10**9)),
    ('"2024-01-31" + to_interval(1, \'MONTH\')', dt.datetime(2024, 2, 29)),
    ("1d2h + 3d", (0, 4, 7200 * 10**9)),
    ("-(1mo)", (-1, 0, 0)),
    ('at_zone("2024-07-01 12:00:00", \'Europe/Berlin\')', dt.datetime(2024, 7, 1, 14)),
    ('to_utc("2024-07-01 12:00:00", \'Europe/Berlin\')', dt.datetime(2024, 7, 1, 10)),
    ('date_trunc(\'month\', "2024-07-15")', dt.date(2024, 7, 1)),
    ('calendar_distance("2020-01-01 06:00:00", "2021-05-15 18:00:00")', (16, 14, 43200 * 10**9)),
    ("coalesce(NULL, \"2024-01-01\", \"2024-01-02 03:00:00\")", dt.datetime(2024, 1, 1)),
    ("case(1 = 2, 1, 2.5)", 2.5),
    ("mod(-7, 3)", -1),
    ("7 / 2", 3.5),
    ("greatest(1, 5, 3)", 5),
    ("log2(8)", 3.0),
    ("width_bucket(5, 0, 10, 5)", 3),
    ("div(7, 2)", 3),
    ("chr(65)", "A"),
    ("sign(-4)", -1.0),
]


def test_values(engine):
    items = ", ".join(f"{e} v{i}" for i, (e, _) in enumerate(VALUES))
    row = engine.query(f"FIND regions r FILTER r.regionkey = 0 FETCH {items}").first()
    for i, (expression, want) in enumerate(VALUES):
        got = row[f"v{i}"]
        if isinstance(want, tuple):
            got = tuple(got)
        elif isinstance(want, float):
            got = float(got)
        assert got == want, expression


def test_now_and_random(engine):
    r = engine.query("FIND regions r FILTER r.regionkey = 0 FETCH now() n, clock_now() c, today() d, random() a, rand() b, pi() p").first()
    assert abs((r.n - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 120 and r.c == r.n and r.d == r.n.date()
    assert 0 <= r.a < 1 and 0 <= r.b < 1 and abs(r.p - 3.14159265) < 1e-8


def test_interval_sums(engine):
    r = engine.query("FIND lineitems l, orders o FETCH sum(l.ship_date - o.order_date) s, sum(date(l.ship_date) - date(o.order_date)) d, avg(l.ship_date - o.order_date) a, max(l.ship_date - o.order_date) m").first()
    assert r.s == r.d["days"] * 86400 and r.m % 86400 == 0 and 0 < r.a <= r.m


def test_registry():
    r = standard()
    assert r.kind("sum") == "aggregate" and r.kind("lag") == "window" and r.kind("nobody") == "scalar"
    assert r.find("nobody", []) is None
    with pytest.raises(CallError, match="takes"):
        r.find("sqrt", [Type("TEXT")])
    mine = Registry().register(Function("f", (Param("a", frozenset({"INTEGER"})),), lambda _: Type("INTEGER"), lambda g: g.columns[0]))
    mine.override("f", lambda g: g.columns[0] * 2)
    assert mine.copy().unsupported("f").refused == {"f"} and mine.refused == set()
    assert str(r.functions["position"][0]) == "position(substr, str)"
