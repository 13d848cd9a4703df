"""Compilation against a session: encodings, temporal algebra, recursion, plans, charts, findings, sinks and streams."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.catalog.builtin import catalog
from querent.catalog.schema import Attribute, Catalog, Column, Entity, NamedLink, Relation, Table
from querent.catalog.types import Type, check_encoding
from querent.charts import stats
from querent.engine import Engine, driver_engine
from querent.errors import InvalidQuery, QueryError
from querent.functions import temporal as tm
from querent.insight.findings import column_statistics
from querent.insight.quantity import declared, dims
from querent.plans.examples import EXAMPLES
from querent.sources import readers, results

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return driver_engine(spark, SF)


def table_engine(spark, name, columns, rows, schema, zone="UTC"):
    """An engine over one table t."""
    t = Table(name, tuple(columns))
    c = Catalog({name: t}, {}, {name: Entity(name, name, tuple(Attribute(x.name, x.name) for x in columns))}, {})
    return Engine(c, spark, {name: spark.createDataFrame(rows, schema)}, zone)


# storage encodings

ENCODED = [
    ("n", "INTEGER", None, "smallint", 1, 1),
    ("sec", "TIME", "TIME_SECONDS_FROM_MIDNIGHT", "int", 48640, 48640),
    ("hms", "TIME", "TIME_FROM_INTEGER", "int", 123050, 45050),
    ("txt", "TIME", "TIME_FROM_STRING", "string", "12:30:50", 45050),
    ("tts", "TIME", "TIME_FROM_TIMESTAMP", "timestamp_ntz", dt.datetime(1970, 1, 1, 12, 30, 50), 45050),
    ("tdt", "TIME", "TIME_FROM_DATE", "date", dt.date(2024, 4, 12), 0),
    ("day", "DATE", "DATE_FROM_EPOCH_DAY", "int", 19825, dt.date(2024, 4, 12)),
    ("bi", "BOOLEAN", "BOOLEAN_FROM_INTEGER", "int", 1, True),
    ("bt", "BOOLEAN", "BOOLEAN_FROM_TEXT", "string", "Y", True),
    ("ub", "UUID", "UUID_FROM_BINARY", "binary", bytes.fromhex("550e8400e29b41d4a716446655440000"), "550e8400-e29b-41d4-a716-446655440000"),
    ("us", "UUID", "UUID_FROM_STRING", "string", "550E8400-E29B-41D4-A716-446655440000", "550e8400-e29b-41d4-a716-446655440000"),
    ("es", "TIMESTAMP", "EPOCH:SECONDS", "bigint", 1712924080, dt.datetime(2024, 4, 12, 12, 14, 40)),
    ("em", "TIMESTAMP", "EPOCH:MILLIS", "bigint", 1712924080000, dt.datetime(2024, 4, 12, 12, 14, 40)),
    ("ny", "TIMESTAMP", "TIMESTAMP_WALLCLOCK:America/New_York", "timestamp_ntz", dt.datetime(2024, 3, 15, 14, 30, 50), dt.datetime(2024, 3, 15, 18, 30, 50)),
    ("nd", "DATE", "DATE_WALLCLOCK:America/New_York", "date", dt.date(2024, 3, 15), dt.date(2024, 3, 15)),
    ("money", "DECIMAL", "SCALED:2", "bigint", 1299, 12.99),
    ("dur", "INTERVAL", "INTERVAL:SECONDS", "int", 7384, (0, 0, 7384 * 10**9)),
    ("iso", "INTERVAL", "INTERVAL_FROM_STRING", "string", "P1Y2M3DT2H3M4S", (14, 3, 7384 * 10**9)),
    ("clk", "INTERVAL", "INTERVAL_FROM_STRING:CLOCK", "string", "02:03:04", (0, 0, 7384 * 10**9)),
]


def test_encodings(spark):
    columns = [Column(n, Type(f, 38, 2) if f == "DECIMAL" else Type(f), e) for n, f, e, *_ in ENCODED]
    schema = ", ".join(f"{n} {s}" for n, _, _, s, *_ in ENCODED)
    engine = table_engine(spark, "enc", columns, [tuple(x[4] for x in ENCODED), (2, *[None] * (len(ENCODED) - 1))], schema)
    text = "FIND enc t FETCH " + ", ".join(f"t.{x[0]}" for x in ENCODED)
    rows = {r.n: r for r in engine.query(text).collect()}
    for n, _, _, _, _, want in ENCODED:
        got = rows[1][n]
        got = tuple(got) if isinstance(want, tuple) else float(got) if isinstance(want, float) else got
        assert got == want, n
    assert all(v is None for v in rows[2][1:])
    assert engine.query('FIND enc t FILTER t.hms = "12:30:50" AND t.es - t.em = 0s AND t.day < "2024-04-13" FETCH t.n').count() == 1
    with pytest.raises(ValueError, match="does not store"):
        check_encoding("DATE", "TIME_FROM_INTEGER")


def test_literals_meet_stored_values(spark, tmp_path):
    """Encoded columns are compared as they are stored, with the same result as after decoding."""
    rows = [(i, 19800 + i, 1712924080 + i * 40_000, 1712924080000 + i * 40_000_000 + i, 1000 + i * 33) for i in range(40)] + [(99, None, None, None, None)]
    schema = "n int, day int, es bigint, em bigint, money bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "enc.parquet"))
    columns = [Column("n", Type("INTEGER")), Column("day", Type("DATE"), "DATE_FROM_EPOCH_DAY"), Column("es", Type("TIMESTAMP"), "EPOCH:SECONDS"), Column("em", Type("TIMESTAMP"), "EPOCH:MILLIS"), Column("money", Type("DECIMAL", 38, 2), "SCALED:2")]
    t = Table("enc", tuple(columns))
    engine = Engine(Catalog({"enc": t}, {}, {"enc": Entity("enc", "enc", tuple(Attribute(c.name, c.name) for c in columns))}, {}), spark, str(tmp_path))
    every = {r.n: r for r in engine.query("FIND enc t FETCH t.n, t.day, t.es, t.em, t.money").collect()}
    literals = {"day": ('"2024-03-20"', dt.date(2024, 3, 20)), "es": ('"2024-04-15 10:00:00.500"', dt.datetime(2024, 4, 15, 10, 0, 0, 500_000)), "em": ('"2024-04-12 12:14:40"', dt.datetime(2024, 4, 12, 12, 14, 40)), "money": ("13.305", 13.305)}
    test = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for name, (text, value) in literals.items():
        for op, f in test.items():
            want = {n for n, r in every.items() if r[name] is not None and f(float(r[name]) if name == "money" else r[name], value)}
            assert {r.n for r in engine.query(f"FIND enc t FILTER t.{name} {op} {text} FETCH t.n").collect()} == want, (name, op)
    between = engine.query('FIND enc t FILTER t.es BETWEEN "2024-04-13" AND "2024-04-14" FETCH t.n').collect()
    assert {r.n for r in between} == {n for n, r in every.items() if r.es and dt.date(2024, 4, 13) <= r.es.date() <= dt.date(2024, 4, 14)}
    assert "LessThan(es," in engine.explain('FIND enc t FILTER t.es < "2024-04-14" FETCH t.n')


def test_fall_back_hours(spark):
    columns = [Column("n", Type("INTEGER")), Column("z", Type("TIMESTAMP"), "INSTANT")]
    rows = [(1, dt.datetime(2024, 11, 3, 5, 30, tzinfo=dt.timezone.utc)), (2, dt.datetime(2024, 11, 3, 6, 30, tzinfo=dt.timezone.utc))]
    engine = table_engine(spark, "z", columns, rows, "n int, z timestamp", "America/New_York")
    got = engine.query("FIND z t FETCH t.n, t.z").collect()
    assert {r.z for r in got} == {dt.datetime(2024, 11, 3, 1, 30)}


# temporal algebra


def add_months(d, n):
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
    return d.replace(year=y, month=m + 1, day=min(d.day, last))


def months_between(a, b):
    if b < a:
        return -months_between(b, a)
    return (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a, b = (dt.datetime(2019, 1, 1) + dt.timedelta(days=rng.randint(0, 1800), seconds=rng.randint(0, 86399)) for _ in range(2))
        rows.append((i, a, b, a.date(), b.date()))
    rows.append((400, dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29, 1), dt.date(2024, 1, 31), dt.date(2024, 2, 29)))
    columns = [Column("i", Type("INTEGER"), key=1), Column("a", Type("TIMESTAMP")), Column("b", Type("TIMESTAMP")), Column("x", Type("DATE")), Column("y", Type("DATE"))]
    return rows, table_engine(spark, "pairs", columns, rows, "i int, a timestamp_ntz, b timestamp_ntz, x date, y date")


def test_distances(pairs):
    rows, engine = pairs
    text = """FIND pairs p FETCH p.i, days_between(p.x, p.y) d, months_between(p.x, p.y) m, years_between(p.x, p.y) y, p.a - p.b s, p.x - p.y xy,
    calendar_distance(p.a, p.b) c, days_between(p.a, p.b) dd"""
    for r, (i, a, b, x, y) in zip(engine.query(text).orderBy("i").collect(), rows):
        whole = months_between(x, y)
        assert (r.d, r.m, r.y) == ((y - x).days, whole, int(whole / 12)), i
        assert r.s == (a - b).total_seconds() and tuple(r.xy) == (0, (x - y).days, 0)
        assert r.dd == int((b - a).total_seconds() / 86400)
        low, high, sign = (a, b, 1) if a <= b else (b, a, -1)
        clock = (high - high.replace(hour=0, minute=0, second=0)) - (low - low.replace(hour=0, minute=0, second=0))
        end = high.date() - dt.timedelta(days=clock.days < 0)
        clock += dt.timedelta(days=clock.days < 0)
        m = max(0, months_between(low.date(), end))
        days = (end - add_months(low.date(), m)).days
        assert tuple(r.c) == (m * sign, days * sign, int(clock.total_seconds()) * sign * 10**9), i


def test_additions(pairs):
    rows, engine = pairs
    text = """FIND pairs p FETCH p.i, p.x + 1mo1d a, p.x - 1y2mo b, p.a + 1mo2d3h4min c, p.x + 90min d, time(p.a) + 20h e, time(p.a) - time(p.b) f, month_add(p.x, 13) g,
    p.x + time(p.a) h, p.x + (p.y - p.x) k, month_end(p.a) l, p.a - 2 * 1d z, quarter_begin(p.x) q"""
    for r, (i, a, b, x, y) in zip(engine.query(text).orderBy("i").collect(), rows):
        day = dt.timedelta(days=1)
        assert r.a == add_months(x, 1) + day and r.b == add_months(add_months(x, -12), -2)
        assert r.c == add_months(a, 1) + 2 * day + dt.timedelta(hours=3, minutes=4)
        assert r.d == dt.datetime.combine(x, dt.time()) + dt.timedelta(minutes=90)
        sec = lambda t: t.hour * 3600 + t.minute * 60 + t.second
        assert r.e == (sec(a) + 72000) % 86400 and r.f == sec(a) - sec(b)
        assert r.g == add_months(x, 13) and r.h == dt.datetime.combine(x, a.time())
        assert r.k == dt.datetime.combine(y, dt.time()) and r.l == add_months(a.date().replace(day=1), 1) - day
        assert r.z == a - 2 * day and r.q == x.replace(month=(x.month - 1) // 3 * 3 + 1, day=1)


def test_documented_clamping(spark):
    columns = [Column("d", Type("DATE"))]
    engine = table_engine(spark, "one", columns, [(dt.date(2023, 3, 30),)], "d date")
    assert engine.query("FIND one o FETCH o.d + 1mo + 1d r").first().r == dt.date(2023, 5, 1)
    assert tm.totals(((1, "y"), (2, "q"), (3, "w"), (4, "min"))) == (18, 21, 240_000)


def test_masks():
    assert tm.pattern("DD.MM.YYYY HH24:MI:SS") == "dd.MM.yyyy HH:mm:ss"
    assert tm.pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


# structure


def hierarchy(spark):
    columns = (Column("id", Type("INTEGER"), key=1), Column("boss", Type("INTEGER")), Column("name", Type("TEXT")))
    t = Table("staff", columns)
    r = Relation("fk_boss", "staff", "staff", ("boss",), ("id",), False)
    c = Catalog({"staff": t}, {"fk_boss": r}, {"staff": Entity("staff", "staff", tuple(Attribute(x.name, x.name) for x in columns))}, {"reports_to": NamedLink("reports_to", ("fk_boss",)), "leads": NamedLink("leads", ("fk_boss",), "inverse")})
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (5, 4, "e")]
    return Engine(c, spark, {"staff": spark.createDataFrame(rows, "id int, boss int, name string")})


def test_hierarchy(spark):
    engine = hierarchy(spark)
    both = engine.query("FIND staff s, VIA reports_to + staff b FETCH s.name, b.name boss").collect()
    assert sorted(map(tuple, both), key=str) == [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "d")]
    led = engine.query("FIND staff b, VIA leads staff s FETCH b.name, count(s) n").collect()
    assert sorted(map(tuple, led)) == [("a", 2), ("b", 1), ("d", 1)]
    for op in ("UNION", "UNIONALL"):
        text = f"""WITH chain AS (FIND staff s FILTER s.boss ISNULL FETCH s.id id, s.name name, 0 depth {op} FIND chain c, VIA leads staff s FETCH s.id, s.name, c.depth + 1)
        FIND chain c FETCH c.name, c.depth"""
        assert sorted(map(tuple, engine.query(text).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    upwards = """WITH line AS (FIND staff s FILTER s.name = 'e' FETCH s.id id, s.boss boss, s.name names
    UNIONALL FIND line l, l VIA reports_to staff up FETCH up.id, up.boss, concat(l.names, ' under ', up.name))
    FIND line l FILTER l.boss ISNULL FETCH l.names"""
    assert [r.names for r in engine.query(upwards).collect()] == ["e under d under b under a"]
    with pytest.raises(QueryError, match="UNION"):
        engine.query("WITH c AS (FIND staff s FETCH s.id MINUS FIND c x FETCH x.id) FIND c x FETCH x.id")


def test_recursion_is_as_deep_as_the_data(spark):
    """More rounds than any fixed limit, and a start with duplicates."""
    engine = hierarchy(spark)
    deep = engine.query("WITH step AS (FIND staff s FILTER s.id = 1 FETCH s.id k UNIONALL FIND step s FILTER s.k < 107 FETCH s.k + 1) FIND step s FETCH count(s.k) n, max(s.k) m").first()
    assert tuple(deep) == (107, 107)
    text = "WITH step AS (FIND staff s FETCH s.boss k UNION FIND step s FILTER s.k < 6 FETCH s.k + 1) FIND step s FETCH s.k k"
    assert sorted((r.k for r in engine.query(text).collect()), key=str) == [1, 2, 3, 4, 5, 6, None]


def test_raw_sql_leaves_views_alone(spark, engine):
    spark.range(3).createOrReplaceTempView("nation")
    try:
        assert engine.sql("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").first().n == 25
        assert spark.table("nation").count() == 3
        assert not spark.catalog.tableExists("region")
    finally:
        spark.catalog.dropTempView("nation")


def test_exact_quantiles_of_groups(spark):
    rows = [(g, float((i * 7919) % 1000)) for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 40)) for i in range(n)]
    rows += [("e", 5.0)] * 30
    df = spark.createDataFrame(rows, "g string, y double").repartition(7)
    got = {r.g: list(r.q) for r in stats.quantiles(df, "y", ["g"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for g in "abcde":
        want = np.quantile([y for x, y in rows if x == g], [0, 0.25, 0.5, 0.9, 1])
        assert np.allclose(got[g], want), g
    assert [list(r.q) for r in stats.quantiles(df, "y", [], (0.5,)).collect()] == [[float(np.median([y for _, y in rows]))]]


def test_hidden_join_columns(spark):
    c = catalog()
    entities = {"orders": Entity("orders", "orders", (Attribute("price", "o_totalprice"),)), "people": Entity("people", "customer", (Attribute("name", "c_name"),))}
    engine = Engine(Catalog(c.tables, c.relations, entities, {}), spark, SF)
    df = engine.query("WITH big AS (FIND orders o FILTER o.price > 200000 FETCH count(o) k) FIND people p, + big b FETCH p.name, sum(b.k) n, count(p) m")
    want = spark.read.parquet(f"{SF}/orders.parquet").where("o_totalprice > 200000").count()
    assert df.columns == ["name", "n", "m"] and df.agg(F.sum("n")).first()[0] == want


def test_errors_are_raised(engine):
    with pytest.raises(InvalidQuery, match="1:24"):
        engine.query("FIND customers c FETCH c.unknown")
    assert engine.validate("FIND customers c FETCH") != []


def test_functions_can_be_added(spark, engine):
    r = engine.registry.copy().from_sql(spark, "tenfold", {"x": Type("FLOAT")}, Type("FLOAT"), "x * 10")
    mine = Engine(catalog(), spark, SF, registry=r)
    assert mine.query("FIND customers c FETCH tenfold(c.acctbal) - 10 * c.acctbal d").agg(F.max(F.abs("d"))).first()[0] < 1e-6
    assert engine.query("FIND regions r FETCH soundex(r.name) s").count() == 5  # any function that Spark knows
    assert engine.sql("SELECT count(*) AS n FROM nation").first().n == 25


def test_aggregates_and_window_functions_can_be_added(spark, engine):
    import pandas as pd

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    spark.udf.register("spread_of", F.pandas_udf(spread, "double"))
    r = engine.registry.copy().from_spark("spread_of", {"x": Type("FLOAT")}, Type("FLOAT")).from_spark("kurtosis", {"x": Type("FLOAT")}, Type("FLOAT"))
    mine = Engine(catalog(), spark, SF, registry=r)
    customers = spark.read.parquet(f"{SF}/customer.parquet").groupBy("c_mktsegment")
    got = {x.s: x.d for x in mine.query("FIND customers c FETCH c.mktsegment s, spread_of(c.acctbal) d").collect()}
    assert got == {x[0]: x[1] for x in customers.agg(F.max("c_acctbal") - F.min("c_acctbal")).collect()}
    some = mine.query("FIND customers c FILTER kurtosis(c.acctbal) < 0 FETCH c.mktsegment s, kurtosis(c.acctbal) k, count(c) n").collect()
    assert {x.s: x.k for x in some} == {x[0]: x[1] for x in customers.agg(F.kurtosis("c_acctbal")).collect() if x[1] < 0}


def test_window_ties(spark):
    """Rows that a window's ORDER leaves equal come in the order of their keys, however the tables are cut; peers stay peers."""
    import duckdb

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    tied = read("orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 END o_custkey", "o_orderstatus", "CASE WHEN o_custkey % 4 > 0 THEN round(o_totalprice, -5) END o_totalprice", "o_orderdate", "o_orderpriority")
    con = duckdb.connect()
    con.register("orders", tied.toArrow())
    con.register("lineitem", read("lineitem").toArrow())
    flag, price, w = "l_returnflag AS f, l_quantity AS q", "(PARTITION BY o_custkey ORDER BY o_totalprice", "(PARTITION o.custkey ORDER o.totalprice"
    want = {
        EXAMPLES["window_ranks"][0]: EXAMPLES["window_ranks"][1].replace("o_totalprice DESC", "o_totalprice DESC, o_orderkey"),
        f"FIND orders o FETCH o.orderkey k, lag(o.orderkey) OVER {w}) g, first_value(o.orderkey) OVER {w}) f, sum(o.orderkey) OVER {w} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) s": f"SELECT o_orderkey AS k, lag(o_orderkey) OVER {price}, o_orderkey) AS g, first_value(o_orderkey) OVER {price}, o_orderkey) AS f, sum(o_orderkey) OVER {price}, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders",
        f"FIND orders o FETCH o.orderkey k, rank() OVER {w}) r, cume_dist() OVER {w}) c, count(o.orderkey) OVER {w}) n": f"SELECT o_orderkey AS k, rank() OVER {price}) AS r, cume_dist() OVER {price}) AS c, count(o_orderkey) OVER {price}) AS n FROM orders",
        "FIND orders o, lineitems l FETCH l.orderkey k, l.linenumber m, ntile(9) OVER (PARTITION o.custkey ORDER l.returnflag DESC) t": "SELECT l_orderkey AS k, l_linenumber AS m, ntile(9) OVER (PARTITION BY o_custkey ORDER BY l_returnflag DESC, o_orderkey, l_linenumber) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
        "FIND lineitems l FETCH l.returnflag f, l.quantity q, row_number() OVER (PARTITION l.returnflag ORDER count()) n": f"SELECT {flag}, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*), l_quantity) AS n FROM lineitem GROUP BY l_returnflag, l_quantity",
        "WITH b AS (FIND lineitems l FETCH l.returnflag f, l.quantity q) FIND b b FETCH b.f, b.q, row_number() OVER (ORDER b.f) n": f"SELECT {flag}, row_number() OVER (ORDER BY l_returnflag, l_quantity) AS n FROM lineitem",
    }
    for parts, key in ((1, F.desc("o_orderkey")), (5, F.hash("o_orderkey"))):
        lines = read("lineitem").repartition(parts).sortWithinPartitions(F.hash("l_orderkey", "l_linenumber", F.lit(parts)))
        engine = Engine(catalog(), spark, {"orders": tied.repartition(parts).sortWithinPartitions(key), "lineitem": lines})
        for text, sql in want.items():
            got = sorted(map(tuple, engine.query(text).collect()), key=repr)
            assert got == sorted(con.execute(sql).fetchall(), key=repr), (parts, text)
    columns = [Column("a", Type("INTEGER")), Column("b", Type("TEXT"))]  # without a key
    engine = table_engine(spark, "t", columns, [(i % 2, "dacb"[i // 2]) for i in range(8)], "a int, b string")
    got = engine.query("FIND t t FETCH t.a, t.b, row_number() OVER (PARTITION t.a ORDER length(t.b)) n").collect()
    assert sorted(map(tuple, got)) == [(a, b, n) for a in (0, 1) for n, b in enumerate("abcd", 1)]


def test_explicit_form(engine):
    rows = lambda df: sorted(map(tuple, df.collect()))
    text = """SELECT customers c OUT c.name customer 1 GROUP c.name 1
      JOIN same_customer orders o OUT count(o.orderkey) n 2 HAVING count(o.orderkey) > 3 ORDER count(o.orderkey) DESC 1
        FILTER o.order_date BETWEEN "1996-01-01" AND "1996-12-31" OWNER"""
    assert rows(engine.explicit(text)) == rows(engine.query('FIND customers c, orders o FILTER count(o) > 3 AND o.order_date BETWEEN "1996-01-01" AND "1996-12-31" FETCH c.name customer, count(o) n DESC'))
    text = """WITH a AS (SELECT customers c OUT c.custkey k JOIN OPTIONAL same_customer orders o FILTER o.totalprice > 400000 OUT o.totalprice p OWNER
      ALL FILTER NOT EXISTS (c same_customer orders o2 JOIN same_order lineitems l FILTER l.quantity > 49 OWNER) OR c.acctbal > 9000)
      SELECT DISTINCT a x OUT x.k ORDER x.k DESC LIMIT 5"""
    want = "WITH a AS (FIND customers c, + orders o FILTER o.totalprice > 400000 AND (NOT EXISTS (c orders o2, lineitems l FILTER l.quantity > 49) OR c.acctbal > 9000) FETCH c.custkey k, o.totalprice p) FIND a x FETCH DISTINCT x.k DESC LIMIT 5"
    assert [tuple(r) for r in engine.explicit(text).collect()] == [tuple(r) for r in engine.query(want).collect()]
    groups = engine.explicit("SELECT customers c GROUP c.nationkey GROUP c.mktsegment OUT count(c.custkey) n")
    assert groups.columns == ["n"] and groups.count() == engine.query("FIND customers c FETCH DISTINCT c.nationkey, c.mktsegment").count()
    back = "SELECT customers c JOIN same_nation nations n JOIN same_nation suppliers s OUT s.suppkey OWNER OWNER JOIN same_nation REF n OWNER"
    assert engine.explicit(back).count() == engine.query("FIND customers c, nations n, suppliers s, c nations n FETCH s.suppkey").count()


def test_labels_are_metadata(engine):
    df = engine.query('FIND customers c FETCH c.name n "Customer name", count(c) k')
    assert df.schema["n"].metadata == {"label": "Customer name"} and df.schema["k"].metadata == {}


def test_plans(engine):
    text = engine.explain("FIND lineitems l, orders o FILTER l.quantity > 45 AND o.orderstatus = 'F' FETCH o.orderpriority p, sum(l.extendedprice) s")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in text or "GreaterThan(l_quantity,45.0)" in text
    assert "l_returnflag" not in text and "BroadcastHashJoin" in text and "Cartesian" not in text
    assert "LeftAnti" in engine.explain("FIND customers c FILTER NOT EXISTS (c orders o) FETCH c.custkey")


# charts and findings


def chart(engine, text):
    return json.loads(engine.chart(text))


def test_chart_rows(engine):
    spec = chart(engine, "FIND orders o FETCH o.orderstatus s, sum(o.totalprice) t DESC VISUALISE s AS x, t AS y DRAW bar LABEL title => 'T', x => 'Status'")
    assert spec["$schema"].endswith("vega-lite/v6.json") and spec["title"] == "T" and spec["mark"]["type"] == "bar"
    assert spec["encoding"]["x"] == {"field": "s", "type": "nominal", "title": "Status", "sort": {"field": "t", "op": "sum", "order": "descending"}}
    assert spec["encoding"]["y"]["title"] == "Total (€)" and len(spec["data"]["values"]) == 3


@pytest.mark.parametrize(
    "draw,marks",
    [("histogram SETTING bins => 5", ["bar"]), ("boxplot", ["rule", "bar", "tick"]), ("violin", ["line"]), ("smooth", ["line"]), ("density", ["area"]), ("tile SETTING bins => 4", ["rect"]), ("bar SETTING aggregate => median", ["bar"])],
)
def test_chart_statistics(engine, draw, marks):
    x = "o.orderkey" if draw.startswith(("smooth", "tile", "density", "histogram")) else "o.orderstatus"
    spec = chart(engine, f"FIND orders o FETCH {x} a, o.totalprice b VISUALISE a AS x, b AS y DRAW {draw}")
    layers = spec.get("layer", [spec])
    assert [y["mark"]["type"] for y in layers] == marks and all(y["data"]["values"] for y in layers)


def test_chart_structure(engine):
    base = "FIND orders o FETCH o.order_date d, o.totalprice p, o.orderstatus s, o.custkey k VISUALISE d AS x, p AS y"
    assert [x["mark"]["type"] for x in chart(engine, base + " DRAW bar DRAW line")["layer"]] == ["bar", "line"]
    placed = chart(engine, base + " DRAW line PLACE rule SETTING y => 100, color => 'red'")["layer"][1]
    assert placed == {"data": {"values": [{}]}, "mark": {"type": "rule"}, "encoding": {"y": {"datum": 100}, "color": {"value": "red"}}}
    faceted = chart(engine, base + " DRAW point FACET s BY k SETTING free => 'y'")
    assert faceted["facet"]["row"]["field"] == "s" and faceted["resolve"] == {"scale": {"y": "independent"}} and faceted["spec"]["mark"]["type"] == "point"
    polar = chart(engine, "FIND orders o FETCH o.orderstatus s, sum(o.totalprice) t VISUALISE t AS y, s AS color DRAW bar PROJECT TO polar SETTING inner => 0.5")
    assert polar["mark"] == {"type": "arc", "innerRadius": 50} and polar["encoding"]["theta"]["field"] == "t"
    swapped = chart(engine, base + " DRAW point PROJECT y, x TO cartesian")
    assert swapped["encoding"]["x"]["field"] == "p" and swapped["encoding"]["y"]["field"] == "d"
    dodged = chart(engine, base + " DRAW bar MAPPING s AS color SETTING position => 'dodge'")["encoding"]
    assert dodged["y"]["stack"] is None and dodged["xOffset"] == {"field": "s", "type": "nominal"}
    same = chart(engine, base + " DRAW bar MAPPING s AS color SETTING position => 'identity'")["encoding"]
    assert "stack" not in same["y"] and "xOffset" not in same
    ticks = chart(engine, base + " DRAW point SCALE y SETTING breaks => 5")["encoding"]["y"]
    assert ticks["axis"] == {"tickCount": 5}
    scaled = chart(engine, base + " DRAW point SCALE y VIA log SETTING reverse => true, breaks => [1, 10] RENAMING 1 => 'one'")["encoding"]["y"]
    assert scaled["scale"] == {"type": "log", "reverse": True} and scaled["axis"]["values"] == [1, 10] and "'one'" in scaled["axis"]["labelExpr"].replace('"', "'")
    world = chart(engine, "FIND nations n FETCH n.nationkey lng, n.regionkey lt VISUALISE lng AS lon, lt AS lat DRAW point PROJECT TO orthographic SETTING origin => (10, 50)")
    assert world["projection"] == {"type": "orthographic", "rotate": [-10.0, -50.0]} and len(world["layer"]) == 4


@pytest.mark.parametrize(
    "rest,part",
    [("DRAW point SETTING position => 'jitter'", "jitter"), ("DRAW bar SETTING position => 'sideways'", "position"), ("DRAW point PLACE rule SETTING y => (1, 2)", "array"), ("DRAW bar SCALE x RENAMING * => 'all'", "wildcard"), ("DRAW spatial", "geometry"), ("DRAW bar MAPPING zzz AS color", "no output column"), ("DRAW bar PROJECT TO nowhere", "coordinate system"), ("DRAW point PROJECT TO crs SETTING target => 'EPSG:1'", "target")],
)
def test_chart_errors(engine, rest, part):
    result = engine.check_chart(f"FIND orders o FETCH o.orderstatus s, o.totalprice p VISUALISE s AS x, p AS y {rest}")
    assert not result.ok and part in result.error
    assert engine.check_chart("FIND orders o FETCH o.orderstatus s VISUALISE s AS x DRAW bar").ok


def test_findings():
    engine = Engine(catalog())
    text = """FIND lineitems l, orders o, l parts p FETCH month_begin(o.order_date) m, p.brand "Brand", sum(p.retailprice * l.quantity) r, sum(p.retailprice * l.quantity * (1 - l.discount)) n,
    count(l) c, avg(l.extendedprice) a, sum(l.extendedprice) / sum(l.quantity) u, sum(sum(l.extendedprice)) OVER (ORDER p.brand) t"""
    text = text.replace('p.brand "Brand"', 'p.brand brand "Brand"')
    f = {x.header: x for x in engine.findings(text)}
    assert f["m"].grain == "month" and f["m"].role == "TIME" and f["brand"].title == "Brand" and f["brand"].grouped
    assert [f[k].metric for k in "rncaut"] == ["revenue", "net-revenue", "count", "average-value", "price-per-unit", "running-total"]
    assert f["r"].quantity.unit == "EUR" and f["r"].quantity.dims == dims("MONEY") and f["r"].role == "MEASURE"
    growth = engine.findings("WITH m AS (FIND orders o FETCH year(o.order_date) y, sum(o.totalprice) r) FIND m x FETCH x.y, (x.r - lag(x.r) OVER (ORDER x.y)) / lag(x.r) OVER (ORDER x.y) g, x.r - lag(x.r) OVER (ORDER x.y) c, x.r / sum(x.r) OVER () s")
    assert [x.metric for x in growth[1:]] == ["growth", "change", "share"]


def test_quantities():
    price, count, ratio = declared("EUR", "unit-price"), declared("1", "count"), declared("1", "ratio")
    assert price.times(count).kind == "money" and price.times(count).unit == "EUR"
    assert declared("km", "length").times(declared("h", "duration"), -1).kind == "speed"
    assert not declared("EUR", "money").plus(declared("kg", "mass")).known and ratio.dims == dims("")


def test_column_statistics(engine):
    s = column_statistics(engine.query("FIND nations n FETCH n.name, n.regionkey r"))
    assert s["r"] == {"rows": 25, "count": 25, "distinct": 5, "min": 0, "max": 4, "nulls": 0}


# sinks, sources and streams


def test_sinks(engine, tmp_path):
    df = engine.query("FIND regions r FETCH r.regionkey k ASC, r.name name LIMIT 2")
    lines = list(results.csv_lines(df))
    assert lines[0] == '"k", "name"' and lines[1].startswith('"0", "')
    assert sum("<Row>" in x for x in results.xml_lines(df)) == 2
    seen = []
    assert results.each(df, lambda r: seen.append(r) or False) == 1 and len(seen) == 1
    for kind in ("parquet", "csv", "json", "orc"):
        results.write(df, str(tmp_path / f"out.{kind}"), kind)
        assert readers.files(engine.spark, str(tmp_path), kind)("out").count() == 2
    results.write(df, str(tmp_path / "out.xml"), "xml")
    assert readers.files(engine.spark, str(tmp_path), "xml")("out").count() == 2


def test_locale_formats():
    g = results.GERMAN
    assert g.value(1234567.5) == "1.234.567,5" and g.value(dt.date(2024, 1, 31)) == "31.01.2024" and g.value(True) == "wahr" and g.value(None) == ""
    span = {"months": 14, "days": 1, "nanos": 3_661 * 10**9}
    assert results.duration(span) == "1y2mo1d1h1min1s" and results.iso_duration(span) == "P1Y2M1DT1H1M1S"
    assert g.worded(span) == "1 Jahr 2 Monate 1 Tag 1 Stunde 1 Minute 1 Sekunde" and results.duration({"months": 0, "days": 0, "nanos": 0}) == "0s"


def test_declared_schemas(spark, tmp_path):
    columns = (Column("n", Type("INTEGER")), Column("at", Type("TIME"), "TIME_FROM_STRING"), Column("d", Type("DATE")))
    c = Catalog({"t": Table("t", columns)}, {}, {"t": Entity("t", "t", tuple(Attribute(x.name, x.name) for x in columns))}, {})
    (tmp_path / "t.csv").write_text("n,at,d\n1,01:00:00,2024-02-03\n")
    engine = Engine(c, spark, readers.files(spark, str(tmp_path), "csv", c))
    assert tuple(engine.query("FIND t x FETCH x.n, x.at, x.d").first()) == (1, 3600, dt.date(2024, 2, 3))


def test_streams(spark, tmp_path):
    from querent.streaming.tables import start, tables

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    engine = Engine(catalog(), spark, tables(spark, str(tmp_path), {"events": ("ts", "1 hour")}))
    got = {}
    query = start(engine, "FIND events e FILTER e.value > 0 FETCH e.event_type kind, count(e) n", lambda df, i: got.update({r.kind: r.n for r in df.collect()}), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert got == {r.event_type: r["count"] for r in events.where("value > 0").groupBy("event_type").count().collect()}
