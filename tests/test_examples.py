"""Every example query against the same in SQL on DuckDB: rows, names and values."""

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from querent.operators.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations benchmark embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or isinstance(x, (str, bool, bytes)):
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    return float(f"{float(x):.9g}") if isinstance(x, int) else str(x)


def same(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = [df.columns.index(c) for c in columns]
    got = Counter(tuple(value(r[i]) for i in order) for r in df.collect())
    want = Counter(tuple(map(value, r)) for r in found.fetchall())
    assert got == want, ((got - want).most_common(3), (want - got).most_common(3))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_example(spark, duck, name):
    same(spark, duck, name)


@pytest.mark.parametrize("name", ["filter_comparisons", "filter_like", "set_in_parentheses", "recursive_through_link", "recursive_union_distinct", "composite_key_link"])
def test_examples_select_something(duck, name):
    assert duck.execute(ORACLES[name]).fetchone() is not None
