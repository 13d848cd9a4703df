"""Registered queries of the engine: the example queries and the statistics, with the same in SQL."""

from __future__ import annotations

from querent.charts import stats
from querent.engine import driver_engine
from querent.plans.examples import EXAMPLES, runner

_ORDERS = "FIND orders o FETCH o.totalprice price, o.orderpriority priority, o.orderkey k"
_LINES = "FIND lineitems l FETCH l.quantity q, l.extendedprice price, l.returnflag flag"


def _on(text: str, make):
    return lambda spark, sf_dir: make(driver_engine(spark, sf_dir).query(text))


def _rounded(df, digits: int = 6):
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in df.columns])


QUERIES = {name: runner(name) for name in EXAMPLES} | {
    "chart_histogram": _on(_ORDERS, lambda df: _rounded(stats.histogram(df, "price", bins=12), 9)),
    "chart_histogram_sturges": _on(_LINES, lambda df: _rounded(stats.histogram(df, "q"), 9)),
    "chart_boxplot": _on(_ORDERS, lambda df: _rounded(stats.boxplot(df, "price", "priority"), 4)),
    "chart_heatmap": _on(_LINES, lambda df: _rounded(stats.heatmap(df, "q", "price", bins=8), 4)),
    "chart_smooth": _on(_LINES, lambda df: _rounded(stats.smooth(df, "q", "price"), 3)),
    "chart_density": _on(_ORDERS, lambda df: _rounded(stats.density(df, "price", points=16), 10).selectExpr("round(x, 3) x", "density")),
    "chart_violin": _on(_ORDERS, lambda df: _rounded(stats.violin(df, "price", "priority", points=8), 10).selectExpr("group", "round(value, 3) value", "density")),
    "chart_aggregate": _on(_ORDERS, lambda df: _rounded(stats.aggregate(df, "price", "median", ["priority"]), 4)),
}


def _bins(table: str, column: str, bins: str) -> str:
    return f"""WITH e AS (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS n FROM {table}), b AS (SELECT lo, n, {bins} AS k, (hi - lo) / ({bins}) AS w FROM e),
c AS (SELECT least(floor(({column} - lo) / w), k - 1) AS i, lo, w, n, count(*) AS bin_count FROM {table}, b GROUP BY ALL)
SELECT round(lo + w * i, 9) AS bin_start, round(lo + w * (i + 1), 9) AS bin_end, bin_count, round(bin_count / (n * w), 9) AS density FROM c"""


def _kernels(points: int, group: bool) -> str:
    key = "o_orderpriority" if group else "1"
    return f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, 1.06 * stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders),
g AS (SELECT lo - 3 * h + (hi - lo + 6 * h) / {points - 1} * i AS v, h FROM e, range({points}) t(i))
SELECT {'o_orderpriority AS "group", round(v, 3) AS value' if group else 'round(v, 3) AS x'}, round(sum(exp(-0.5 * pow((v - o_totalprice) / h, 2))) / (count(*) * min(h) * sqrt(2 * pi())), 10) AS density FROM g, orders GROUP BY v, {key}"""


ORACLES = {name: sql for name, (_, sql) in EXAMPLES.items()} | {
    "chart_histogram": _bins("orders", "o_totalprice", "12"),
    "chart_histogram_sturges": _bins("lineitem", "l_quantity", "ceil(log2(n)) + 1"),
    "chart_boxplot": """WITH q AS (SELECT o_orderpriority AS "group", quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
SELECT "group", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS lower, round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS upper FROM q""",
    "chart_heatmap": """WITH e AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 8 AS w, min(l_extendedprice) AS b, (max(l_extendedprice) - min(l_extendedprice)) / 8 AS h FROM lineitem),
c AS (SELECT a, w, b, h, least(floor((l_quantity - a) / w), 7) AS i, least(floor((l_extendedprice - b) / h), 7) AS j, count(*) AS "count" FROM lineitem, e GROUP BY ALL)
SELECT round(a + w * i, 4) AS x, round(a + w * (i + 1), 4) AS x2, round(b + h * j, 4) AS y, round(b + h * (j + 1), 4) AS y2, "count" FROM c""",
    "chart_smooth": """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT round(lo, 3) AS x, round(s * lo + i, 3) AS y FROM f UNION ALL SELECT round(hi, 3), round(s * hi + i, 3) FROM f""",
    "chart_density": _kernels(16, False),
    "chart_violin": _kernels(8, True),
    "chart_aggregate": "SELECT o_orderpriority AS priority, round(median(o_totalprice), 4) AS price FROM orders GROUP BY 1",
}
