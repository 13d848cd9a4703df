"""Chart statistics computed by Spark: only grids and bins ever reach the driver.

Rows with a null in a column that a statistic uses are left out. Ranges come from one aggregate over the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.sources.store import stored

POINTS = 64
GRID_BINS = 20


class StatError(Exception):
    pass


def present(df: DataFrame, *names: str) -> DataFrame:
    out = df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])
    for n in names:
        out = out.where(F.col(f"`{n}`").isNotNull())
    return out


def extent(df: DataFrame, name: str):
    c = F.col(f"`{name}`").cast("double")
    return df.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n"), F.stddev_samp(c).alias("sd")).first()


@dataclass(frozen=True)
class Bins:
    low: float
    width: float
    count: int

    def index(self, c: Column) -> Column:
        """The bin of a value; the largest value belongs to the last bin."""
        return F.least(F.floor((c.cast("double") - F.lit(self.low)) / F.lit(self.width)), F.lit(self.count - 1)).cast("bigint")

    def start(self, i: Column) -> Column:
        return F.lit(self.low) + F.lit(self.width) * i


def histogram(df: DataFrame, x: str, bins: int | None = None, binwidth: float | None = None) -> DataFrame:
    """bin_start, bin_end, bin_count, density of the bins that have values; by default ceil(log2 n) + 1 equal bins."""
    data = present(df, x)
    e = extent(data, x)
    n = e.n or 0
    low, high = (e.low or 0.0, e.high or 0.0) if n else (0.0, 0.0)
    if high <= low:
        b = Bins(low, 1.0, 1)
    elif binwidth and binwidth > 0:
        b = Bins(low, float(binwidth), max(1, math.ceil((high - low) / binwidth)))
    else:
        count = max(1, int(bins) if bins else math.ceil(math.log2(n)) + 1)
        b = Bins(low, (high - low) / count, count)
    counted = data.groupBy(b.index(F.col(f"`{x}`")).alias("i")).agg(F.count(F.lit(1)).alias("bin_count"))
    return counted.select(b.start(F.col("i")).alias("bin_start"), b.start(F.col("i") + 1).alias("bin_end"), "bin_count", (F.col("bin_count") / F.lit(float(max(n, 1)) * b.width)).alias("density")).orderBy("bin_start")


def quantiles(df: DataFrame, y: str, groups: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Exact quantiles of y for each group, as an array q, between neighbours where they fall between two.

    Rows are ranked in range partitions, so that a group of any size is spread over many tasks and none is held in memory.
    """
    names = [f"g{i}" for i in range(len(groups))]
    value = F.col(f"`{y}`").cast("double")
    data = df.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], value.alias("v"))
    parts = stored(data.repartitionByRange(*names, "v").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy(*names, "part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition and group that it holds
    before = F.sum("n").over(W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*names, "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(*names)).alias("all"))
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy(*names, "part").orderBy("v")) - 1)
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in [*names, "part"]]
    ranked = ranked.alias("r").join(sizes.alias("s"), reduce(and_, same)).select(*[F.col(f"r.{n}") for n in names], "v", (F.col("rank") + F.col("before")).alias("rank"), "all")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("all") - 1) * F.lit(q)).alias("at")) for i, q in enumerate(shares)]))
    # the one or two rows at each place
    near = ranked.select("*", wanted.alias("w")).where((F.col("rank") >= F.floor("w.at")) & (F.col("rank") <= F.ceil("w.at")))
    weight = F.when(F.floor("w.at") == F.ceil("w.at"), 1.0).otherwise(1.0 - F.abs(F.col("rank") - F.col("w.at")))
    each = near.groupBy(*names, F.col("w.i").alias("i")).agg(F.sum(F.col("v") * weight).alias("q"))
    out = each.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x.q).alias("q"))  # as many as there are shares
    return out.toDF(*groups, "q")


def boxplot(df: DataFrame, y: str, group: str | None = None) -> DataFrame:
    """Quartiles and fences of 1.5 interquartile ranges, no further than the extremes."""
    data = present(df, *([group] if group else []), y)
    c = F.col(f"`{y}`").cast("double")
    keys = [F.col(f"`{group}`").alias("group")] if group else []
    ends = data.groupBy(*keys).agg(F.min(c).alias("low"), F.max(c).alias("high"))
    found = quantiles(data, y, [group] if group else [], (0.25, 0.5, 0.75))
    if group:
        found = found.toDF("of", "q")
        q = ends.join(found, F.col("group").eqNullSafe(F.col("of")))
    else:
        q = ends.crossJoin(found)  # one row each
    q1, q3 = F.col("q")[0], F.col("q")[2]
    out = q.select(*(["group"] if group else []), q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), F.greatest("low", q1 - 1.5 * (q3 - q1)).alias("lower"), F.least("high", q3 + 1.5 * (q3 - q1)).alias("upper"))
    return out.orderBy("group") if group else out


def heatmap(df: DataFrame, x: str, y: str, bins: int | None = None, ybins: int | None = None) -> DataFrame:
    """Counts over a grid of equal cells."""
    data = present(df, x, y)
    sides = []
    for name, count in ((x, int(bins or GRID_BINS)), (y, int(ybins or bins or GRID_BINS))):
        e = extent(data, name)
        low, high = e.low or 0.0, e.high or 0.0
        sides.append(Bins(low, (high - low) / count, count) if high > low else Bins(low, 1.0, 1))
    a, b = sides
    cells = data.groupBy(a.index(F.col(f"`{x}`")).alias("i"), b.index(F.col(f"`{y}`")).alias("j")).agg(F.count(F.lit(1)).alias("count"))
    i, j = F.col("i"), F.col("j")
    return cells.select(a.start(i).alias("x"), a.start(i + 1).alias("x2"), b.start(j).alias("y"), b.start(j + 1).alias("y2"), "count").orderBy("x", "y")


def smooth(df: DataFrame, x: str, y: str, method: str | None = None) -> DataFrame:
    """The two ends of the least-squares line."""
    if method not in (None, "lm", "linear", "ols"):
        raise StatError(f"smooth has no method {method}; it draws the least-squares line (lm)")
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    fit = present(df, x, y).agg(F.regr_slope(b, a).alias("s"), F.regr_intercept(b, a).alias("i"), F.min(a).alias("low"), F.max(a).alias("high")).where("s is not null")
    ends = fit.select("s", "i", F.explode(F.array("low", "high")).alias("x"))
    return ends.select("x", (F.col("s") * F.col("x") + F.col("i")).alias("y")).orderBy("x")


@dataclass(frozen=True)
class Grid:
    bandwidth: float
    points: list[float]


def grid(df: DataFrame, name: str, points: int | None = None) -> Grid | None:
    """Points from 3 bandwidths below the data to 3 above, by Silverman's rule; None where there is no spread."""
    e = extent(df, name)
    if not e.n or e.n < 2 or not e.sd or e.sd <= 0:
        return None
    h, m = 1.06 * e.sd * e.n**-0.2, max(2, int(points or POINTS))
    low = e.low - 3 * h
    step = (e.high + 3 * h - low) / (m - 1)
    return Grid(h, [low + step * i for i in range(m)])


def kernel_sums(data: DataFrame, value: str, g: Grid, keys: list[Column]) -> DataFrame:
    """One pass: a sum of kernels for each grid point, as an array beside the number of rows."""
    c = F.col(f"`{value}`").cast("double")
    sums = [F.sum(F.exp(-0.5 * F.pow((F.lit(p) - c) / F.lit(g.bandwidth), F.lit(2.0)))).alias(f"s{i}") for i, p in enumerate(g.points)]
    out = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    pairs = F.array(*[F.struct(F.lit(p).alias("v"), F.col(f"s{i}").alias("s")) for i, p in enumerate(g.points)])
    names = [c for c in out.columns if c == "group"]
    return out.where("n > 0").select(*names, "n", F.explode(pairs).alias("p")).select(*names, F.col("p.v").alias("v"), (F.col("p.s") / (F.col("n") * F.lit(g.bandwidth * math.sqrt(2 * math.pi)))).alias("density"))


def density(df: DataFrame, x: str, points: int | None = None) -> DataFrame:
    """A Gaussian kernel density at the grid's points."""
    data = present(df, x)
    g = grid(data, x, points)
    if g is None:
        return df.sparkSession.createDataFrame([], "x double, density double")
    return kernel_sums(data, x, g, []).withColumnRenamed("v", "x").orderBy("x")


def violin(df: DataFrame, y: str, group: str | None = None, points: int | None = None) -> DataFrame:
    """A kernel density for each group, over one grid."""
    if group is None:
        return density(df, y, points).withColumnRenamed("x", "value")
    data = present(df, group, y)
    g = grid(data, y, points)
    if g is None:
        return df.sparkSession.createDataFrame([], "group string, value double, density double")
    return kernel_sums(data, y, g, [F.col(f"`{group}`").alias("group")]).withColumnRenamed("v", "value").orderBy("group", "value")


AGGREGATES = {
    "sum": F.sum, "mean": lambda c: F.avg(c.cast("double")), "avg": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max,
    "count": F.count,
}


def aggregate(df: DataFrame, y: str, how: str, groups: list[str]) -> DataFrame:
    """One value of y for each group of the other mapped columns; groups with a null are left out."""
    if how not in AGGREGATES and how != "median":
        raise StatError(f"unknown aggregate {how}; there are {', '.join([*AGGREGATES, 'median'])}")
    data = present(df, *groups, y)
    keys = [F.col(f"`{g}`") for g in groups]
    if how == "median":
        return quantiles(data, y, groups, (0.5,)).select(*keys, F.col("q")[0].alias(y)).orderBy(*keys)
    return data.groupBy(*keys).agg(AGGREGATES[how](F.col(f"`{y}`")).alias(y)).orderBy(*keys)
