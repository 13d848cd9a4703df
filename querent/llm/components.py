"""Connected components of a table of links, by alternating stars with every round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import tables


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row.n, row.x


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link in links(a, b), root the least node of its component and itself left out.

    Large star: each node's larger neighbours are linked to its least one; small star: each node's smaller neighbours
    and itself are. Both only need least neighbours, so a node with very many links is pre-aggregated, never gathered.
    Rounds go on until nothing changes, about the square of the logarithm of the largest component.
    """
    spark = links.sparkSession
    links = tables.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = tables.stored(small.unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        before, state = state, _state(after)
        tables.discard(spark, links)
        links = after
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
