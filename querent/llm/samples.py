"""Bounded samples of labelled rows, chosen by hash of the id so that they are the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, name: str, rows: int, where: Column | None = None) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most `rows` labelled ids; an id that is labelled twice takes the larger label."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        some = some.where(where)
    ids = some.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids of 12 bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
