"""Streaming tables for the engine: the same queries compile to Structured Streaming plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querent.engine import Engine


def tables(spark: SparkSession, folder: str, streams: dict[str, tuple[str, str] | None], suffix: str = ".parquet") -> Callable[[str], DataFrame]:
    """Tables below a folder; those in `streams` are read as new files arrive, with a watermark (column, delay) or None.

    A stream's schema is that of the files which are there already.
    """

    def read(name: str) -> DataFrame:
        path = f"{folder}/{name}{suffix}"
        static = spark.read.parquet(path)
        if name not in streams:
            return static
        df = spark.readStream.schema(static.schema).parquet(path)
        if not streams[name]:
            return df
        column, delay = streams[name]  # event time is an instant, in the session's zone
        return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)

    return read


def start(engine: Engine, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Runs a query over streaming tables; sink(rows, batch) gets each micro-batch's changes, again after a failure."""
    df = engine.query(text)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
