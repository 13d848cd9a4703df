"""Reading the corpus tables, the folder for intermediate tables, and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that other columns, whatever their names, cannot clash."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def spare_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the actions inside; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local master gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="querent-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/querent-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df once below the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes the folders of stored tables that are not needed any more, and lets Spark drop the shuffle files behind them."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        if path := _folders.pop(df, None):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()
