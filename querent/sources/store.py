"""Tables written once to a folder that all executors share: cut lineage that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local master gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="querent-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/querent-{uuid.uuid4().hex}"


class Rounds:
    """A table that grows by rounds, each a folder of its own; reads of all rounds are one scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count, self.schema = spark, shared_folder(spark), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the next round and reads it back."""
        self.schema = self.schema or df.schema
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{i}" for i in range(self.count)])


def stored(df: DataFrame) -> DataFrame:
    return Rounds(df.sparkSession).add(df)
