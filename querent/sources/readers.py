"""Where tables come from: files, databases, and schemas declared for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querent.catalog.schema import Catalog

FORMATS = ("parquet", "orc", "csv", "json", "xml")


def files(spark: SparkSession, folder: str, kind: str = "parquet", catalog: Catalog | None = None, **options) -> Callable[[str], DataFrame]:
    """Tables as <folder>/<name>.<kind>. Text formats take the declared schema instead of guessing one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")

    def read(name: str) -> DataFrame:
        reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {"rowTag": "Row"} if kind == "xml" else {}) | options)
        if catalog is not None and kind in ("csv", "json", "xml"):
            reader = reader.schema(", ".join(f"`{c.name}` {stored_type(c)}" for c in catalog.tables[name].columns))
        return reader.load(f"{folder}/{name}.{kind}")

    return read


def stored_type(column) -> str:
    """The Spark type in which a declared column is stored."""
    kind = (column.encoding or "").partition(":")[0]
    if kind in ("TIME_SECONDS_FROM_MIDNIGHT", "TIME_FROM_INTEGER", "DATE_FROM_EPOCH_DAY", "BOOLEAN_FROM_INTEGER", "EPOCH", "SCALED", "INTERVAL"):
        return "bigint"
    if kind in ("TIME_FROM_STRING", "BOOLEAN_FROM_TEXT", "UUID_FROM_STRING", "INTERVAL_FROM_STRING"):
        return "string"
    if kind in ("TIME_FROM_TIMESTAMP", "TIMESTAMP_WALLCLOCK", "DATE_WALLCLOCK"):
        return "timestamp_ntz"
    if kind == "TIME_FROM_DATE":
        return "date"
    if kind == "INSTANT":
        return "timestamp"
    if kind == "UUID_FROM_BINARY":
        return "binary"
    return "string" if column.type.family == "TIME" else column.type.spark()


def jdbc(spark: SparkSession, url: str, **options) -> Callable[[str], DataFrame]:
    """Tables of a database whose driver is on the class path; options such as partitionColumn and numPartitions read it in parallel."""
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def views(spark: SparkSession, names: dict[str, str] | None = None) -> Callable[[str], DataFrame]:
    """Tables of Spark's own catalog, under other names where given."""
    return lambda name: spark.table((names or {}).get(name, name))
