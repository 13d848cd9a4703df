"""Logical types: families, their Spark representation and the storage encodings that a scan decodes.

TIME is a count of seconds of the day (bigint), INTERVAL (a duration) a struct of months, days and nanos that are
never normalised, TIMESTAMP a wall clock without a zone (in the model's zone).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ("BLOB", "BOOLEAN", "DATE", "DECIMAL", "FLOAT", "INTEGER", "TIME", "INTERVAL", "TIMESTAMP", "TEXT", "JSON", "UUID")
NUMERIC = frozenset({"INTEGER", "DECIMAL", "FLOAT"})
TEMPORAL = frozenset({"DATE", "TIME", "TIMESTAMP"})
ADDITIVE = NUMERIC | {"INTERVAL"}
ANY = frozenset(FAMILIES)
INTERVAL_STRUCT = "struct<months:int,days:int,nanos:bigint>"
WIDTH = {"INTEGER": 0, "DECIMAL": 1, "FLOAT": 2}

#: Spark types of families without parameters
SPARK_TYPES = {"INTEGER": "bigint", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date", "TIME": "bigint", "TIMESTAMP": "timestamp_ntz", "INTERVAL": INTERVAL_STRUCT, "TEXT": "string", "JSON": "string", "UUID": "string", "BLOB": "binary"}


@dataclass(frozen=True)
class Type:
    """family None is the type of NULL or one that isn't known."""

    family: str | None = None
    precision: int | None = None
    scale: int | None = None
    seconds: bool = False  # an INTERVAL kept as a count of elapsed seconds

    def spark(self) -> str:
        if self.family == "DECIMAL":
            return f"decimal({self.precision or 38},{self.scale or 0})"
        return "bigint" if self.seconds else SPARK_TYPES.get(self.family or "", "void")

    def __str__(self) -> str:
        return self.family or "NULL"


UNKNOWN = Type()


def wider(a: Type, b: Type) -> Type | None:
    """The type that holds both, None if there is none."""
    if a.family is None or a == b:
        return b
    if b.family is None:
        return a
    if a.family in NUMERIC and b.family in NUMERIC:
        if "FLOAT" in (a.family, b.family):
            return Type("FLOAT")
        pair = [x if x.family == "DECIMAL" else Type("DECIMAL", 19, 0) for x in (a, b)]
        if a.family == b.family == "INTEGER":
            return a
        scale = max(x.scale or 0 for x in pair)
        whole = max((x.precision or 38) - (x.scale or 0) for x in pair)
        return Type("DECIMAL", min(38, whole + scale), scale)
    if {a.family, b.family} == {"DATE", "TIMESTAMP"}:
        return Type("TIMESTAMP")
    return a if a.family == b.family else None


def of_spark(kind: T.DataType) -> Type:
    """The logical type of a Spark column."""
    if isinstance(kind, T.DecimalType):
        return Type("DECIMAL", kind.precision, kind.scale)
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["months", "days", "nanos"]:
        return Type("INTERVAL")
    table = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "FLOAT", "double": "FLOAT", "boolean": "BOOLEAN", "string": "TEXT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "binary": "BLOB"}
    name = kind.simpleString()
    if name.startswith("interval"):
        return Type("INTERVAL")
    return Type(table.get(name.split("(")[0]))


_NUMBER = re.compile(r"(?:DECIMAL|NUMERIC|NUMBER)(?:\((\d+)(?:,\s*(-?\d+))?\))?$", re.I)


def declared(family: str, physical: str | None) -> Type:
    """A declared family with precision and scale from the physical type's name."""
    if family not in FAMILIES:
        raise ValueError(f"unknown type family {family}")
    m = _NUMBER.match((physical or "").strip())
    if family == "DECIMAL":
        if m:
            return Type(family, int(m[1] or 38), int(m[2] or 0))
        return Type("FLOAT") if (physical or "").upper() in ("DOUBLE", "FLOAT", "REAL") else Type(family, 38, 10)
    return Type(family)


# encodings

ENCODINGS = {
    "TIME_SECONDS_FROM_MIDNIGHT": "TIME", "TIME_FROM_INTEGER": "TIME", "TIME_FROM_STRING": "TIME", "TIME_FROM_TIMESTAMP": "TIME", "TIME_FROM_DATE": "TIME",
    "DATE_FROM_EPOCH_DAY": "DATE", "DATE_WALLCLOCK": "DATE", "BOOLEAN_FROM_INTEGER": "BOOLEAN", "BOOLEAN_FROM_TEXT": "BOOLEAN", "UUID_FROM_BINARY": "UUID", "UUID_FROM_STRING": "UUID",
    "INSTANT": "TIMESTAMP", "EPOCH": "TIMESTAMP", "TIMESTAMP_WALLCLOCK": "TIMESTAMP", "SCALED": "DECIMAL", "INTERVAL": "INTERVAL", "INTERVAL_FROM_STRING": "INTERVAL",
    "INTERVAL_INTERVAL": "INTERVAL", "INTERVAL_YEAR_MONTH": "INTERVAL", "INTERVAL_DAY_SECOND": "INTERVAL", "CALENDAR_DISTANCE": "INTERVAL", "TEXT_FROM_BOOLEAN": "TEXT",
}
EPOCH_UNITS = {"SECONDS": 1_000_000, "MILLIS": 1_000, "MICROS": 1}
UNIT_NANOS = {"HOURS": 3_600_000_000_000, "MINUTES": 60_000_000_000, "SECONDS": 1_000_000_000, "MILLIS": 1_000_000, "MICROS": 1_000, "NANOS": 1}


def check_encoding(family: str, encoding: str | None) -> None:
    if encoding and ENCODINGS.get(encoding.split(":")[0]) != family:
        raise ValueError(f"encoding {encoding} does not store {family}")


def interval(months=0, days=0, nanos=0) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(months).cast("int").alias("months"), col(days).cast("int").alias("days"), col(nanos).cast("bigint").alias("nanos"))


def wall_clock(c: Column, start: str, zone: str) -> Column:
    """A wall clock of one zone as the wall clock of another."""
    return F.convert_timezone(F.lit(start), F.lit(zone), c.cast("timestamp_ntz"))


def time_of(c: Column) -> Column:
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("bigint")


def decode(c: Column, family: str, encoding: str | None, stored: T.DataType, zone: str) -> Column:
    """The logical value of a stored column; conversions happen once, in the scan's projection."""
    kind, _, detail = (encoding or "").partition(":")
    name = stored.simpleString()
    if kind in ("", "CALENDAR_DISTANCE", "TEXT_FROM_BOOLEAN", "INTERVAL_INTERVAL", "INTERVAL_YEAR_MONTH", "INTERVAL_DAY_SECOND"):
        if family == "TIME" and name.startswith("time("):
            return F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
        if family == "TIME" and name == "string":
            kind = "TIME_FROM_STRING"
        elif family == "TIMESTAMP":
            return c.cast("timestamp_ntz") if name != "timestamp_ntz" else c
        elif family == "INTERVAL" and name.startswith("interval year"):
            return F.when(c.isNotNull(), interval(F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)))
        elif family == "INTERVAL" and name.startswith("interval"):
            nanos = (F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)) * 1_000_000_000
            return F.when(c.isNotNull(), interval(0, F.extract(F.lit("DAY"), c), nanos))
        elif kind == "TEXT_FROM_BOOLEAN":
            return c.cast("string")
        else:
            return c
    if kind == "TIME_SECONDS_FROM_MIDNIGHT":
        return F.pmod(c.cast("bigint"), F.lit(86400))
    if kind == "TIME_FROM_INTEGER":
        n = c.cast("bigint")
        return F.floor(n / 10000) * 3600 + F.floor(n / 100) % 100 * 60 + n % 100
    if kind == "TIME_FROM_STRING":
        part = lambda i: F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(i)).cast("double"), F.when(c.isNotNull(), 0.0))
        return F.floor(part(1) * 3600 + part(2) * 60 + part(3)).cast("bigint")
    if kind in ("TIME_FROM_TIMESTAMP", "TIME_FROM_DATE"):
        return time_of(c.cast("timestamp_ntz"))
    if kind == "DATE_FROM_EPOCH_DAY":
        return F.date_from_unix_date(c.cast("int"))
    if kind == "BOOLEAN_FROM_INTEGER":
        return c != 0
    if kind == "BOOLEAN_FROM_TEXT":
        return F.lower(c).isin("y", "yes", "t", "true", "1", "j", "ja")
    if kind == "UUID_FROM_BINARY":
        return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    if kind == "UUID_FROM_STRING":
        return F.lower(c)
    if kind == "INSTANT":
        return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz")) if name == "timestamp" else wall_clock(c, "UTC", zone)
    if kind == "EPOCH":
        micros = F.floor(c / 1000) if detail == "NANOS" else c.cast("bigint") * EPOCH_UNITS[detail]
        utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
        return wall_clock(utc, "UTC", zone)
    if kind == "TIMESTAMP_WALLCLOCK":
        return wall_clock(c, detail, zone)
    if kind == "DATE_WALLCLOCK":
        return wall_clock(c, detail, zone).cast("date")
    if kind == "SCALED":
        return (c.cast("decimal(38,0)") / F.lit(10 ** int(detail))).cast(f"decimal(38,{int(detail)})")
    if kind == "INTERVAL":
        whole = c.cast("bigint")
        if detail in UNIT_NANOS:
            value = interval(0, 0, whole * UNIT_NANOS[detail])
        else:
            value = interval(0, whole * {"DAYS": 1, "WEEKS": 7}[detail], 0) if detail in ("DAYS", "WEEKS") else interval(whole * {"MONTHS": 1, "QUARTERS": 3, "YEARS": 12}[detail])
        return F.when(c.isNotNull(), value)
    if kind == "INTERVAL_FROM_STRING":
        if detail == "CLOCK":
            part = lambda i: F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(i)).cast("double"), F.lit(0.0))
            return F.when(c.isNotNull(), interval(0, 0, F.round((part(1) * 3600 + part(2) * 60 + part(3)) * 1e9)))
        number = lambda unit, after: F.coalesce(F.nullif(F.regexp_extract(c, rf"P{'[^T]*T.*?' if after else '[^T]*?'}(-?[0-9.]+){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
        months, days = number("Y", False) * 12 + number("M", False), number("W", False) * 7 + number("D", False)
        return F.when(c.isNotNull(), interval(months, days, F.round((number("H", True) * 3600 + number("M", True) * 60 + number("S", True)) * 1e9)))
    raise ValueError(f"unknown encoding {encoding}")
