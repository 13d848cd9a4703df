"""Results as text and files: rows, CSV, XML, locale formats and durations in words."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row


@dataclass
class LocaleFormat:
    """How values look."""

    date: str = "%Y-%m-%d"
    time: str = "%H:%M:%S"
    timestamp: str = "%Y-%m-%d %H:%M:%S"
    decimal: str = "."
    group: str = ""
    places: int | None = None
    true: str = "true"
    false: str = "false"
    null: str = ""
    words: dict[str, tuple[str, str]] = field(default_factory=lambda: {"y": ("year", "years"), "mo": ("month", "months"), "d": ("day", "days"), "h": ("hour", "hours"), "min": ("minute", "minutes"), "s": ("second", "seconds")})

    def value(self, x) -> str:
        if x is None:
            return self.null
        if isinstance(x, bool):
            return self.true if x else self.false
        if isinstance(x, datetime.datetime):
            return x.strftime(self.timestamp)
        if isinstance(x, datetime.date):
            return x.strftime(self.date)
        if isinstance(x, (int, float, Decimal)):
            return self.number(x)
        if isinstance(x, Row) and {"months", "days", "nanos"} <= set(x.__fields__):
            return duration(x)
        return str(x)

    def number(self, x) -> str:
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return str(x)
        d = Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
        if self.places is not None and not isinstance(x, int):
            d = d.quantize(Decimal(1).scaleb(-self.places), ROUND_HALF_UP)
        text = f"{d:f}"
        sign, text = ("-", text[1:]) if text.startswith("-") else ("", text)
        whole, _, part = text.partition(".")
        if self.group:
            whole = f"{int(whole):,}".replace(",", self.group)
        return sign + whole + (self.decimal + part if part else "")

    def worded(self, x) -> str:
        """A duration in words."""
        out = [f"{n} {self.words[u][abs(n) != 1]}" for n, u in parts(x)]
        return " ".join(out) or f"0 {self.words['s'][1]}"


GERMAN = LocaleFormat("%d.%m.%Y", "%H:%M:%S", "%d.%m.%Y %H:%M:%S", ",", ".", None, "wahr", "falsch", "", {"y": ("Jahr", "Jahre"), "mo": ("Monat", "Monate"), "d": ("Tag", "Tage"), "h": ("Stunde", "Stunden"), "min": ("Minute", "Minuten"), "s": ("Sekunde", "Sekunden")})


def parts(x) -> list[tuple[int, str]]:
    """Components of a duration that are not zero."""
    sign = -1 if x["nanos"] < 0 else 1
    seconds = abs(x["nanos"]) // 1_000_000_000 * sign
    years, months = int(x["months"] / 12), int(x["months"] - 12 * int(x["months"] / 12))
    hours = int(seconds / 3600)
    minutes = int((seconds - hours * 3600) / 60)
    found = [(years, "y"), (months, "mo"), (x["days"], "d"), (hours, "h"), (minutes, "min"), (seconds - hours * 3600 - minutes * 60, "s")]
    return [(n, u) for n, u in found if n]


def duration(x) -> str:
    """A duration as it is written in queries."""
    return "".join(f"{n}{u}" for n, u in parts(x)) or "0s"


def iso_duration(x) -> str:
    day = "".join(f"{n}{ {'y': 'Y', 'mo': 'M', 'd': 'D'}[u]}".replace(" ", "") for n, u in parts(x) if u in ("y", "mo", "d"))
    clock = "".join(f"{n}{ {'h': 'H', 'min': 'M', 's': 'S'}[u]}".replace(" ", "") for n, u in parts(x) if u in ("h", "min", "s"))
    return f"P{day}{'T' + clock if clock else ''}" if day or clock else "PT0S"


def rows(df: DataFrame, limit: int | None = None) -> list[tuple]:
    return [tuple(r) for r in (df.limit(limit) if limit is not None else df).collect()]


def each(df: DataFrame, take: Callable[[tuple], bool | None]) -> int:
    """Hands rows over one by one, partition by partition, until take returns False; returns their number."""
    n = 0
    for r in df.toLocalIterator():
        n += 1
        if take(tuple(r)) is False:
            break
    return n


def csv_lines(df: DataFrame, form: LocaleFormat | None = None, header: bool = True, ordered: bool = False) -> Iterator[str]:
    """Quoted cells joined by a comma and a space."""
    form = form or LocaleFormat()
    line = lambda cells: ", ".join('"' + c.replace('"', '""') + '"' for c in cells)
    if header:
        yield line(df.columns)
    body = (line(map(form.value, r)) for r in df.toLocalIterator())
    yield from sorted(body) if ordered else body


def xml_lines(df: DataFrame, form: LocaleFormat | None = None) -> Iterator[str]:
    form = form or LocaleFormat()
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield "<Result>"
    for r in df.toLocalIterator():
        cells = "".join(f"<Cell name={quoteattr(c)}{'' if v is not None else ' null=' + quoteattr('true')}>{escape(form.value(v))}</Cell>" for c, v in zip(df.columns, r))
        yield f"  <Row>{cells}</Row>"
    yield "</Result>"


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options) -> None:
    """Writes in parallel: parquet, csv, json, orc or xml."""
    writer = df.write.mode(mode)
    if kind == "xml":
        options = {"rootTag": "Result", "rowTag": "Row"} | options
    if kind == "csv":
        options = {"header": "true"} | options
    writer.format(kind).options(**options).save(path)
