"""Arithmetic of dates, times, timestamps and durations.

A duration's components apply one after the other, largest first, each as a whole; months clamp to the month's end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querent.catalog.types import Type, interval

#: unit: (months, days, milliseconds)
UNITS = {"y": (12, 0, 0), "q": (3, 0, 0), "mo": (1, 0, 0), "w": (0, 7, 0), "d": (0, 1, 0), "h": (0, 0, 3_600_000), "min": (0, 0, 60_000), "s": (0, 0, 1_000), "ms": (0, 0, 1)}
ORDER = tuple(UNITS)
DAY = 86_400


def totals(parts: tuple[tuple[int, str], ...]) -> tuple[int, int, int]:
    """Months, days and milliseconds of a duration."""
    sums = [0, 0, 0]
    for n, unit in parts:
        for i, x in enumerate(UNITS[unit]):
            sums[i] += n * x
    return tuple(sums)


def is_calendar(parts) -> bool:
    return all(unit in ("y", "q", "mo", "w", "d") for _, unit in parts)


def unit_class(parts) -> str | None:
    """months, days or clock; None for a mixture."""
    months, days, ms = (bool(x) for x in totals(parts))
    return None if months + days + ms > 1 else "months" if months else "days" if days else "clock"


def literal(parts) -> Column:
    months, days, ms = totals(parts)
    return interval(months, days, ms * 1_000_000)


def dt(days: Column | int = 0, seconds: Column | float = 0) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.make_dt_interval(col(days).cast("int"), F.lit(0), F.lit(0), col(seconds).cast("decimal(18,6)"))


def plus_months(c: Column, family: str, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    if family == "DATE":
        return F.add_months(c, n.cast("int"))
    return c + F.make_ym_interval(F.lit(0), n.cast("int"))


def plus_days(c: Column, family: str, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.date_add(c, n.cast("int")) if family == "DATE" else c + dt(n)


def plus_duration(c: Column, kind: Type, parts, sign: int) -> tuple[Column, Type]:
    """A temporal value and a literal duration."""
    if kind.family == "TIME":
        ms = totals(parts)[2] * sign
        return F.pmod(c + F.lit(ms // 1000), F.lit(DAY)).cast("bigint"), kind
    if kind.family == "DATE" and not is_calendar(parts):
        c, kind = c.cast("timestamp_ntz"), Type("TIMESTAMP")
    for n, unit in parts:
        months, days, ms = (x * n * sign for x in UNITS[unit])
        if months:
            c = plus_months(c, kind.family, months)
        elif days:
            c = plus_days(c, kind.family, days)
        elif ms:
            c = c + dt(0, ms / 1000)
    return c, kind


def plus_interval(c: Column, kind: Type, span: Column, span_type: Type, sign: int) -> tuple[Column, Type]:
    """A temporal value and a computed duration."""
    if span_type.seconds:
        if kind.family == "TIME":
            return F.pmod(c + span * sign, F.lit(DAY)), kind
        return c.cast("timestamp_ntz") + dt(0, span * sign), Type("TIMESTAMP")
    seconds = F.floor(span["nanos"] / 1_000_000_000)
    if kind.family == "TIME":
        return F.pmod(c + seconds * sign, F.lit(DAY)), kind
    c = c.cast("timestamp_ntz")
    c = c + F.make_ym_interval(F.lit(0), span["months"] * sign)
    return c + dt(span["days"] * sign) + dt(0, span["nanos"] * sign / 1_000_000_000), Type("TIMESTAMP")


def elapsed(a: Column, b: Column) -> Column:
    """Whole seconds from b to a."""
    return F.floor((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000).cast("bigint")


def between(unit: str, a: Column, b: Column, a_type: Type, b_type: Type) -> Column:
    """Whole completed units from a to b."""
    if unit == "DAY" and a_type.family == b_type.family == "DATE":
        return F.datediff(b, a)
    return F.timestamp_diff(unit, a.cast("timestamp_ntz"), b.cast("timestamp_ntz")).cast("int")


def calendar_distance(a: Column, b: Column, a_type: Type, b_type: Type) -> Column:
    """Years and months, days and clock time from a to b, as a calendar counts them; negative the other way round."""
    x, y = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    low, high = F.least(x, y), F.greatest(x, y)
    of_day = lambda c: (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("bigint")
    clock = of_day(high) - of_day(low)
    last = F.when(clock < 0, F.date_sub(high.cast("date"), 1)).otherwise(high.cast("date"))
    clock = F.when(clock < 0, clock + DAY).otherwise(clock)
    first = low.cast("date")
    months = F.when(last < first, 0).otherwise(F.timestamp_diff("MONTH", first.cast("timestamp_ntz"), last.cast("timestamp_ntz")))
    days = F.datediff(last, F.add_months(first, months.cast("int")))
    sign = F.when(x <= y, 1).otherwise(-1)
    return F.when(x.isNotNull() & y.isNotNull(), interval(months * sign, days * sign, clock * sign * 1_000_000_000))


def begin(c: Column, kind: Type, unit: str) -> Column:
    if kind.family == "DATE":
        return c if unit == "DAY" else F.trunc(c, unit)
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def seconds_text(c: Column) -> Column:
    """HH:mm:ss of a TIME."""
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(two(F.floor(c / 3600)), F.lit(":"), two(F.floor(c / 60) % 60), F.lit(":"), two(c % 60))


#: parts of date masks and their pattern letters
MASKS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF": "SSSSSS", "AM": "a", "PM": "a", "Q": "Q"}
PERCENT = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD"}


def pattern(mask: str) -> str:
    """A date mask, with % signs or with letters, as a datetime pattern."""
    out, i, plain = [], 0, ""
    table = sorted(MASKS, key=len, reverse=True)

    def text(s):
        return "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in s)

    while i < len(mask):
        if mask[i] == "%" and mask[i + 1 : i + 2] in PERCENT:
            hit, size = PERCENT[mask[i + 1]], 2
        else:
            key = None if "%" in mask else next((k for k in table if mask.startswith(k, i)), None)
            hit, size = (MASKS[key], len(key)) if key else (None, 1)
        if hit is None:
            plain += mask[i]
        else:
            out += [text(plain), hit]
            plain = ""
        i += size
    return "".join([*out, text(plain)])
