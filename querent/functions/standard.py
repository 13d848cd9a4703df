"""The standard functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from querent.catalog.types import ADDITIVE, ANY, NUMERIC, TEMPORAL, Type, interval, wider
from querent.functions import temporal as tm
from querent.functions.registry import AGGREGATE, SCALAR, WINDOW, Function, Given, Param, Registry

TEXT, INTEGER, FLOAT, BOOLEAN, DATE, TIME, TIMESTAMP, INTERVAL = (Type(x) for x in ("TEXT", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "TIME", "TIMESTAMP", "INTERVAL"))
DATED = frozenset({"DATE", "TIMESTAMP"})
FAMILY = {"text": frozenset({"TEXT"}), "int": frozenset({"INTEGER"}), "num": NUMERIC, "any": ANY, "dated": DATED, "temporal": TEMPORAL, "additive": ADDITIVE, "date": frozenset({"DATE"}), "time": frozenset({"TIME"}), "ts": frozenset({"TIMESTAMP"}), "bool": frozenset({"BOOLEAN"}), "like": frozenset({"TEXT", "UUID", "JSON"})}


def params(text: str) -> tuple[Param, ...]:
    """'s:text [n:int] x:any...' as parameters."""
    out = []
    for word in text.split():
        optional, repeated = word.startswith("["), word.rstrip("]").endswith("...")
        name, _, family = word.strip("[]").removesuffix("...").partition(":")
        out.append(Param(name, FAMILY[family or "any"], optional, repeated))
    return tuple(out)


def arg(i: int = 0) -> Callable[[list[Type]], Type]:
    return lambda types: types[i]


def define(r: Registry, name: str, given: str, result, build: Callable[..., Column], kind: str = SCALAR) -> None:
    """build(*columns); with a parameter named g first, build(g)."""
    whole = build.__code__.co_varnames[:1] == ("g",)
    r.register(Function(name, params(given), result if callable(result) else lambda _: result, build if whole else lambda g: build(*g.columns), kind))


def number_or(value, default):
    return default if value is None else value


def null_free_concat(g: Given) -> Column:
    return F.concat_ws("", *[as_text(c, t) for c, t in zip(g.columns, g.types)])


def as_text(c: Column, kind: Type) -> Column:
    if kind.family == "TIME":
        return tm.seconds_text(c)
    if kind.family == "INTERVAL" and not kind.seconds:
        part = lambda x, unit: F.when(x != 0, F.concat(x.cast("string"), F.lit(unit))).otherwise("")
        months, seconds = c["months"], F.floor(c["nanos"] / 1_000_000_000)
        text = F.concat(part(F.floor(months / 12), "y"), part(months % 12, "mo"), part(c["days"], "d"), part(F.floor(seconds / 3600), "h"), part(F.floor(seconds / 60) % 60, "min"), part(seconds % 60, "s"))
        return F.when(c.isNotNull(), F.when(text == "", "0s").otherwise(text))
    return c.cast("string")


def flagged(pattern: Column, flags) -> Column:
    keep = "".join(x for x in (flags or "") if x in "imsx")
    return F.concat(F.lit(f"(?{keep})"), pattern) if keep else pattern


def part_of(s: Column, start: Column, size: Column | None = None) -> Column:
    """A part of a text; place 0 stands before the first character and takes one of the size."""
    if size is None:
        return F.substr(s, start)
    return F.substr(s, start, F.when(start == 0, F.greatest(size - 1, F.lit(0))).otherwise(size).cast("int"))


def text_functions(r: Registry) -> None:
    for n in ("char_length", "character_length", "length"):
        define(r, n, "s:like", INTEGER, lambda s: F.char_length(s))
    define(r, "octet_length", "s:like", INTEGER, lambda s: F.octet_length(s))
    define(r, "bit_length", "s:like", INTEGER, lambda s: F.bit_length(s))
    for n, f in (("upper", F.upper), ("lower", F.lower), ("initcap", F.initcap), ("reverse", F.reverse), ("md5", F.md5)):
        define(r, n, "s:like", TEXT, lambda s, f=f: f(s))
    for n, f in (("trim", F.btrim), ("btrim", F.btrim), ("ltrim", F.ltrim), ("rtrim", F.rtrim)):
        define(r, n, "s:text [chars:text]", TEXT, lambda s, chars=None, f=f: f(s) if chars is None else f(s, chars))
    for n in ("substr", "substring"):
        define(r, n, "s:text start:int [len:int]", TEXT, part_of)
    define(r, "left", "s:text n:int", TEXT, lambda s, n: F.left(s, n))
    define(r, "right", "s:text n:int", TEXT, lambda s, n: F.right(s, n))
    define(r, "repeat", "s:text n:int", TEXT, lambda s, n: F.repeat(s, n.cast("int")))
    for n, f in (("lpad", "lpad"), ("rpad", "rpad")):
        define(r, n, "s:text n:int [fill:text]", TEXT, lambda s, size, fill=None, f=f: F.call_function(f, s, size.cast("int"), F.lit(" ") if fill is None else fill))
    r.register(Function("concat", params("x:any..."), lambda _: TEXT, null_free_concat))
    define(r, "concat_ws", "sep:text x:any...", TEXT, lambda g: F.call_function("concat_ws", g.columns[0], *[as_text(c, t) for c, t in zip(g.columns[1:], g.types[1:])]))
    define(r, "replace", "s:text from:text to:text", TEXT, lambda s, a, b: F.replace(s, a, b))
    define(r, "translate", "s:text from:text to:text", TEXT, lambda s, a, b: F.call_function("translate", s, a, b))
    define(r, "overlay", "s:text repl:text start:int [len:int]", TEXT, lambda s, x, at, size=None: F.overlay(s, x, at) if size is None else F.overlay(s, x, at, size))
    define(r, "starts_with", "s:text prefix:text", BOOLEAN, lambda s, p: F.startswith(s, p))
    define(r, "strpos", "s:text substr:text", INTEGER, lambda s, x: F.call_function("instr", s, x))
    define(r, "instr", "s:text substr:text", INTEGER, lambda s, x: F.call_function("instr", s, x))
    define(r, "position", "substr:text str:text", INTEGER, lambda x, s: F.call_function("instr", s, x))
    define(r, "split_part", "s:text delim:text n:int", TEXT, lambda s, d, n: F.split_part(s, d, n))
    define(r, "ascii", "s:text", INTEGER, lambda s: F.ascii(s))
    define(r, "chr", "n:int", TEXT, lambda n: F.char(n))
    define(r, "to_hex", "n:int", TEXT, lambda n: F.hex(n))
    define(r, "printf", "format:text x:any...", TEXT, lambda g: F.call_function("format_string", *g.columns))
    define(r, "split", "s:text delim:text", Type("TEXT"), lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))))
    define(r, "sha256", "s:like", TEXT, lambda s: F.sha2(s, 256))
    define(r, "list", "x:any...", TEXT, lambda g: F.array(*g.columns))
    define(r, "regexp_like", "s:text pattern:text [flags:text]", BOOLEAN, lambda g: F.regexp_like(g.columns[0], flagged(g.columns[1], number_or((g.literals + [None] * 3)[2], ""))))
    define(r, "regexp_count", "s:text pattern:text [start:int]", INTEGER, lambda s, p, at=None: F.regexp_count(s if at is None else F.substr(s, at), p))
    define(r, "regexp_substr", "s:text pattern:text", TEXT, lambda s, p: F.regexp_substr(s, p))
    define(r, "regexp_replace", "s:text pattern:text repl:text [flags:text]", TEXT, lambda g: F.regexp_replace(g.columns[0], flagged(g.columns[1], (g.literals + [None] * 4)[3]), g.columns[2]))


def whole(c: Column, t: Type, f) -> Column:
    """ceil and floor keep their argument's type."""
    return f(c).cast(t.spark()) if t.family in ("FLOAT", "DECIMAL") else f(c).cast("bigint")


def math_functions(r: Registry) -> None:
    define(r, "abs", "x:num", arg(), lambda x: F.abs(x))
    for n, f in (("ceil", F.ceil), ("ceiling", F.ceil), ("floor", F.floor)):
        define(r, n, "x:num", arg(), lambda g, f=f: whole(g.columns[0], g.types[0], f))
    define(r, "round", "x:num [n:int]", arg(), lambda g: F.round(g.columns[0], int(number_or((g.literals + [None, None])[1], 0))).cast(g.types[0].spark()))
    define(r, "mod", "a:num b:num", lambda t: wider(*t), lambda a, b: a % b)
    define(r, "power", "x:num y:num", FLOAT, lambda x, y: F.pow(x, y))
    define(r, "sqrt", "x:num", FLOAT, lambda x: F.sqrt(x))
    define(r, "pi", "", FLOAT, lambda: F.pi())
    define(r, "random", "", FLOAT, lambda: F.rand())
    define(r, "rand", "", FLOAT, lambda: F.rand())
    for n in ("truncate", "trunc"):
        define(r, n, "x:num", arg(), lambda g: F.when(g.columns[0] < 0, F.ceil(g.columns[0])).otherwise(F.floor(g.columns[0])).cast(g.types[0].spark()))
    define(r, "bit_count", "n:int", INTEGER, lambda n: F.bit_count(n))
    for n in "cbrt exp ln log2 log10 sin cos tan asin acos atan sinh cosh tanh degrees radians".split():
        define(r, n, "x:num", FLOAT, lambda x, n=n: F.call_function(n, x))
    define(r, "log", "base:num x:num", FLOAT, lambda b, x: F.call_function("log", b, x))
    define(r, "pow", "x:num y:num", FLOAT, lambda x, y: F.pow(x, y))
    define(r, "atan2", "y:num x:num", FLOAT, lambda y, x: F.atan2(y, x))
    define(r, "sign", "x:num", FLOAT, lambda x: F.signum(x))
    define(r, "div", "a:num b:num", INTEGER, lambda a, b: F.call_function("div", a, b))
    define(r, "factorial", "n:int", INTEGER, lambda n: F.factorial(n.cast("int")))
    define(r, "width_bucket", "x:num low:num high:num n:int", INTEGER, lambda x, a, b, n: F.width_bucket(x, a, b, n))
    for n, f in (("greatest", F.greatest), ("least", F.least)):
        define(r, n, "x:any y:any z:any...", lambda t: common(t), lambda g, f=f: f(*g.columns))


def common(types: list[Type]) -> Type:
    out = types[0]
    for t in types[1:]:
        out = wider(out, t) or out
    return out


def conversion_functions(r: Registry) -> None:
    define(r, "to_boolean", "x:any", BOOLEAN, lambda x: x.cast("boolean"))
    for n in ("to_float", "to_double"):
        define(r, n, "x:any", FLOAT, lambda x: x.cast("double"))
    for n, kind in (("to_integer", "int"), ("to_int", "int"), ("to_bigint", "bigint"), ("to_smallint", "smallint")):
        define(r, n, "x:any", INTEGER, lambda g, kind=kind: (F.trim(g.columns[0]).cast("double") if g.types[0].family == "TEXT" and kind != "bigint" else g.columns[0]).cast(kind))
    define(r, "to_decimal", "x:any [p:int] [s:int]", lambda t: Type("DECIMAL", 38, 10), lambda g: g.columns[0].cast(f"decimal({number_or((g.literals + [None] * 3)[1], 38)},{number_or((g.literals + [None] * 3)[2], 10)})"))
    define(r, "to_varchar", "x:any [n:int]", TEXT, lambda g: as_text(g.columns[0], g.types[0]))
    define(r, "to_text", "value:any", TEXT, lambda g: as_text(g.columns[0], g.types[0]))
    define(r, "to_char", "x:any mask:text", TEXT, to_char)
    define(r, "to_number", "s:text mask:text", Type("DECIMAL", 38, 10), lambda g: F.to_number(g.columns[0], F.lit(g.literals[1])).cast("decimal(38,10)"))


def to_char(g: Given) -> Column:
    c, t, mask = g.columns[0], g.types[0], g.literals[1]
    if t.family in DATED:
        return F.date_format(c, tm.pattern(mask))
    if t.family == "TIME":
        return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + tm.dt(0, c), tm.pattern(mask))
    places = len(mask.replace("D", ".").partition(".")[2])
    return F.trim(F.to_char(F.round(c.cast(f"decimal(30,{places})"), places), F.lit(mask)))


def parsed(c: Column, mask: str) -> Column:
    return F.to_timestamp_ntz(c, F.lit(tm.pattern(mask)))


def as_time(c: Column, t: Type) -> Column:
    if t.family == "TIME":
        return c
    if t.family == "TEXT":
        part = lambda i: F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(i)).cast("double"), F.when(c.isNotNull(), 0.0))
        return F.floor(part(1) * 3600 + part(2) * 60 + part(3)).cast("bigint")
    c = c.cast("timestamp_ntz")
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("bigint")


def shifted(c: Column, t: Type, start: str, zone: str) -> Column:
    out = F.convert_timezone(F.lit(start), F.lit(zone), c.cast("timestamp_ntz"))
    return out.cast("date") if t.family == "DATE" else out


def date_functions(r: Registry) -> None:
    for n in ("now", "clock_now"):
        define(r, n, "", TIMESTAMP, lambda g: F.convert_timezone(F.current_timezone(), F.lit(g.zone), F.localtimestamp()))
    define(r, "today", "", DATE, lambda g: F.convert_timezone(F.current_timezone(), F.lit(g.zone), F.localtimestamp()).cast("date"))
    define(r, "date", "x:any", DATE, lambda x: x.cast("date"))
    define(r, "time", "x:any", TIME, lambda g: as_time(g.columns[0], g.types[0]))
    define(r, "timestamp", "x:any", TIMESTAMP, lambda x: x.cast("timestamp_ntz"))
    for n, f in (("year", F.year), ("month", F.month), ("day", F.day)):
        define(r, n, "x:dated", INTEGER, lambda x, f=f: f(x))
    for n, f, size, wrap in (("hour", F.hour, 3600, 24), ("minute", F.minute, 60, 60), ("second", F.second, 1, 60)):
        define(r, n, "x:temporal", INTEGER, lambda g, f=f, size=size, wrap=wrap: (F.floor(g.columns[0] / size) % wrap).cast("int") if g.types[0].family == "TIME" else f(g.columns[0].cast("timestamp_ntz")))
    define(r, "date_trunc", "part:text x:temporal", arg(1), lambda g: F.date_trunc(g.literals[0], g.columns[1]).cast(g.types[1].spark()))
    define(r, "make_date", "y:int m:int d:int", DATE, lambda y, m, d: F.make_date(y, m, d))
    define(r, "make_time", "h:int m:int s:num", TIME, lambda h, m, s: (h * 3600 + m * 60 + F.floor(s)).cast("bigint"))
    define(r, "make_timestamp", "y:int mo:int d:int h:int mi:int s:num", TIMESTAMP, lambda *a: F.make_timestamp_ntz(*a[:5], a[5].cast("decimal(8,6)")))
    for n, unit in (("days_between", "DAY"), ("months_between", "MONTH"), ("years_between", "YEAR")):
        define(r, n, "a:dated b:dated", INTEGER, lambda g, unit=unit: tm.between(unit, *g.columns, *g.types))
    define(r, "calendar_distance", "a:dated b:dated", INTERVAL, lambda g: tm.calendar_distance(*g.columns, *g.types))
    define(r, "day_add", "x:dated n:int", arg(), lambda g: tm.plus_days(g.columns[0], g.types[0].family, g.columns[1]))
    define(r, "month_add", "x:dated n:int", arg(), lambda g: tm.plus_months(g.columns[0], g.types[0].family, g.columns[1]))
    define(r, "year_add", "x:dated n:int", arg(), lambda g: tm.plus_months(g.columns[0], g.types[0].family, g.columns[1] * 12))
    for unit in ("DAY", "MONTH", "QUARTER", "YEAR"):
        define(r, f"{unit.lower()}_begin", "x:dated", arg(), lambda g, unit=unit: tm.begin(g.columns[0], g.types[0], unit))
    define(r, "month_end", "x:dated", DATE, lambda x: F.last_day(x.cast("date")))
    define(r, "quarter_end", "x:dated", DATE, lambda x: F.last_day(F.add_months(F.trunc(x.cast("date"), "QUARTER"), 2)))
    define(r, "year_end", "x:dated", DATE, lambda x: F.make_date(F.year(x), F.lit(12), F.lit(31)))
    define(r, "at_zone", "x:dated zone:text", arg(), lambda g: shifted(g.columns[0], g.types[0], g.zone, g.literals[1]))
    define(r, "to_utc", "x:dated zone:text", arg(), lambda g: shifted(g.columns[0], g.types[0], g.literals[1], g.zone))
    define(r, "parse_date", "s:text mask:text", DATE, lambda g: F.to_date(g.columns[0], tm.pattern(g.literals[1])))
    define(r, "parse_time", "s:text mask:text", TIME, lambda g: as_time(parsed(g.columns[0], g.literals[1]), TIMESTAMP))
    define(r, "parse_timestamp", "s:text mask:text", TIMESTAMP, lambda g: parsed(g.columns[0], g.literals[1]))
    define(r, "to_date", "x:any", DATE, lambda x: x.cast("date"))
    define(r, "to_date", "s:text mask:text", DATE, lambda g: F.to_date(g.columns[0], tm.pattern(g.literals[1])))
    define(r, "to_date", "x:ts zone:text", DATE, lambda g: shifted(g.columns[0], DATE, g.zone, g.literals[1]))
    define(r, "to_date", "y:int m:int d:int", DATE, lambda y, m, d: F.make_date(y, m, d))
    define(r, "to_time", "x:any", TIME, lambda g: as_time(g.columns[0], g.types[0]))
    define(r, "to_time", "s:text mask:text", TIME, lambda g: as_time(parsed(g.columns[0], g.literals[1]), TIMESTAMP))
    define(r, "to_time", "x:ts zone:text", TIME, lambda g: as_time(shifted(g.columns[0], TIMESTAMP, g.zone, g.literals[1]), TIMESTAMP))
    define(r, "to_time", "h:int m:int s:num", TIME, lambda h, m, s: (h * 3600 + m * 60 + F.floor(s)).cast("bigint"))
    define(r, "to_timestamp", "x:any", TIMESTAMP, lambda x: x.cast("timestamp_ntz"))
    define(r, "to_timestamp", "s:text mask:text", TIMESTAMP, lambda g: parsed(g.columns[0], g.literals[1]))
    define(r, "to_timestamp", "s:text mask:text zone:text", TIMESTAMP, lambda g: shifted(parsed(g.columns[0], g.literals[1]), TIMESTAMP, g.literals[2], g.zone))
    define(r, "to_timestamp", "y:int mo:int d:int h:int mi:int s:num", TIMESTAMP, lambda *a: F.make_timestamp_ntz(*a[:5], a[5].cast("decimal(8,6)")))
    define(r, "to_timestamp", "y:int mo:int d:int h:int mi:int s:num zone:text", TIMESTAMP, lambda g: shifted(F.make_timestamp_ntz(*g.columns[:5], g.columns[5].cast("decimal(8,6)")), TIMESTAMP, g.literals[6], g.zone))
    define(r, "to_interval", "n:int unit:text", INTERVAL, lambda g: counted_interval(g.columns[0], g.literals[1]))
    define(r, "to_interval", "y:int mo:int d:int h:int mi:int s:int", INTERVAL, lambda y, mo, d, h, mi, s: interval(y * 12 + mo, d, (h * 3600 + mi * 60 + s).cast("bigint") * 1_000_000_000))


def counted_interval(n: Column, unit: str) -> Column:
    word = unit.upper().rstrip("S")
    unit = {"YEAR": "y", "QUARTER": "q", "MONTH": "mo", "WEEK": "w", "DAY": "d", "HOUR": "h", "MINUTE": "min", "SECOND": "s", "MILLISECOND": "ms"}[word]
    months, days, ms = tm.UNITS[unit]
    return F.when(n.isNotNull(), interval(n * months, n * days, n.cast("bigint") * ms * 1_000_000))


def summed(g: Given) -> Column:
    c, t = g.columns[0], g.types[0]
    if t.family == "INTERVAL" and not t.seconds:
        return F.when(F.count(c) > 0, interval(F.sum(c["months"]), F.sum(c["days"]), F.sum(c["nanos"])))
    return F.sum(c)


def averaged(g: Given) -> Column:
    c, t = g.columns[0], g.types[0]
    if t.family == "INTERVAL" and not t.seconds:
        return F.when(F.count(c) > 0, interval(F.avg(c["months"]), F.avg(c["days"]), F.avg(c["nanos"])))
    return F.avg(c.cast("double"))


def aggregate_functions(r: Registry) -> None:
    define(r, "count", "[x:any]", INTEGER, lambda x=None: F.count(F.lit(1) if x is None else x), AGGREGATE)
    define(r, "sum", "x:additive", arg(), summed, AGGREGATE)
    define(r, "avg", "x:additive", lambda t: t[0] if t[0].family == "INTERVAL" else FLOAT, averaged, AGGREGATE)
    for n, f in (("min", F.min), ("max", F.max)):
        define(r, n, "x:any", arg(), lambda x, f=f: f(x), AGGREGATE)
    for n in ("string_agg", "group_concat", "listagg"):
        define(r, n, "v:any [sep:text]", TEXT, lambda g: F.listagg(as_text(g.columns[0], g.types[0]), F.lit(number_or((g.literals + [None, None])[1], ","))), AGGREGATE)
    for n in ("bit_and", "bit_or", "bit_xor"):
        define(r, n, "n:int", INTEGER, lambda x, n=n: F.call_function(n, x), AGGREGATE)


def window_functions(r: Registry) -> None:
    for n in ("row_number", "rank", "dense_rank"):
        define(r, n, "", INTEGER, lambda n=n: F.call_function(n), WINDOW)
    for n in ("percent_rank", "cume_dist"):
        define(r, n, "", FLOAT, lambda n=n: F.call_function(n), WINDOW)
    define(r, "ntile", "n:int", INTEGER, lambda g: F.ntile(int(g.literals[0])), WINDOW)
    for n, f in (("lag", F.lag), ("lead", F.lead)):
        define(r, n, "x:any [n:int] [default:any]", arg(), lambda g, f=f: f(g.columns[0], int(number_or((g.literals + [None, None])[1], 1)), (g.literals + [None] * 3)[2]), WINDOW)
    for n, f in (("first_value", F.first_value), ("last_value", F.last_value)):
        define(r, n, "x:any", arg(), lambda x, f=f: f(x), WINDOW)
    define(r, "nth_value", "x:any n:int", arg(), lambda g: F.nth_value(g.columns[0], int(g.literals[1])), WINDOW)


def standard() -> Registry:
    r = Registry()
    for add in (text_functions, math_functions, conversion_functions, date_functions, aggregate_functions, window_functions):
        add(r)
    return r
