"""Units, kinds of quantity and their dimensions."""

from __future__ import annotations

from dataclasses import dataclass

DIMENSIONS = ("MONEY", "LENGTH", "MASS", "TIME", "TEMPERATURE", "COUNT")
Dims = tuple[int, ...]
NONE: Dims = (0,) * len(DIMENSIONS)


def dims(text: str) -> Dims:
    """'MONEY/COUNT', 'LENGTH^3' and so on, as exponents."""
    out = [0] * len(DIMENSIONS)
    sign = 1
    for word in text.replace("/", " / ").replace("*", " ").split():
        if word == "/":
            sign = -1
            continue
        name, _, power = word.partition("^")
        out[DIMENSIONS.index(name)] += sign * int(power or 1)
    return tuple(out)


@dataclass(frozen=True)
class Unit:
    code: str
    symbol: str
    dims: Dims


@dataclass(frozen=True)
class Kind:
    code: str
    dims: Dims
    unit: str | None = None


# fixed values: units and kinds of quantity; the first kind of a dimension names results
UNITS = {
    u: Unit(u, symbol, dims(d))
    for u, symbol, d in (
        ("EUR", "€", "MONEY"), ("USD", "$", "MONEY"), ("GBP", "£", "MONEY"), ("m", "m", "LENGTH"), ("km", "km", "LENGTH"), ("cm", "cm", "LENGTH"), ("mm", "mm", "LENGTH"),
        ("kg", "kg", "MASS"), ("g", "g", "MASS"), ("t", "t", "MASS"), ("s", "s", "TIME"), ("min", "min", "TIME"), ("h", "h", "TIME"), ("d", "d", "TIME"),
        ("1", "", "COUNT"), ("%", "%", ""), ("°C", "°C", "TEMPERATURE"),
    )
}
KINDS = {
    k: Kind(k, dims(d), u)
    for k, d, u in (
        ("money", "MONEY", None), ("unit-price", "MONEY/COUNT", None), ("count", "COUNT", "1"), ("ratio", "", None), ("length", "LENGTH", "m"), ("area", "LENGTH^2", None), ("volume", "LENGTH^3", None),
        ("mass", "MASS", "kg"), ("duration", "TIME", "s"), ("speed", "LENGTH/TIME", None), ("temperature", "TEMPERATURE", "°C"), ("cost", "MONEY", None), ("amount", "MONEY", None),
        ("rate", "COUNT/TIME", None), ("density", "MASS/LENGTH^3", None), ("pressure", "MASS/LENGTH / TIME^2", None),
    )
}


@dataclass(frozen=True)
class Quantity:
    dims: Dims = NONE
    unit: str | None = None
    kind: str | None = None
    known: bool = False

    def times(self, other: Quantity, sign: int = 1) -> Quantity:
        if not (self.known and other.known):
            return UNKNOWN
        d = tuple(a + sign * b for a, b in zip(self.dims, other.dims))
        # a factor without a dimension keeps the unit
        unit = self.unit if other.dims == NONE or UNITS.get(other.unit or "", Unit("", "", NONE)).dims == dims("COUNT") else other.unit if self.dims == NONE and sign > 0 else None
        if unit is not None and UNITS[unit].dims != d:
            unit = None
        if unit is None and d == dims("MONEY"):
            unit = next((u for u in (self.unit, other.unit) if u and UNITS[u].dims == d), None)
        return Quantity(d, unit, kind_of(d), True)

    def plus(self, other: Quantity) -> Quantity:
        """Sums keep a dimension; a plain number beside a ratio is one."""
        if not (self.known and other.known):
            return self if self.known and self.dims == NONE else other if other.known and other.dims == NONE else UNKNOWN
        if self.dims != other.dims:
            return UNKNOWN
        return Quantity(self.dims, self.unit if self.unit == other.unit else None, self.kind if self.kind == other.kind else kind_of(self.dims), True)


UNKNOWN = Quantity()


def kind_of(d: Dims) -> str | None:
    return next((k.code for k in KINDS.values() if k.dims == d), None)


def declared(unit: str | None, kind: str | None) -> Quantity:
    """The quantity of an annotated column."""
    k, u = KINDS.get(kind or ""), UNITS.get(unit or "")
    if k is None and u is None:
        return UNKNOWN
    d = k.dims if k else u.dims
    return Quantity(d, u.code if u else k.unit, k.code if k else kind_of(d), True)
