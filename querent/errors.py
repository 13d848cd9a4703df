"""Errors and findings about a query, with their place in its text."""

from __future__ import annotations

from dataclasses import dataclass

Span = tuple[int, int]


def place(text: str, offset: int) -> tuple[int, int]:
    """Line and column (from 1) of an offset."""
    line = text.count("\n", 0, offset) + 1
    return line, offset - (text.rfind("\n", 0, offset) + 1) + 1


class QueryError(Exception):
    """A query that cannot be read or resolved."""

    def __init__(self, message: str, span: Span = (0, 0), text: str = ""):
        self.message, self.span = message, span
        self.line, self.column = place(text, span[0]) if text else (0, 0)
        super().__init__(f"{self.line}:{self.column}: {message}" if text else message)


@dataclass(frozen=True)
class Violation:
    """Something that is wrong with a query that could be read."""

    kind: str
    message: str
    span: Span = (0, 0)


class InvalidQuery(Exception):
    """Raised when a query with violations is to be run."""

    def __init__(self, violations: list[Violation], text: str = ""):
        self.violations = violations
        super().__init__("; ".join(f"{':'.join(map(str, place(text, v.span[0])))}: {v.message}" for v in violations))
