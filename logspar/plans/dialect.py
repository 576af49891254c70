"""Query text to Spark columns, in two dialects.

``compat`` takes any text and always yields ``status == S AND latency > L`` or a
substring search, with the historical readings that users rely on: an omitted
term is 0, OR means AND, only the first comparison form of each field counts.
``strict`` is a real grammar (AND, OR, NOT, parentheses, six comparisons, string
literals) and raises on anything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 1 << 64


@dataclass(frozen=True)
class Search:
    """Count a substring; an empty pattern counts nothing."""

    pattern: str


@dataclass(frozen=True)
class Numeric:
    """``status == status AND latency > latency`` over unsigned 64-bit values."""

    status: int = 0
    latency: int = 0

    def column(self, status: str | Column = "status", latency: str | Column = "latency") -> Column:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        return (col(status) == unsigned(self.status)) & (col(latency) > unsigned(self.latency))


def unsigned(value: int) -> Column:
    """A literal that keeps values of 2^63 and more."""
    return F.lit(value).cast("bigint") if value < 1 << 63 else F.lit(Decimal(value))


def leading_unsigned(text: str) -> int | None:
    """The integer that ``text`` starts with, negatives wrapped; None if there is none or it's too large."""
    found = re.match(r"\s*([+-]?)(\d+)", text, re.ASCII)
    if not found or int(found[2]) >= TWO64:
        return None
    return -int(found[2]) % TWO64 if found[1] == "-" else int(found[2])


def parse_compat(text: str) -> Search | Numeric:
    text = text.strip(" \t\r\n")
    if not re.search("==|[<>]", text):
        return Search(_unwrap(text))
    words = iter(re.findall(r"[^ \t\n\v\f\r]+", re.sub("[&|]|AND|and", " ", text)))
    targets = {"status": 0, "latency": 0}
    for word in words:
        field = next((f for f in targets if f in word), None)
        if field:
            value = leading_unsigned(_operand(word, "==" if field == "status" else ">", words))
            targets[field] = targets[field] if value is None else value
    return Numeric(**targets)


def _operand(word: str, operator: str, rest: Iterator[str]) -> str:
    """What follows the operator in the word, or the next word; without an operator, the word after next."""
    _, found, tail = word.partition(operator)
    if not found:
        next(rest, "")
        return next(rest, "")
    return tail or next(rest, "")


def _unwrap(text: str) -> str:
    inner = re.fullmatch(r"contains\((.*)\)", text, re.S)
    text = inner[1].strip(" \t\r\n") if inner else text
    quoted = re.fullmatch(r'"(.*)"', text, re.S)  # single quotes belong to the pattern
    return quoted[1] if quoted else text


_TOKEN = re.compile(r"\s*(?:([0-9]+)|\"([^\"]*)\"|(==|!=|>=|<=|>|<|\(|\))|(AND|OR|NOT)\b|([A-Za-z_]\w*))")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


class _Strict:
    def __init__(self, text: str):
        self.tokens: list[tuple[int, str]] = []
        #: Fields asked for, and whether as numbers or as texts.
        self.fields: dict[str, str] = {}
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the query at {text[at:at + 20]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()

    def take(self, kind: int, *texts: str) -> str | None:
        if self.tokens and self.tokens[0][0] == kind and (not texts or self.tokens[0][1] in texts):
            return self.tokens.pop(0)[1]
        return None

    def either(self) -> Column:
        out = self.both()
        while self.take(4, "OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.take(4, "AND"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.take(4, "NOT"):
            return ~self.one()
        if self.take(3, "("):
            inner = self.either()
            if not self.take(3, ")"):
                raise ValueError("a parenthesis isn't closed")
            return inner
        field, operator = self.take(5), self.take(3, *_COMPARE)
        if not field or not operator:
            raise ValueError("expected a field, a comparison and a value")
        number, text = self.take(1), None
        if number is None and (text := self.take(2)) is None:
            raise ValueError(f"{field} {operator} needs a number or a string in double quotes")
        kind = "text" if number is None else "number"
        if self.fields.setdefault(field, kind) != kind:
            raise ValueError(f"{field} is compared with a number and with a string")
        return _COMPARE[operator](F.col(field), F.lit(text) if number is None else unsigned(int(number)))


def strict_query(text: str) -> tuple[Column, dict[str, str]]:
    """The predicate, and the fields it asks for with their kind, ``number`` or ``text``."""
    parser = _Strict(text)
    out = parser.either()
    if parser.tokens:
        raise ValueError(f"unexpected {parser.tokens[0][1]!r}")
    return out, parser.fields


def parse_strict(text: str) -> Column:
    return strict_query(text)[0]
