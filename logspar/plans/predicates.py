"""Predicate trees: as a filter on rows, and as a test on row-group metadata.

A metadata test may keep a group without matches but never drops one with a
match: what a group has no metadata for, it keeps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspar.plans.dialect import unsigned


@dataclass(frozen=True)
class Eq:
    field: str
    value: int | str


@dataclass(frozen=True)
class Gt:
    field: str
    value: int


@dataclass(frozen=True)
class And:
    left: Eq | Gt | And | None
    right: Eq | Gt | And | None


Node = Eq | Gt | And


def literal(value: int | str) -> Column:
    return F.lit(value) if isinstance(value, str) else unsigned(value)


def row_filter(node: Node | None) -> Column:
    match node:
        case None:
            return F.lit(True)
        case And(left, right):
            return row_filter(left) & row_filter(right)
        case Eq(field, value):
            return F.col(field) == literal(value)
        case Gt(field, value):
            return F.col(field) > literal(value)


def may_match(node: Node | None, zone: Callable[[str], tuple[Column, Column]], bloom: Callable[[str, str], Column] | None = None) -> Column:
    """Column over metadata: ``zone(field)`` gives min and max (null: unknown),
    ``bloom(field, value)`` whether the value may be there."""
    match node:
        case None:
            return F.lit(True)
        case And(left, right):
            return may_match(left, zone, bloom) & may_match(right, zone, bloom)
        case Gt(field, value):
            return F.coalesce(zone(field)[1] > literal(value), F.lit(True))
        case Eq(field, str(value)):
            return F.coalesce(bloom(field, value), F.lit(True)) if bloom else F.lit(True)
        case Eq(field, value):
            low, high = zone(field)
            return F.coalesce(literal(value).between(low, high), F.lit(True))


def overlaps(low: Column, high: Column, a: Column, b: Column) -> Column:
    """Closed ranges meet; unknown bounds meet nothing."""
    return F.coalesce((high >= a) & (low <= b), F.lit(False))
