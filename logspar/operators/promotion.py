"""Promotion of JSON fields that queries ask for to typed columns."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and thresholds of the promotion rule.
COUNT_WEIGHT, DENSITY_WEIGHT, LEAST_SCORE, LEAST_DENSITY = 0.7, 0.3, 0.15, 0.01


def field_heat(accesses: DataFrame, field: str = "field") -> DataFrame:
    return accesses.groupBy(field).agg(F.count("*").alias("access_count"))


def score(count: Column, density: Column) -> Column:
    return COUNT_WEIGHT * count + DENSITY_WEIGHT * density


def should_promote(count: Column, density: Column) -> Column:
    """An unknown field (nulls) is not promoted."""
    return F.coalesce((score(count, density) > LEAST_SCORE) & (density > LEAST_DENSITY), F.lit(False))


def density(rows: DataFrame, value: Column) -> DataFrame:
    """Share of rows that have the field."""
    return rows.agg((F.count(value) / F.greatest(F.count("*"), F.lit(1))).alias("density"))


def promote(rows: DataFrame, raw: str, field: str, kind: str = "bigint") -> DataFrame:
    """``rows`` with the JSON field as a typed column; a column of that name is an error."""
    if field in rows.columns:
        raise ValueError(f"{field} is a column already")
    return rows.withColumn(field, F.get_json_object(raw, f"$.{field}").try_cast(kind))


def fingerprint(rows: DataFrame) -> int:
    """Changes with the schema, and is the same for the same schema."""
    return zlib.crc32(rows.schema.json().encode())


def slot(rows: DataFrame, field: str) -> int:
    """Place of a field among the columns; -1 if it has none."""
    return rows.columns.index(field) if field in rows.columns else -1
