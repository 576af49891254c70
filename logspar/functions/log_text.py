"""Scalar functions over log text: JSON fields, digit runs, occurrences, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_ROWS = 64


def json_unsigned(value: Column, *fields: str) -> dict[str, Column]:
    """Unsigned fields of a JSON text by name; what is missing, quoted, fractional,
    negative or malformed is null. Values from 2^63 on come out as DECIMAL(20,0)."""
    number = F.from_json(value, ", ".join(f"`{f}` BIGINT" for f in fields))
    text = F.from_json(value, ", ".join(f"`{f}` STRING" for f in fields))
    raw = lambda f: F.get_json_object(value, f"$.{f}")

    def field(f: str) -> Column:
        small = F.when(number[f] >= 0, number[f]).cast("decimal(20,0)")
        quoted = value.rlike(f'"{f}"\\s*:\\s*"')
        large = F.when(~quoted & raw(f).rlike("^[0-9]{19,20}$"), text[f].try_cast("decimal(20,0)"))
        return F.coalesce(small, F.when(large < F.lit("18446744073709551616").cast("decimal(20,0)"), large))

    return {f: field(f) for f in fields}


def json_bigint(value: Column, *fields: str) -> dict[str, Column]:
    """The same for values below 2^63, as BIGINT: one parse of the text, no decimals."""
    parsed = F.from_json(value, ", ".join(f"`{f}` BIGINT" for f in fields))
    return {f: F.when(parsed[f] >= 0, parsed[f]) for f in fields}


def defaulted(column: Column) -> Column:
    """0 where a numeric field is missing or unusable."""
    return F.coalesce(F.greatest(column, F.lit(0)), F.lit(0))


def digit_run(value: Column, field: str) -> Column:
    """Digits right after ``"field":`` anywhere in the line, else 0."""
    return F.coalesce(F.regexp_extract(value, f'"{field}":(\\d*)', 1).try_cast("bigint"), F.lit(0))


def quoted_string(value: Column, field: str) -> Column:
    """Text between quotes right after ``"field":``; null where there is none."""
    return F.nullif(F.regexp_extract(value, f'"{field}":"([^"]*)"', 1), F.lit(""))


def occurrences(text: Column, pattern: str) -> Column:
    """Non-overlapping occurrences from left to right; none of an empty pattern."""
    if not pattern:
        return F.lit(0).cast("bigint")
    return whole_quotient(F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit(""))), len(pattern))


def whole_quotient(a: Column, b: int) -> Column:
    """Division of integers in integers, exact up to 2^63."""
    return F.call_function("div", a, F.lit(b))


def block(row_id: Column) -> Column:
    return whole_quotient(row_id, BLOCK_ROWS)


def lane(row_id: Column) -> Column:
    return (row_id % BLOCK_ROWS).cast("int")


def leading_blanks(value: Column) -> Column:
    """Bytes of white space before a document in its line."""
    return F.octet_length(value) - F.octet_length(F.regexp_replace(value, "^[ \\t\\r]+", ""))


def strip_carriage_return(value: Column) -> Column:
    return F.regexp_replace(value, "\r$", "")


def gigabytes_per_second(n_bytes: int, seconds: float) -> float:
    return n_bytes / 2**30 / seconds


# Fixed value: the clock rate that cycles are counted by.
HERTZ = 4.05e9


def cycles_per_record(seconds: float, records: int, hertz: float = HERTZ) -> float:
    return seconds * hertz / max(1, records)
