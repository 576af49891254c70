"""Counting and fetching log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.functions import log_text as T
from logspar.plans import dialect
from logspar.plans.plan_cache import PlanCache
from logspar.sources import ndjson


#: Readings of query texts.
PLANS = PlanCache()


def count_where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Partial counts in each task, one row out."""
    return rows.filter(predicate).agg(F.count("*").alias("matches"))


def count_occurrences(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(T.occurrences(F.col(text), pattern)), F.lit(0)).alias("matches"))


def count_lines_with(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.filter(F.col(text).contains(pattern)).agg(F.count("*").alias("matches"))


def run_query(spark: SparkSession, query: str, path: str, strict: bool = False) -> int:
    """The count that a query text has over an NDJSON file. A pattern that holds a
    newline is counted over whole files, since it may straddle lines. ``strict``
    queries may ask for any field, numbers and strings."""
    if strict:
        predicate, fields = dialect.strict_query(query)
        numbers = T.json_unsigned(F.col("value"), *[f for f, kind in fields.items() if kind == "number"])
        texts = {f: F.get_json_object("value", f"$.{f}") for f, kind in fields.items() if kind == "text"}
        return count_where(ndjson.read_lines(spark, path).withColumns(numbers | texts), predicate).first().matches
    parsed = PLANS.get_or_make(query, dialect.parse_compat)
    if isinstance(parsed, dialect.Search):
        whole = "\n" in parsed.pattern
        texts = spark.read.text(path, wholetext=True) if whole else ndjson.read_lines(spark, path)
        return count_occurrences(texts, "value", parsed.pattern).first().matches
    lines = ndjson.read_lines(spark, path)
    if 0 < parsed.status < 1 << 63:  # else values of 2^63 and more must be told from missing ones
        big = T.json_unsigned(F.col("value"), "latency")["latency"]
        rows = ndjson.with_fields(lines, "status").withColumn("latency", T.defaulted(big))
    else:
        rows = lines.withColumns({f: T.defaulted(c) for f, c in T.json_unsigned(F.col("value"), "status", "latency").items()})
    return count_where(rows, parsed.column()).first().matches


def reconstruct(narrow: DataFrame, raw: DataFrame, predicate: Column, key: str = "row_id") -> DataFrame:
    """Original lines of matching rows: the filter runs over narrow columns, and
    only keys of matches meet the wide table. Spark broadcasts them when few."""
    return raw.join(narrow.filter(predicate).select(key), key, "left_semi")


def first_matches(rows: DataFrame, order: str = "row_id", n: int = 3) -> DataFrame:
    return rows.orderBy(order).limit(n)
