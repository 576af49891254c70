"""Reports about queries and storage."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from logspar.sources import files


@dataclass
class QueryStats:
    """Number of queries run and the longest one's seconds, on the driver's clock."""

    total: int = 0
    longest: float = 0.0
    seconds: list[float] = field(default_factory=list)

    def run(self, query: Callable[[], DataFrame]) -> list:
        began = time.perf_counter()
        rows = query().collect()
        took = time.perf_counter() - began
        self.total, self.longest = self.total + 1, max(self.longest, took)
        self.seconds.append(took)
        return rows


def storage(spark: SparkSession, raw: str, stored: str) -> dict[str, float]:
    """Bytes of a raw log and of what is stored of it, and their ratio; contents aren't read."""
    a, b = files.length(spark, raw), files.length(spark, stored)
    return {"raw_bytes": a, "stored_bytes": b, "ratio": a / max(1, b)}


def interpreted(spark: SparkSession, query: Callable[[], DataFrame]) -> list:
    """Rows of a query run without whole-stage code generation, to compare with."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return query().collect()
    finally:
        spark.conf.set(key, before)
