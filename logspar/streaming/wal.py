"""A write-ahead log of raw lines, one folder for each batch.

Appending a batch again replaces it, and truncating names the batches that are
stored, so a crash between the two repeats no line and loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspar.sources import files, ndjson


def append(lines: DataFrame, path: str, batch: int) -> None:
    """Log the ``value`` of every line as batch ``batch``."""
    lines.select("value").write.mode("overwrite").option("lineSep", "\n").text(f"{path}/batch={batch}")


def truncate(spark: SparkSession, path: str, batch: int | None = None) -> None:
    """Drop one batch, or all of them."""
    files.delete(spark, path if batch is None else f"{path}/batch={batch}")


def pending(spark: SparkSession, path: str) -> list[int]:
    """Batches that are logged whole and not yet truncated."""
    return sorted(int(f[6:]) for f in files.folders(spark, path) if f.startswith("batch=") and files.exists(spark, f"{path}/{f}/_SUCCESS"))


def recover(spark: SparkSession, path: str) -> DataFrame:
    """``batch, value`` of what is pending: empty lines go, then one trailing CR."""
    held = pending(spark, path)
    if not held:
        return spark.createDataFrame([], "batch int, value string")
    return ndjson.recover_log(spark, path, batches=held)
