"""Stream ingest: raw lines are staged and turned into typed rows batch by batch.

Structured Streaming's checkpoint is the write-ahead log. Each micro-batch is
written to its own folder, overwritten if the batch is replayed, so a restart
loses and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logspar.functions import log_text as T
from logspar.sources import files, ndjson
from logspar.streaming import wal

BATCH_LINES = 1000


def typed(lines: DataFrame) -> DataFrame:
    """Raw lines with typed columns beside them; nulls stay null in storage."""
    value = F.col("value")
    return ndjson.with_fields(lines, "status", "latency", default_zero=False).withColumn("trace_id", T.quoted_string(value, "trace_id"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = typed, files_per_trigger: int = 1000) -> StreamingQuery:
    """Take all lines that ``source`` has now and stop; call again for later files.

    Batches lie under the id that the checkpoint gives the query, so one with a
    new or lost checkpoint never overwrites what another has written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        make(batch).write.mode("overwrite").parquet(f"{target}/run={run}/batch_id={batch_id}")

    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", "\n").text(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_lines(spark: SparkSession, lines: Iterable[str], target: str, log: str, batch_lines: int = BATCH_LINES) -> int:
    """Take lines from an iterator, such as standard input, in batches.

    Each batch is logged, stored as typed rows in a folder of its own, and
    truncated from the log. What an earlier run left in the log is stored first.
    """
    next_id = _resume(spark, target, log)
    total, source = 0, iter(lines)
    while batch := list(islice(source, batch_lines)):
        held = ndjson.staged_batch(spark, [x.rstrip("\n") for x in batch])
        wal.append(held, log, next_id)
        _store(held, target, log, next_id)
        total, next_id = total + len(batch), next_id + 1
    return total


def ingest_numbered(spark: SparkSession, lines: DataFrame, target: str, log: str, batch_lines: int) -> int:
    """The same for ``row_id, value``, lines of a table numbered from 0: tasks log
    and store them, and none passes through the driver."""
    next_id, staged = _resume(spark, target, log), files.scratch(spark, "numbered")
    part = T.whole_quotient(F.col("row_id"), batch_lines)
    lines.select("value", part.alias("part")).write.partitionBy("part").parquet(staged)
    total = 0
    for k in sorted(int(f[5:]) for f in files.folders(spark, staged) if f.startswith("part=")):
        held = spark.read.schema("value string").parquet(f"{staged}/part={k}")
        wal.append(held, log, next_id)
        _store(held, target, log, next_id)
        total, next_id = total + held.count(), next_id + 1
    files.delete(spark, staged)
    return total


def _store(batch: DataFrame, target: str, log: str, batch_id: int) -> None:
    typed(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    wal.truncate(batch.sparkSession, log, batch_id)


def _resume(spark: SparkSession, target: str, log: str) -> int:
    """Store what an earlier run left in the log; the number of the next batch."""
    done = [int(f[9:]) for f in files.folders(spark, target) if f.startswith("batch_id=")]
    pending = wal.pending(spark, log)
    for left in pending:
        _store(wal.recover(spark, log).filter(F.col("batch") == left).select("value"), target, log, left)
    return max([-1, *done, *pending]) + 1


def ingest_parquet(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """The same for typed rows that are Parquet already."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``staged, stored, depth``: lines taken in, rows stored, and the rest."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(staged, "staged").join(F.broadcast(count(stored, "stored"))).select("staged", "stored", (F.col("staged") - F.col("stored")).alias("depth"))  # one row each


def batches(rows: DataFrame, row_id: str = "row_id", lines: int = BATCH_LINES) -> DataFrame:
    """``batch, n``: rows in batches of ``lines``, the last one partial."""
    return rows.groupBy(T.whole_quotient(F.col(row_id), lines).alias("batch")).agg(F.count("*").alias("n"))
