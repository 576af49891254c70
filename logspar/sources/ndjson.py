"""NDJSON logs: lines with their row number and byte offset, and typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspar.functions import log_text as T
from logspar.sources import files

CHUNK_LINES = 1 << 14


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line. A missing path raises; an empty file has no rows.
    Only a newline ends a line, so that byte offsets hold for CRLF files."""
    return spark.read.option("lineSep", "\n").text(path)


def write_file(lines: DataFrame, order: str, path: str) -> None:
    """``value`` of every row as the lines of one file, by ``order``. Each task sorts and
    writes one range of the order; the parts are then joined without being sorted again."""
    spark, parts = lines.sparkSession, f"{path}-parts"
    lines.orderBy(order).select("value").write.option("lineSep", "\n").option("compression", "none").text(parts)
    files.join_parts(spark, parts, path)
    files.delete(spark, parts)


def numbered_lines(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """``value, path, row_id, block, lane, byte_offset``, counted within each file.

    With ``documents`` malformed lines take no number and are left out, and the
    offset is that of the document, after blanks that lead its line.

    Each chunk of CHUNK_LINES lines of an input split is counted first (one small
    row a chunk); a running total over the chunks gives their starts, and a window
    inside a chunk, which is the same size however large a split is, does the rest.
    """
    lines = read_lines(spark, path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    lines = lines.withColumn("chunk", T.whole_quotient(F.col("place"), CHUNK_LINES)).withColumn("counts", is_document(F.col("value")) if documents else F.lit(True))
    size, one = F.octet_length("value") + 1, F.col("counts").cast("int")
    chunks = lines.groupBy("path", "split", "chunk").agg(F.sum(one).alias("rows"), F.sum(size).alias("bytes"))
    earlier = W.partitionBy("path").orderBy("split", "chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = chunks.select("path", "split", "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"))
    before = W.partitionBy("path", "split", "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("i", F.coalesce(F.sum(one).over(before), F.lit(0))).withColumn("b", F.coalesce(F.sum(size).over(before), F.lit(0))).filter("counts")
    offset = F.col("byte0") + F.col("b") + (T.leading_blanks(F.col("value")) if documents else F.lit(0))
    joined = placed.join(starts, ["path", "split", "chunk"]).select("value", "path", (F.col("row0") + F.col("i")).alias("row_id"), offset.alias("byte_offset"))
    return joined.select("value", "path", "row_id", T.block(F.col("row_id")).alias("block"), T.lane(F.col("row_id")).alias("lane"), "byte_offset")


def is_document(value: Column) -> Column:
    """Whether a line holds one JSON object."""
    return F.coalesce(F.get_json_object(value, "$").startswith("{"), F.lit(False))


def with_fields(lines: DataFrame, *fields: str, default_zero: bool = True) -> DataFrame:
    """Add unsigned fields of ``value``: 0 where missing or unusable, or null if not ``default_zero``.
    Malformed lines stay; their fields are missing."""
    made = T.json_bigint(F.col("value"), *fields)
    return lines.withColumns({f: T.defaulted(c) if default_zero else c for f, c in made.items()})


def with_unsigned(lines: DataFrame, *fields: str) -> DataFrame:
    """Add unsigned fields of ``value`` as DECIMAL(20,0), 0 where missing or unusable."""
    return lines.withColumns({f: T.defaulted(c) for f, c in T.json_unsigned(F.col("value"), *fields).items()})


def drop_malformed(lines: DataFrame) -> DataFrame:
    """Lines that hold one JSON object."""
    return lines.filter(is_document(F.col("value")))


def staged_batch(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A batch of lines held in memory."""
    return spark.createDataFrame([(x,) for x in lines], "value string")


def recover_log(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """Lines of a write-ahead file: empty ones go, then one trailing CR; a lone CR
    stays as an empty line. With ``batches``, of these folders of ``path``, and their numbers."""
    if batches is None:
        lines, also = read_lines(spark, path), []
    else:
        lines, also = spark.read.option("lineSep", "\n").option("basePath", path).text([f"{path}/batch={b}" for b in batches]), [F.col("batch").cast("int").alias("batch")]
    return lines.filter("value <> ''").select(*also, T.strip_carriage_return(F.col("value")).alias("value"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of each file, without reading contents."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def fetch_lines(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """``byte_offset, value`` of the documents of one file that start at ``offsets``.

    An equi-join on the offset. Spark broadcasts the offsets where they are few,
    and then the lines stay where they are read.
    """
    lines = numbered_lines(spark, path, documents=True).select("byte_offset", F.substring("value", T.leading_blanks(F.col("value")) + 1, F.length("value")).alias("value"))
    return lines.join(offsets.select("byte_offset"), "byte_offset", "left_semi")
