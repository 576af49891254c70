"""The bit-sliced block file and its byte-offset index.

A block is 64 rows: 64 little-endian 64-bit planes of each field, status then
latency. The index has one 64-bit byte offset for each lane. Neither has a
header; the last block is padded with zeros, so readers take a row count.
Parquet is the format to query; this one is for exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.operators import bitslice
from logspar.sources import files, ndjson

FIELDS = ("status", "latency")
PLANE_BYTES = 64 * 8


def blocks(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``block, data, offsets, n`` in file form, from ``block, lane, byte_offset`` and the fields."""
    lane_bit = F.expr("shiftleft(1L, lane)")
    zero = F.lit(0).cast("bigint")
    every = [F.bit_or(F.when(F.getbit(F.col(f), F.lit(b)) == 1, lane_bit).otherwise(zero)) for f in fields for b in range(64)]
    grouped = rows.groupBy("block").agg(F.array(*every).alias("words"), F.array_sort(F.collect_list(F.struct("lane", "byte_offset"))).alias("at"), F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(w, "<i8").tobytes() for w in batch.column(1).to_pylist()]
            offsets = []
            for at in batch.column(2).to_pylist():
                line = np.zeros(64, "<i8")
                line[[x["lane"] for x in at]] = [x["byte_offset"] for x in at]
                offsets.append(line.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(offsets, pa.binary()), batch.column(3)], names=["block", "data", "offsets", "n"])

    return grouped.mapInArrow(pack, "block bigint, data binary, offsets binary, n bigint")


def convert(spark: SparkSession, json_path: str, agb_path: str, fields: tuple[str, ...] = FIELDS) -> dict[str, int]:
    """Write one NDJSON file as ``agb_path`` and ``agb_path + '.idx'``.

    Malformed lines take no lane; a missing or unusable field is 0; unsigned
    values keep all 64 bits. A block's place in both files follows from its
    number, so every task writes its own blocks there, and a task that runs again
    writes the same bytes. Both paths must be on a folder that all executors
    mount. Returns the counts and sizes of what was written.
    """
    target = files.mounted(agb_path)
    lines = ndjson.with_unsigned(ndjson.numbered_lines(spark, json_path, documents=True), *fields)
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = lambda f: F.when(F.col(f) > F.lit(2**63 - 1).cast("decimal(20,0)"), F.col(f) - two64).otherwise(F.col(f)).cast("bigint")
    made = blocks(lines.select("block", "lane", "byte_offset", *[signed(f).alias(f) for f in fields]), fields)
    width = PLANE_BYTES * len(fields)
    for path in (target, target + ".idx"):
        open(path, "wb").close()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = n_blocks = 0
        with open(target, "r+b") as data, open(target + ".idx", "r+b") as index:
            for batch in batches:
                for block, words, offsets, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data.seek(block * width)
                    data.write(words)
                    index.seek(block * PLANE_BYTES)
                    index.write(offsets)
                    records, n_blocks = records + n, n_blocks + 1
        yield pa.RecordBatch.from_arrays([pa.array([records], pa.int64()), pa.array([n_blocks], pa.int64())], names=["records", "blocks"])

    done = made.mapInArrow(put, "records bigint, blocks bigint").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
    return {"records": done.records, "blocks": done.blocks, "data_bytes": done.blocks * width, "index_bytes": done.blocks * PLANE_BYTES}


def _pieces(spark: SparkSession, widths: dict[str, int], make: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """Records of so many bytes of each file: block numbers are dealt to tasks in ranges, and each batch of them is read at once."""
    sources = [(files.mounted(path), width) for path, width in widths.items()]
    path, width = next(iter(widths.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(source: str, width: int, ids: np.ndarray) -> bytes:
            with open(source, "rb") as data:
                data.seek(int(ids[0]) * width)
                return data.read(len(ids) * width)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if len(ids):
                yield make(ids, *[read(source, width, ids) for source, width in sources])

    return spark.range(files.length(spark, path) // width).mapInArrow(run, schema)


def read_blocks(spark: SparkSession, path: str, n_rows: int, fields: tuple[str, ...] = FIELDS, index: bool = False) -> DataFrame:
    """``block, valid`` and ``p_<field>`` planes; ``n_rows`` tells padding from rows.
    With ``index`` also the ``offsets`` of the lanes, from the index file beside it."""
    names = ["block", "valid", *(f"p_{f}" for f in fields), *["offsets"] * index]

    def unpack(ids: np.ndarray, data: bytes, offsets: bytes = b"") -> pa.RecordBatch:
        words = np.frombuffer(data, "<i8").reshape(len(ids), len(fields), 64)
        left = np.clip(n_rows - 64 * ids, 0, 64)
        valid = np.array([(1 << k) - 1 for k in left.tolist()], np.uint64).view(np.int64)
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 64)
        planes = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(words[:, k]).ravel())) for k in range(len(fields))]
        if index:
            planes.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(offsets, "<i8"))))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(valid), *planes], names=names)

    widths = {path: PLANE_BYTES * len(fields)} | ({path + ".idx": PLANE_BYTES} if index else {})
    return _pieces(spark, widths, unpack, "block bigint, valid bigint, " + ", ".join(f"{p} array<bigint>" for p in names[2:]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``block, lane, byte_offset``, padding included."""

    def unpack(ids: np.ndarray, data: bytes) -> pa.RecordBatch:
        lane = np.tile(np.arange(64, dtype=np.int32), len(ids))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 64)), pa.array(lane), pa.array(np.frombuffer(data, "<i8"))], names=["block", "lane", "byte_offset"])

    return _pieces(spark, {path: PLANE_BYTES}, unpack, "block bigint, lane int, byte_offset bigint")


def match_mask(status: int, latency: int) -> Column:
    """Lanes of read_blocks with this status and a latency above."""
    return bitslice.equal_mask(F.col("p_status"), status, 64, F.col("valid")).bitwiseAND(bitslice.greater_mask(F.col("p_latency"), latency, 64, F.col("valid")))


def reconstruct(spark: SparkSession, json_path: str, agb_path: str, n_rows: int, mask: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``byte_offset, value`` of the lines that a mask over planes selects.

    Planes and index of a block are read together, as both lie where its number
    says, so lanes of the mask give offsets without a join; these meet the raw lines.
    """
    hits = read_blocks(spark, agb_path, n_rows, fields, index=True).select("offsets", mask.alias("mask")).filter("mask <> 0")
    offsets = hits.select(F.explode(F.transform(bitslice.lanes(F.col("mask")), lambda lane: F.get("offsets", lane))).alias("byte_offset"))
    return ndjson.fetch_lines(spark, json_path, offsets)


def count_matches(spark: SparkSession, path: str, n_rows: int, status: int, latency: int) -> int:
    """Rows of a block file with this status and a latency above, by plane kernels."""
    return bitslice.match_count(read_blocks(spark, path, n_rows), match_mask(status, latency)).first().matches
