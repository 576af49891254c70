"""Bit planes of 64-row blocks: plane b holds, at lane i, bit b of row i's value.

Queries filter plain columns, which is faster in Spark; planes exist for the
block format and for what is asked of planes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def planes(rows: DataFrame, value: str, bits: int = 64, name: str = "planes") -> DataFrame:
    """``block, planes, valid``: one partial aggregate a block; values are BIGINT, null counts as 0."""
    lane_bit = F.expr("shiftleft(1L, lane)")
    plane = [F.bit_or(F.when(F.getbit(F.coalesce(value, F.lit(0).cast("bigint")), F.lit(b)) == 1, lane_bit).otherwise(F.lit(0).cast("bigint"))) for b in range(bits)]
    return rows.groupBy("block").agg(F.array(*plane).alias(name), F.bit_or(lane_bit).alias("valid"))


def planes_of(rows: DataFrame, fields: dict[str, tuple[str, int]]) -> DataFrame:
    """``block, valid`` and, for each ``name: (value, bits)``, that value's planes: one aggregation for all."""
    lane_bit, none = F.expr("shiftleft(1L, lane)"), F.lit(0).cast("bigint")
    plane = lambda v, b: F.bit_or(F.when(F.getbit(F.coalesce(v, none), F.lit(b)) == 1, lane_bit).otherwise(none))
    made = [F.array(*[plane(F.col(v), b) for b in range(bits)]).alias(name) for name, (v, bits) in fields.items()]
    return rows.groupBy("block").agg(*made, F.bit_or(lane_bit).alias("valid"))


def group_planes(blocks: DataFrame, name: str = "planes", group_blocks: int = 1024) -> DataFrame:
    """``rg, bit, words``: each plane of a group of 65,536 rows as one row of 1024
    words, blocks without rows as zeros."""
    each = blocks.select(F.call_function("div", F.col("block"), F.lit(group_blocks)).alias("rg"), (F.col("block") % group_blocks).cast("int").alias("at"), F.posexplode(name).alias("bit", "word"))
    held = each.groupBy("rg", "bit").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("at"))
    words = F.transform(F.sequence(F.lit(0), F.lit(group_blocks - 1)), lambda i: F.coalesce(F.element_at("at", i), F.lit(0).cast("bigint")))
    return held.select("rg", "bit", words.alias("words"))


def _compare(plane: Column, value: int, bits: int, valid: Column) -> Column:
    """struct(above, same): lanes above ``value`` and lanes equal to it, folded
    over the planes from the highest bit down."""
    targets = F.array(*[F.lit(-(value >> b & 1)).cast("bigint") for b in range(bits)])
    zipped = F.reverse(F.arrays_zip(plane.alias("p"), targets.alias("t")))
    zero = F.struct(F.lit(0).cast("bigint").alias("above"), valid.alias("same"))
    step = lambda acc, x: F.struct(
        acc["above"].bitwiseOR(acc["same"].bitwiseAND(x["p"]).bitwiseAND(F.bitwise_not(x["t"]))).alias("above"),
        acc["same"].bitwiseAND(F.bitwise_not(x["p"].bitwiseXOR(x["t"]))).alias("same"),
    )
    return F.aggregate(zipped, zero, step)


def equal_mask(plane: Column, value: int, bits: int, valid: Column) -> Column:
    """Lanes whose value is ``value``; none if it needs more planes than there are."""
    return F.lit(0).cast("bigint") if value >> bits else _compare(plane, value, bits, valid)["same"]


def greater_mask(plane: Column, value: int, bits: int, valid: Column) -> Column:
    """Lanes whose value is above ``value``."""
    return F.lit(0).cast("bigint") if value >> bits else _compare(plane, value, bits, valid)["above"]


def match_count(blocks: DataFrame, mask: Column) -> DataFrame:
    return blocks.agg(F.coalesce(F.sum(F.bit_count(mask).cast("bigint")), F.lit(0)).alias("matches"))


def lanes(mask: Column) -> Column:
    """Lane numbers that a mask holds."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)


def values(blocks: DataFrame, name: str = "planes", out: str = "value") -> DataFrame:
    """``block, lane, value`` of the valid lanes, back from their planes."""
    return values_of(blocks, {out: name})


def values_of(blocks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``block, lane`` and, for each ``name: planes``, that value of the valid lanes: one pass for all."""
    bit = lambda p, lane, b: F.call_function("shiftleft", F.getbit(p, lane).cast("bigint"), b)
    rows = blocks.select("block", *fields.values(), F.explode(lanes(F.col("valid"))).alias("lane"))
    numbered = lambda name: F.arrays_zip(F.col(name).alias("p"), F.sequence(F.lit(0), F.size(name) - 1).alias("b"))
    value = lambda name: F.aggregate(numbered(name), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x["p"], F.col("lane"), x["b"])))
    return rows.select("block", "lane", *[value(name).alias(out) for out, name in fields.items()])


def plane_xor(blocks: DataFrame, name: str = "planes") -> DataFrame:
    """XOR of all words of all planes."""
    return blocks.agg(F.bit_xor(F.aggregate(name, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))).alias("plane_xor"))


def word_checksum(blocks: DataFrame, name: str = "planes") -> DataFrame:
    """Sum of all words as unsigned integers, modulo 2^64."""
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    word = F.explode(name).alias("w")
    unsigned = F.col("w").cast("decimal(38,0)") + F.when(F.col("w") < 0, two64).otherwise(F.lit(0))
    return blocks.select(word).agg((F.sum(unsigned.cast("decimal(28,0)")) % two64).cast("decimal(20,0)").alias("checksum"))
