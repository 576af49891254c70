"""Row-group metadata and scans pruned by it.

Parquet's own statistics and Bloom filters prune scans at no cost in code; these
tables make the same decisions visible and work across files. Pruning never
changes an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspar.plans.predicates import And, Eq, Node, may_match, row_filter

GROUP_ROWS = 65_536
BLOOM_BITS = 65_536
#: Surviving groups are listed in a filter up to this many.
MOST_LISTED = 1000


def group_id(row_id: str = "row_id", rows: int = GROUP_ROWS) -> Column:
    return F.call_function("div", F.col(row_id), F.lit(rows))


def zone_maps(rows: DataFrame, fields: list[str], group: str = "rg") -> DataFrame:
    """``rg, n`` and ``min_/max_/nulls_`` of each field; bounds of an all-null field are null."""
    stats = [x for f in fields for x in (F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}"), F.sum(F.col(f).isNull().cast("bigint")).alias(f"nulls_{f}"))]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *stats)


def presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Whether each field has a value in each block of a group."""
    return rows.groupBy("rg", "block").agg(*[F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields])


def _positions(key: Column) -> Column:
    """Two independent places of a key in a filter."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOOM_BITS)) + 1 for seed in (1, 2)])


def bloom_filters(rows: DataFrame, field: str, group: str = "rg") -> DataFrame:
    """``rg, bucket, bitmap``: two bitmaps of 4096 bytes for each group."""
    at = rows.filter(F.col(field).isNotNull()).select(group, F.explode(_positions(F.col(field))).alias("at"))
    return at.groupBy(group, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def bloom_contains(filters: DataFrame, key: str, group: str = "rg") -> DataFrame:
    """``rg, hit`` for groups with a filter: all places of the key are set. One aggregation, no join."""

    def is_set(at: Column) -> Column:
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring("bitmap", (F.call_function("div", place, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        bit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
        return F.max(F.when(F.col("bucket") == F.bitmap_bucket_number(at), bit).otherwise(F.lit(0).cast("bigint")))

    hits = [is_set(F.pmod(F.xxhash64(F.lit(key), F.lit(seed)), F.lit(BLOOM_BITS)) + 1) for seed in (1, 2)]
    return filters.groupBy(group).agg((F.least(*hits) == 1).alias("hit"))


def _texts(node: Node | None) -> list[tuple[str, str]]:
    """Fields and texts that a tree compares."""
    match node:
        case And(left, right):
            return _texts(left) + _texts(right)
        case Eq(field, str(value)):
            return [(field, value)]
    return []


def surviving_groups(meta: DataFrame, node: Node | None, blooms: dict[str, DataFrame] | None = None) -> DataFrame:
    """Groups whose zone maps, and Bloom filters by field, may match; what a group
    has no metadata for keeps it."""
    have = set(meta.columns)
    unknown = F.lit(None).cast("bigint")
    zone = lambda f: (F.col(f"min_{f}"), F.col(f"max_{f}")) if f"min_{f}" in have else (unknown, unknown)
    asked: dict[tuple[str, str], str] = {}
    for field, value in _texts(node):
        if field in (blooms or {}) and (field, value) not in asked:
            asked[field, value] = name = f"bloom_{len(asked)}"
            meta = meta.join(bloom_contains(blooms[field], value).withColumnRenamed("hit", name), "rg", "left")
    bloom = lambda f, v: F.col(asked[f, v]) if (f, v) in asked else F.lit(None).cast("boolean")
    return meta.filter(may_match(node, zone, bloom)).select("rg")


def pruned_scan(rows: DataFrame, meta: DataFrame, node: Node | None, blooms: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows that match, from groups that may.

    Few surviving groups become a filter that Parquet can skip row groups by, as
    does the predicate itself; many are joined.
    """
    kept = surviving_groups(meta, node, blooms)
    listed = [r.rg for r in kept.limit(MOST_LISTED + 1).collect()]
    some = rows.filter(F.col("rg").isin(listed)) if len(listed) <= MOST_LISTED else rows.join(kept, "rg", "left_semi")
    return some.filter(row_filter(node))


def write_grouped(rows: DataFrame, path: str, bloom: dict[str, int] | None = None, group_rows: int = GROUP_ROWS) -> None:
    """Parquet with row groups of ``group_rows`` rows and Bloom filters on some columns (with distinct counts)."""
    out = rows.write.option("parquet.block.row.count.limit", group_rows)
    for column, distinct in (bloom or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    out.parquet(path)
