"""A typed log: Parquet columns with row-group metadata beside them.

Rows are range-sorted by number, in row groups with statistics and Bloom filters
of Parquet's own; ``zones`` and ``blooms`` are tables of the same facts for
groups of rows, written once, so that a query doesn't scan the log for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logspar.operators import rowgroups


@dataclass(frozen=True)
class LogStore:
    spark: SparkSession
    root: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/zones")

    def blooms(self, field: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/bloom_{field}")


def write(rows: DataFrame, root: str, zones: list[str], blooms: dict[str, int]) -> LogStore:
    """Write ``rows`` (with row_id and rg), zone maps of the fields ``zones`` and
    Bloom filters of those in ``blooms``, which gives distinct counts."""
    made = LogStore(rows.sparkSession, root)
    rowgroups.write_grouped(rows.repartitionByRange("row_id").sortWithinPartitions("row_id"), f"{root}/rows", blooms)
    rowgroups.zone_maps(made.rows(), zones).write.parquet(f"{root}/zones")
    for field in blooms:
        rowgroups.bloom_filters(made.rows(), field).write.parquet(f"{root}/bloom_{field}")
    return made
