"""Shared plumbing of the training-data operators: staged tables, prefix sums
over a range-sorted table, and connected components.

Nothing here keeps state on one machine: what must survive a lost executor is
written as Parquet under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}
#: A table is broadcast up to this size, by its counted rows.
BROADCAST_BYTES = 32 << 20


class Memo(dict):
    """Values of a function, found by item access and made where they are missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, in local mode only: on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="logspar-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return "file://" + _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/logspar/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows, for jobs run inside that carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logspar_path = path
    return out


def stage_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``stage`` with aggregates of ``df`` that the writing job takes along."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), label)
    return out, seen.get


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_logspar_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, label: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, have = f"_ls_{label}", {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, part: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one, in
    ``order`` within ``group`` (columns without nulls; ``group`` may be empty).
    With ``part``, also the number of the range that a row is in; one task has
    the whole of a range.

    Two levels, so that no group need fit in one task: rows are range-sorted
    into partitions, the partitions' sums (one row for each partition and group
    in it) get their own prefix sum, and a window inside each partition does the
    rest. A hot group is spread over many partitions.
    """
    pid, own, offset = "_ls_pid", "_ls_own", "_ls_offset"
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *group, *order).withColumn(pid, F.spark_partition_id())
    table = stage(ranged, "ranged")
    sums = table.groupBy(pid, *group).agg(F.sum(value).alias(own))
    before = W.partitionBy(*group).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(pid, *group, F.coalesce(F.sum(own).over(before), F.lit(0)).alias(offset))
    if not group:
        offsets = F.broadcast(offsets)  # one row for each partition
    inside = W.partitionBy(pid, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        table.withColumn(own, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [pid, *group])
        .withColumn(out, F.col(own) + F.col(offset))
        .drop(own, offset)
        .withColumnsRenamed({pid: part} if part else {})
        .drop(pid)
    )


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to be broadcast if its counted rows of about ``row_bytes`` fit BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread_join(big: DataFrame, right: DataFrame, key: list[str], n: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``right``, which has one row a key and, in column ``n``,
    at least how many of the ``total`` rows of ``big`` have that key.

    A key with more than a quarter of an even partition's rows is hot: its rows are
    dealt to several tasks by a hash of the columns ``by``, and its row of ``right``
    is copied to each. Hot keys are broadcast; no more than 4 for each partition
    can exist, or one for 64 rows of a small table.
    """
    limit = max(64, total // (4 * shuffle_partitions(big.sparkSession)))
    pieces = F.greatest(F.ceil(F.col(n) / limit), F.lit(1)).cast("long")
    hot = right.filter(F.col(n) > limit).select(*key, pieces.alias("_ls_pieces"))
    salted = big.join(F.broadcast(hot), key, "left").withColumn("_ls_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_ls_pieces")), F.lit(0).cast("long"))).drop("_ls_pieces")
    copied = right.withColumn("_ls_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return salted.join(copied, [*key, "_ls_salt"], how).drop("_ls_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected
    Components in MapReduce and Beyond"), until a round changes nothing. Every
    round is two aggregations and two equi-joins over the edges, in which a node
    with very many edges is spread over tasks, written to the shared folder;
    nothing is collected but a count and a checksum. Nodes in no edge, or only in
    an edge to themselves, are not returned.
    """
    measures = {"n": F.count("*"), "mark": F.expr("bit_xor(xxhash64(a, b))")}
    first = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    cur, seen = stage_measured(first, "cc", **measures)
    before = None
    while seen["n"] and seen != before:
        before = seen
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, ["u"], "n", 2 * seen["n"], ["v"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", seen["n"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        nxt, seen = stage_measured(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "cc", **measures)
        unstage(cur)
        cur = nxt
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
