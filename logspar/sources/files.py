"""Places and sizes of files, asked through the file system that Spark uses."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    found, system = _path(spark, path)
    return system.getContentSummary(found).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.delete(found, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is missing."""
    found, system = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(found)) if system.exists(found) else []


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The part files that Spark wrote to ``folder``, one after the other as the file ``target``.

    A part's place follows from the sizes of those before it, so on a mounted
    folder each task copies one part there, and one that runs again writes the
    same bytes. Elsewhere the driver's JVM copies them as a stream.
    """
    found, system = _path(spark, folder)
    sizes = {s.getPath().getName(): s.getLen() for s in system.listStatus(found)}
    number = {n: tuple(map(int, m.groups())) for n in sizes if (m := re.match(r"part-(\d+).*-c(\d+)", n))}
    places, end = [], 0
    for name in sorted(number, key=number.get):
        places.append((name, end))
        end += sizes[name]
    try:
        source, whole = mounted(folder), mounted(target)
    except ValueError:
        jvm = spark.sparkContext._jvm
        out = system.create(jvm.org.apache.hadoop.fs.Path(target))
        try:
            for name, _ in places:
                part = system.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
        return
    open(whole, "wb").close()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{source}/{name}", "rb") as part, open(whole, "r+b") as data:
                    data.seek(at)
                    shutil.copyfileobj(part, data, 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["parts"])

    if places:
        each = spark.sparkContext.parallelize(places, len(places))
        spark.createDataFrame(each, "name string, at bigint").mapInArrow(put, "parts bigint").agg({"parts": "sum"}).first()


def mark(spark: SparkSession, path: str) -> tuple:
    """Changes when what lies at ``path`` is replaced."""
    found, system = _path(spark, path)
    return path, system.getFileStatus(found).getModificationTime(), length(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new place under ``spark.checkpoint.dir``, which all executors share. Where
    that is unset, a temporary folder, in local mode only; it goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="logspar-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        root = "file://" + _LOCAL[app]
    return f"{root.rstrip('/')}/logspar/{label}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """``path`` for open(): a folder that driver and executors mount alike."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: block files are written in place, on a mounted folder; use blocks() and Parquet elsewhere")
    return path
