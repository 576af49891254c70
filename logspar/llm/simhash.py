r"""SimHash near-dedup by pigeonhole blocks.

Texts are lower-cased in A-Z, cut into words at ASCII white space, and shingled
by three words; the fingerprint's bits are the majority of the shingles' XXH64.
Two fingerprints link if at most MAX_BITS bits differ.

A 64-bit fingerprint is split into four blocks of 16 bits. Two that differ in at
most two bits agree in two whole blocks at least, so each fingerprint is filed
under its six pairs of blocks, and only those filed together can link.

Buckets of a few distinct fingerprints are joined with themselves and verified.
A bucket with more would make pairs by the square of its size, so its members go
another exact way: each is filed again under itself and its 64 one-bit
neighbours, since fingerprints within two bits of each other share such a
neighbour. A file of that kind has 65 members at most, and needs a link of each
member to its smallest and a check only of what can be chained that way: two
members of one file always differ in two bits at most.

Cases: a null, empty or blank text has fingerprint zero, linked like any other;
of few words, the whole sequence is one shingle; equal fingerprints link whatever
the texts; whole texts are used; repeated rows each get the same answer; an empty
table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import broadcast_if_small, connected_components, free_name, small_batches, spread_join, stage, stage_measured

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Distinct fingerprints in a bucket up to which its pairs are made.
PAIR_BUCKET = 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    # bytes.lower() changes A-Z alone; multi-byte characters hold no white space bytes.
    words = _WORDS((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: fp as the signed 64-bit integer with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of
    all pairs within MAX_BITS. ``fps`` has distinct ``fp``."""
    block = [F.expr(f"shiftrightunsigned(fp, {16 * k}) & 65535") for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.struct(F.lit(n).alias("which"), (F.shiftleft(block[i], 16) + block[j]).alias("key")) for n, (i, j) in enumerate(pairs)])
    filed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.key")
    counts = filed.groupBy("which", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(filed.join(counts, ["which", "key"]), "blocks")

    few = shared.filter(F.col("n") <= PAIR_BUCKET)
    other = few.select("which", "key", F.col("fp").alias("b"))
    near = few.select("which", "key", F.col("fp").alias("a")).join(other, ["which", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")

    hot = shared.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]))
    files = hot.select("fp", F.explode(around).alias("center")).groupBy("center").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    chained = files.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").select("a", "b")
    return near.unionAll(chained).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    Links are sought between distinct fingerprints, so copies cost nothing; each
    fingerprint knows its smallest document. A fingerprint that very many rows
    have, and a component of very many fingerprints, are spread over tasks.
    """
    with small_batches(docs.sparkSession):
        rows, seen = stage_measured(fingerprints(docs, id_col, text_col), "fingerprints", n=F.count("*"))
    least, distinct = stage_measured(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct-fp", n=F.count("*"))
    found = stage(connected_components(stage(links(least.select("fp")), "links")), "fp-components")
    joined = least.join(found, least["fp"] == found["node"]).select("fp", "least", "component")
    own = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    chained = spread_join(joined.select("fp", "component"), own, ["component"], "fps", distinct["n"], ["fp"]).select("fp", "component_id")
    whole = stage(least.join(chained, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "rows"), "components")
    return spread_join(rows, whole, ["fp"], "rows", seen["n"], ["doc_id"]).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; a null id stays.

    Rows that share that id all stay: they are told apart by nothing.
    """
    own = free_name(docs, "id")
    lost = stage(near_groups(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct(), "near-lost")
    return docs.join(broadcast_if_small(lost, 16), F.col(id_col) == F.col(own), "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
