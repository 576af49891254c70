"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry is resolved by one probe of a minimal
perfect hash. Any other is merged from bytes: a heap of candidate merges over a
doubly linked list of symbols, lowest rank first, leftmost among equals.

Cases: a null or empty text has no ids and decodes to no bytes; texts are encoded
whole, in memory proportional to the longest text of a slice; repeated rows are
encoded one by one; an empty table gives an empty result; only the two columns
named are read. Ids that the vocabulary lacks raise KeyError when decoded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import Memo

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens remembered by a worker before its memory of them starts anew.
MEMO = 400_000
#: Rows of an Arrow batch that are in Python objects at once.
SLICE = 256
_SEED = 7


class PerfectHash:
    """Minimal perfect hash by hash and displace over byte strings.

    ``n`` keys fill slots 0..n-1. Keys fall into ``n // 2`` buckets; from the
    fullest down, each bucket gets the first displacement that sends its keys to
    free slots. Buckets of one key are given the slots left over (as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k, _SEED)
            groups.setdefault(h % self.buckets, []).append((h >> 20, i))
        self.shift = [0] * self.buckets
        self.order = [-1] * n  # slot -> index of the key
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                break
            d = 1
            while True:
                slots = [self._mix(h, d) % n for h, _ in members]
                if len(set(slots)) == len(slots) and all(self.order[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, members, strict=True):
                self.order[s] = i
        free = (s for s in range(n) if self.order[s] < 0)
        for b, members in groups.items():
            if len(members) == 1:
                s = next(free)
                self.shift[b] = -s - 1
                self.order[s] = members[0][1]

    @staticmethod
    def _mix(h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 17

    def slot(self, key: bytes) -> int:
        """The slot of a key; of any other byte string, some slot."""
        h = xxhash.xxh64_intdigest(key, _SEED)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._mix(h >> 20, d) % self.n


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.slot_token = [tokens[i] for i in self.hash.order]
        self.slot_id = [ranks[t] for t in self.slot_token]
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        # Every way in which two entries make up a third, by the two ids.
        self.pair = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.findall = regex.compile(pattern).findall
        self.memo = Memo(self.piece)
        self.digits = Memo(str)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token by merging: a heap over linked symbols."""
        pair = self.pair.get
        ids = list(map(self.byte_id.__getitem__, raw))
        n = len(ids)
        # What the symbol at each place and the one after it would make: an id, which is also the rank, or -1.
        makes = [pair((a << 32) | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        # With the place below the rank, one integer orders the heap.
        heap = [(m << 32) | i for i, m in enumerate(makes) if m >= 0]
        if not heap:
            return ids
        makes.append(-1)
        heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            m, i = top >> 32, top & 0xFFFFFFFF
            if makes[i] != m:
                continue  # one of the two has been merged since
            j = right[i]
            ids[i], ids[j], makes[j] = m, -1, -1
            k = right[i] = right[j]
            makes[i] = -1
            if k < n:
                left[k] = i
                x = makes[i] = pair((m << 32) | ids[k], -1)
                if x >= 0:
                    heappush(heap, (x << 32) | i)
            k = left[i]
            if k >= 0:
                x = makes[k] = pair((ids[k] << 32) | m, -1)
                if x >= 0:
                    heappush(heap, (x << 32) | k)
        return [i for i in ids if i >= 0]

    def piece(self, token: str) -> bytes:
        """Packed ids of one pre-token."""
        raw = token.encode("utf-8", "surrogatepass")
        s = self.hash.slot(raw)
        return array("I", (self.slot_id[s],) if self.slot_token[s] == raw else self.merge(raw)).tobytes()

    def encode(self, text: str | None) -> list[int]:
        pieces = self.findall(text or "")
        if len(self.memo) > MEMO:
            self.memo.clear()
        return array("I", b"".join(map(self.memo.__getitem__, pieces))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    """One codec for each vocabulary file and worker process."""
    return Codec(path)


ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"


def _encoder(path: str, digests: bool, with_ids: bool):
    names = ["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"] * digests
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns: dict[str, list] = {k: [] for k in names}
                for text in part.column(1).to_pylist():
                    ids = own.encode(text)
                    columns["n_tokens"].append(len(ids))
                    if with_ids:
                        columns["ids"].append(np.array(ids, np.int32))
                    if digests:
                        columns["ids_sha256"].append(hashlib.sha256(" ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                        columns["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
                columns["doc_id"] = part.column(0)
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) if isinstance(v, list) else v for k, v in columns.items()], names=names)

    return run, ", ".join(f.strip() for f in ENCODED.split(",") if f.split()[0] in names)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` with ``ids`` and, if asked, digests of ids and decoded bytes.

    One pass over the input without a shuffle; memory is bounded by a slice of
    rows and the memo.
    """
    run, schema = _encoder(path, digests, with_ids)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, decoded`` (bytes) from ``doc_id, ids``; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            made = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False, digests=True)
