"""Token ids in a content-addressed store.

A store is a folder of three Parquet tables:

* ``chunks``: ``hash`` (SHA-256 of the bytes), ``n``, ``ids`` (little-endian
  unsigned 16-bit integers, or 32-bit where the vocabulary needs it), each
  distinct chunk once;
* ``recipes``: in ascending ``doc_id`` order by folder (``part=N``) and row,
  ``doc_id, start, n_tokens, root`` and ``chunks``, the hashes that make up the
  document in order, with their ``sizes``;
* ``manifest``: one row for each recipe folder, the Merkle root over its
  documents' roots; ``store_root`` folds these into one.

Chunk borders are set by the ids themselves: a rolling hash over WINDOW ids ends
a chunk where its low bits are zero, so an insertion changes few chunks.

Cases: a null or empty text is its end id alone; ids are those of the whole text;
rows with a null ``doc_id`` come first; rows that repeat a ``doc_id`` are kept
one by one, ordered by content; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import Memo, running_sum, scratch_path, shuffle_partitions, small_batches, stage, unstage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Rolling hash: ids it spans, mean chunk in ids (a power of two), least and most.
WINDOW, MEAN, LEAST, MOST = 8, 512, 128, 4096
#: Words a worker remembers, and chunk hashes it knows it has written, before either starts anew.
MEMO = 700_000
SEEN = 200_000
#: Rows that are in Python objects at once.
SLICE = 256


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte value -> the printable letter that byte-level BPE uses for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


# The rules of the vocabulary files that are encoded word by word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
SUFFIX = "</w>"


class WordEncoder:
    """Whole-text encoding by the tokenizers library, word by word.

    The tokenizer drops white space and never joins what it separates, so a text
    is encoded by encoding its words. A word is cut as the file's pattern cuts
    it, and the library's BPE model encodes each distinct piece once. Words with
    characters beyond the Latin blocks go through the library's whole encoder. So
    does every text if the vocabulary file has other rules than RULES.

    A text may hold the string of an added token, such as an end mark. With
    ``plain`` it is encoded like any other; without, as the library does by
    default, it gives that token's id.
    """

    def __init__(self, path: str, plain: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.model = self.whole.model
        rules = json.loads(self.whole.to_str())
        self.by_word = all(rules.get(k) == v for k, v in RULES.items()) and rules["model"]["type"] == "BPE" and rules["model"]["end_of_word_suffix"] == SUFFIX
        self.cut = regex.compile(SPLIT).findall
        # str.split() takes four control characters for white space, the tokenizer doesn't; added tokens are found in whole texts, by what they begin with.
        begin = {t.content[:2] for t in self.whole.get_added_tokens_decoder().values() if not (plain and t.special)}
        self.by_word &= all(x.isascii() and x.lower() == x.upper() for x in begin)  # the same in any case
        self.unlike_words = ("\x1c", "\x1d", "\x1e", "\x1f", *begin)
        self.table = _byte_letters()
        self.wide = self.whole.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        self.end = self.pack([END_ID])
        self.words = Memo(self.word)
        self.mark = lru_cache(maxsize=None)(self.piece)

    def shown(self, p: str) -> str:
        """A piece in the letters that stand for its bytes."""
        return p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.table)

    def piece(self, p: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(self.shown(p))])

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, w: str) -> bytes:
        if not w.isascii() and (max(w) > "ɏ" or not unicodedata.is_normalized("NFC", w)):
            return self.pack(self.whole.encode(w, add_special_tokens=False).ids)
        low = w.lower()
        if low.isalpha():
            return self.piece(low) if low == w else self.words[low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self.words[low[:-1]] + self.mark(low[-1])
        return b"".join([self.words[p] if p.isalpha() else self.mark(p) if len(p) == 1 else self.piece(p) for p in self.cut(low)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text and the end id, packed in 16 bits, or 32 for a large vocabulary."""
        text = text or ""
        if not self.by_word or any(x in text for x in self.unlike_words):
            return self.pack([*self.whole.encode(text, add_special_tokens=False).ids, END_ID])
        words = text.split()
        memo = self.words
        if len(memo) > MEMO:
            memo.clear()
        return b"".join(map(memo.__getitem__, words)) + self.end


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, plain: bool = True) -> WordEncoder:
    return WordEncoder(path, plain)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash would end a chunk.

    Documents may follow each other in ``ids``: the hash reaches back WINDOW ids,
    and no chunk ends that close to a document's start.
    """
    n = len(ids)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        h[k:] += x[: n - k] * np.uint64(0x100000001B3 ** (k + 1) % (1 << 64))
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(MEAN - 1)) == 0) + 1


def borders(n: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, from its marked places."""
    cuts, last = [], 0
    for c in marked:
        while c - last > MOST:
            last += MOST
            cuts.append(last)
        if c - last >= LEAST:
            last = c
            cuts.append(last)
    while n - last > MOST:
        last += MOST
        cuts.append(last)
    if last < n:
        cuts.append(n)
    return cuts


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node moves up as it is."""
    level = hashes or [b""]
    level = [hashlib.sha256(b"\0" + h).digest() for h in level]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cutter(path: str, plain: bool):
    names = ["doc_id", "n_tokens", "root", "chunks", "sizes", "fresh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(path, plain), set()
        kind = np.dtype("<u4" if own.wide else "<u2")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, new, ends = [[] for _ in names[1:-1]], ([], [], []), [0]
                encoded = list(map(own.encode, part.column(1).to_pylist()))
                marked, base = marks(np.frombuffer(b"".join(encoded), kind)), 0
                for data in encoded:
                    n = len(data) // kind.itemsize
                    here = marked[np.searchsorted(marked, base, "right") : np.searchsorted(marked, base + n, "right")] - base
                    base += n
                    start, hashes, sizes = 0, [], []
                    for end in borders(n, here.tolist()):
                        chunk = data[start * kind.itemsize : end * kind.itemsize]
                        h = hashlib.sha256(chunk).digest()
                        hashes.append(h)
                        sizes.append(end - start)
                        if h not in seen:
                            seen.add(h)
                            new[0].append(h)
                            new[1].append(end - start)
                            new[2].append(chunk)
                        start = end
                    if len(seen) > SEEN:
                        seen.clear()
                    ends.append(len(new[0]))
                    for column, value in zip(rows, (n, merkle(hashes), hashes, sizes), strict=True):
                        column.append(value)
                fresh = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(new, (pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["hash", "n", "ids"]))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True)), fresh], names=names)

    return run


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, plain: bool = True) -> None:
    """Encode ``docs`` and write a store at ``path``; ``plain`` as for WordEncoder.

    Each text is encoded once. A task leaves out chunks it has just written;
    what is left is dealt by hash and each hash written once, so a chunk that a
    third of all documents share moves at most once for each task. Recipes,
    without ids, are range-sorted once; their starts are two-level prefix sums,
    and each range is written as a folder that has its row of the manifest.
    """
    schema = "doc_id bigint, n_tokens bigint, root binary, chunks array<binary>, sizes array<int>, fresh array<struct<hash:binary,n:int,ids:binary>>"
    with small_batches(docs.sparkSession):
        cut = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cutter(vocabulary, plain), schema), "cut")
    cut.select(F.explode("fresh").alias("c")).select("c.*").dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    keyed = cut.select("doc_id", "n_tokens", "root", "chunks", "sizes", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_ls_order"), F.col("doc_id").isNotNull().alias("_ls_has"))
    placed = running_sum(keyed, [], ["_ls_has", "_ls_order", "root"], "n_tokens", "start", part="part")
    ordered = placed.sortWithinPartitions("part", "start").select("part", "doc_id", "start", "n_tokens", "root", "chunks", "sizes")
    ordered.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/recipes")
    unstage(cut)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = [], None
        for batch in batches:
            for part, start, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    made.append((start, []))
                    at = part
                made[-1][1].append(root)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.int64()), pa.array([len(r) for _, r in made], pa.int64()), pa.array([merkle(r) for _, r in made], pa.binary())], names=["first_start", "n_docs", "root"])

    recipes = docs.sparkSession.read.schema("start bigint, root binary, part int").parquet(f"{path}/recipes").select("part", "start", "root")
    recipes.repartition("part").sortWithinPartitions("part", "start").mapInArrow(fold, "first_start bigint, n_docs bigint, root binary").write.parquet(f"{path}/manifest")


def store_root(spark: SparkSession, path: str) -> bytes:
    """One root over the manifest, which has a row for each recipe partition."""
    return merkle([r.root for r in spark.read.parquet(f"{path}/manifest").orderBy("first_start").collect()])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """All recipes; none, of the same schema, if the store has no document."""
    return spark.read.schema("doc_id bigint, start bigint, n_tokens bigint, root binary, chunks array<binary>, sizes array<int>").parquet(f"{path}/recipes")


def _manifest_check(spark: SparkSession, path: str, like: str) -> DataFrame:
    """No rows, of schema ``like``; an error if recipes differ from the manifest.

    Each manifest row is dealt with the recipes from its first start up to the
    next one's, whose number and root are made anew.
    """
    try:
        manifest = spark.read.parquet(f"{path}/manifest").orderBy("first_start").collect()
    except AnalysisException:  # without the table nothing vouches for the recipes
        manifest = []
    firsts = np.array([r.first_start for r in manifest], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.searchsorted(firsts, batch.column(0).to_numpy(zero_copy_only=False), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), batch.column(0), batch.column(1)], names=["k", "start", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, roots = None, []

        def settle() -> None:
            if at is not None and (at < 0 or len(roots) != manifest[at].n_docs or merkle(roots) != bytes(manifest[at].root)):
                raise ValueError(f"the store can't be rebuilt: recipes of manifest row {at} differ from it")

        for batch in batches:
            for k, start, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    settle()
                    at, roots = k, []
                if start is not None:
                    roots.append(root)
        settle()
        yield from ()

    kind = "k bigint, start bigint, root binary"
    every = spark.createDataFrame([(k, None, None) for k in range(len(manifest))], kind)
    placed = _recipes(spark, path).select("start", "root").mapInArrow(place, kind).unionAll(every)
    return placed.repartition(shuffle_partitions(spark), "k").sortWithinPartitions("k", "start").mapInArrow(compare, like)


_CRC_POLY = 0xEDB88320


@lru_cache(maxsize=4096)
def _zeros(n: int) -> tuple[int, ...]:
    """The linear map on a CRC-32 register that n zero bytes make, as columns."""
    if n == 1:
        columns = []
        for bit in range(32):
            v = 1 << bit
            for _ in range(8):
                v = (v >> 1) ^ (_CRC_POLY if v & 1 else 0)
            columns.append(v)
        return tuple(columns)
    half = _zeros(n // 2)
    out = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_zeros(1), c) for c in out) if n % 2 else out


def _apply(columns: tuple[int, ...], v: int) -> int:
    out = 0
    while v:
        low = v & -v
        out ^= columns[low.bit_length() - 1]
        v ^= low
    return out


def crc_join(a: int, b: int, n_b: int) -> int:
    """CRC-32 of two byte strings joined, from theirs and the second's length."""
    return _apply(_zeros(n_b), a) ^ b if n_b else a


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For each power of two up to 2^39, what so many zero bytes make of each byte of a CRC register."""
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        columns = np.array(_zeros(1 << k), np.uint32)
        for byte in range(4):
            for bit in range(8):
                tables[k, byte, np.arange(256) >> bit & 1 == 1] ^= columns[8 * byte + bit]
    return tables


def crc_of_pieces(crc: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings out of their pieces' CRCs and sizes; ``start`` has the first piece of each."""
    ends = np.cumsum(size)
    last = ends[np.append(start[1:], len(size)) - 1]
    after = np.repeat(last, np.diff(np.append(start, len(size)))) - ends
    moved, tables = crc.astype(np.uint32), _shifts()
    for k in range(int(after.max(initial=0)).bit_length()):
        at = np.flatnonzero(after >> k & 1)
        v = moved[at]
        moved[at] = tables[k, 0, v & 255] ^ tables[k, 1, v >> 8 & 255] ^ tables[k, 2, v >> 16 & 255] ^ tables[k, 3, v >> 24]
    return np.bitwise_xor.reduceat(moved, start) if len(start) else moved[:0]


def _checked(h: bytes, n: int, ids: bytes) -> bytes:
    """A chunk's ids as little-endian unsigned 32-bit bytes, if its address is right."""
    if hashlib.sha256(ids).digest() != h:
        raise ValueError(f"chunk {h.hex()} does not hold what its address says")
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()


def read_chunks(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``hash, n`` and verified ``ids`` in 32 bits each, or their CRC-32 as ``crc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = (_checked(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            made = pa.array([zlib.crc32(x) for x in wide], pa.int64()) if digest else pa.array(list(wide), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["hash", "n", "crc" if digest else "ids"])

    return spark.read.parquet(f"{path}/chunks").select("hash", "n", "ids").mapInArrow(run, "hash binary, n int, " + ("crc bigint" if digest else "ids binary"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` rebuilt from recipes and chunks.

    Pieces meet by (document, position); only one document's ids, never a
    chunk's users, come together in one row. Recipes that differ from the manifest raise an error.
    """
    recipes = _recipes(spark, path)
    pieces = recipes.select("start", F.posexplode("chunks").alias("i", "hash")).join(read_chunks(spark, path), "hash")
    joined = pieces.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return recipes.join(joined, "start").select("doc_id", "start", "n_tokens", ids.alias("ids")).unionAll(_manifest_check(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids binary"))


def verify_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files, with checks.

    Every chunk is read, compared with its address and reduced to a CRC-32 where
    it lies; documents are put together from the CRCs of their chunks, so no
    ids are shuffled. A missing chunk, a recipe whose root or length differs
    from its chunks', recipes that differ from the manifest, raise an error.
    """
    crcs = read_chunks(spark, path, digest=True)
    recipes = _recipes(spark, path)
    used = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("i", "hash"))
    met = used.join(crcs, "hash", "left").groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.min("root").alias("root"), F.array_sort(F.collect_list(F.struct("i", "hash", "n", "crc"))).alias("p"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch.column(4).flatten()
            hashes, n, crc = pieces.field(1).to_pylist(), pieces.field(2), pieces.field(3)
            if n.null_count:
                raise ValueError("the store can't be rebuilt: it lacks a chunk")
            size = n.to_numpy(zero_copy_only=False).astype(np.int64)
            count = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(count) - count
            total = np.add.reduceat(size, start)
            for doc, n_tokens, root, at, k, real in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), start.tolist(), count.tolist(), total.tolist(), strict=True):
                if merkle(hashes[at : at + k]) != root or real != n_tokens:
                    raise ValueError(f"document {doc} can't be rebuilt from its chunks")
            out = crc_of_pieces(crc.to_numpy(zero_copy_only=False), 4 * size, start).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return met.select("doc_id", "start", "n_tokens", "root", "p").mapInArrow(check, kind).unionAll(_manifest_check(spark, path, kind))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of all documents, read back; ids are the library's with its default settings."""
    path = scratch_path(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, plain=False)
    return verify_documents(spark, path)
