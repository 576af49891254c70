"""Language ID: multinomial naive Bayes over hashed character n-grams.

Cases: a null text, or one without a letter, is predicted ``und`` with score 0;
rows with a null label are not learned from; with no labelled row at all every
prediction is ``und``; a null id counts as empty text when rows are held out;
whole texts are used, long ones slice by slice; repeated rows count each time; an
empty table gives an empty result. Only the columns named are read. More than
MOST_LABELS labels are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import small_batches

#: n-gram features are hashed to 2 ** BITS columns.
BITS = 14
ORDERS = (2, 3)
SMOOTHING = 0.5
#: Characters scored at once.
CHUNK = 500_000
UNKNOWN = "und"
#: Labels that a model may have: each takes a row of 2 ** BITS counters in every task.
MOST_LABELS = 500
#: A text is rejected whose n-grams are less likely in its language than if all
#: columns were alike, by this mean of natural logarithms. (Prose has 1 to 4.5, a short
#: sentence around a long key down to -0.4, letters at random about -2.)
MIN_MARGIN = -1.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and how many each text has.

    Runs of characters other than letters act as blanks. Each text is followed by
    blanks enough that no n-gram reaches into the next one; n-grams that start
    with two blanks, or with a text's last one, get column 2 ** BITS, which weighs nothing.
    """
    pad = " " * max(ORDERS)
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((pad.join(lower) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    small = codes < 0x10000
    codes[small & ~_letters()[np.where(small, codes, 0)]] = 32
    n = np.array([len(t) for t in lower]) + len(pad)
    total = int(n.sum())
    tail = np.concatenate([codes, np.full(max(ORDERS), 32, np.uint32)])
    blank = (tail[:total] == 32) & (tail[1 : total + 1] == 32)
    blank[np.cumsum(n) - 1] = True  # the last blank of a text is next to the following text
    columns = []
    for order in ORDERS:
        h = np.full(total, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h = (h ^ tail[k : k + total]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        h[blank] = 1 << BITS
        columns.append(h)
    return np.stack(columns, axis=1), n


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Non-empty texts in chunks of about CHUNK characters, with their places."""
    at, some, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            if len(t) > CHUNK:  # a long text is a chunk of its own
                yield [i], [t]
                continue
            at.append(i)
            some.append(t)
            size += len(t)
            if size >= CHUNK:
                yield at, some
                at, some, size = [], [], 0
    if at:
        yield at, some


def count_columns(text: str) -> np.ndarray:
    """How often a text has each column: a long one in slices that reach as far
    into the next as an n-gram does."""
    low, more = text.lower(), max(ORDERS) - 1
    counts = np.zeros((1 << BITS) + 1, np.int64)
    for at in range(0, len(low), CHUNK):
        columns, _ = features([low[at : at + CHUNK + more]])
        counts += np.bincount(columns[: CHUNK if at + CHUNK < len(low) else None].ravel(), minlength=len(counts))
    return counts


@dataclass
class Model:
    languages: list[str]
    #: (2 ** BITS + 1, languages) log probabilities; the last row is 0.
    weights: np.ndarray
    prior: np.ndarray

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and the mean margin of its n-grams over chance."""
        names, scores, margins = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        if not self.languages:
            return names, scores, margins
        for at, some in _chunks(texts):
            if len(some) == 1 and len(some[0]) > CHUNK:
                counts = count_columns(some[0])
                likely, grams = (counts @ self.weights)[None, :], np.array([counts[:-1].sum()])
            else:
                columns, n = features(some)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                likely = sum(np.add.reduceat(self.weights[columns[:, k]], starts, axis=0) for k in range(columns.shape[1]))
                grams = np.add.reduceat((columns < 1 << BITS).sum(axis=1), starts)
            total = self.prior + likely
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            margin = likely[np.arange(len(best)), best] / np.maximum(grams, 1) + BITS * np.log(2)
            for i, t, b, s, m in zip(at, some, best, p, margin, strict=True):
                if any(map(str.isalpha, t)):
                    names[i], scores[i], margins[i] = self.languages[b], s, m
        return names, scores, margins

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from every labelled row.

    Each task counts into one dense matrix a language (2 ** BITS counters) and
    emits one row for it; these are summed in a second, smaller stage. What
    reaches the driver is at most 16 rows of 128 KB for each language.
    """
    width = (1 << BITS) + 1

    def emit(sums: dict[str, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([c.tobytes() for c, _ in sums.values()], pa.binary()), pa.array([d for _, d in sums.values()], pa.int64())], names=["lang", "counts", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for at, some in _chunks(batch.column(1).to_pylist()):
                if len(some) == 1 and len(some[0]) > CHUNK:
                    c, d = sums.get(labels[at[0]], (np.zeros(width, np.int64), 0))
                    sums[labels[at[0]]] = (c + count_columns(some[0]), d + 1)
                    continue
                columns, n = features(some)
                where = np.repeat(np.arange(len(some)), n)
                named = np.array([labels[i] for i in at], dtype=object)
                for lang in set(named):
                    mine = named == lang
                    found = np.bincount(columns[mine[where]].ravel(), minlength=width)
                    c, d = sums.get(lang, (np.zeros(width, np.int64), 0))
                    sums[lang] = (c + found, d + int(mine.sum()))
            if len(sums) > MOST_LABELS:
                raise ValueError(f"more than {MOST_LABELS} labels")
        yield emit(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for lang, counts, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c, n = sums.get(lang, (0, 0))
                sums[lang] = (c + np.frombuffer(counts, np.int64), n + d)
        yield emit(sums)

    schema = "lang string, counts binary, docs bigint"
    rows = docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    with small_batches(docs.sparkSession):
        parts = rows.mapInArrow(count, schema).repartition(16).mapInArrow(add, schema).collect()
    sums: dict[str, np.ndarray] = {}
    total: dict[str, int] = {}
    for r in parts:
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
        total[r.lang] = total.get(r.lang, 0) + r.docs
    languages = sorted(sums)
    if len(languages) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    weights = np.zeros((width, len(languages)))
    for k, lang in enumerate(languages):
        c = sums[lang][:-1] + SMOOTHING
        weights[:-1, k] = np.log(c) - np.log(c.sum())
    prior = np.log(np.array([total[x] for x in languages], float) / max(1, sum(total.values()))) if languages else np.zeros(0)
    return Model(languages, weights, prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (its columns must not include lang_pred or score) with both added."""
    if {"lang_pred", "score"} & {c.lower() for c in docs.columns}:
        raise ValueError("the table has a column lang_pred or score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5, min_margin: float = MIN_MARGIN, fill: str | None = None) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows: it is predicted
    with at least ``min_score``, and the text's n-grams are more likely in it than
    by chance, by a mean of at least ``min_margin``. Where the string column
    ``fill`` is null it gets the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    to = docs.columns.index(fill) if fill else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, margins = shared.value.judge(batch.column(at).to_pylist())
            known = np.array([n != UNKNOWN for n in names], bool) & (scores >= min_score) & (margins >= min_margin)
            if to is not None:
                column = batch.column(to)
                batch = batch.set_column(to, batch.schema.field(to), pc.coalesce(column, pa.array(names, column.type)))
            yield batch.filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str) -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows not held out."""
    out = held_out(id_col)
    model = fit(docs.filter(~out), text_col, label_col)
    return predict(docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text")), model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
