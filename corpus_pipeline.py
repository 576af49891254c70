"""A corpus pipeline out of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

Cases: documents with a null, empty or letterless text go in the first stage; a
null ``lang`` is filled there; a null id is an id below all others where copies
are dropped, never a near copy, and mixed and encoded like any other; rows that
repeat id and text count as one after the second stage; a null source is a source
of its own; an empty table gives an empty result; other columns, whatever their
names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspar.llm import bpe, exact_dedup, language_id, mixing, simhash
from logspar.llm.common import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the model knows go: without a letter, or with
    n-grams that are no likelier in the language found than by chance. A null
    ``lang`` gets the language found."""
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")))
    return language_id.drop_unknown(docs, model, fill="lang")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of their decoded bytes."""
    return bpe.encode_documents(docs, with_ids=True, digests=True)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprint components and learned languages have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None
