"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Cases: a null text counts as empty, so all null and empty texts are one group.
Of equal texts the row with the largest ``doc_id`` stays; a null ``doc_id`` is
below every other. Rows that repeat both text and ``doc_id`` keep exactly one.
An empty table gives an empty result. Columns other than id and text are not
read, whatever their names; those that ``drop_copies`` adds for itself get names
that the table lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import broadcast_if_small, free_name, spread_join, stage, stage_measured

#: Code points of the prefix that the second round hashes.
PREFIX_CHARS = 64


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _survivors(keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys that more than one row has, broadcast only if few enough."""
    return broadcast_if_small(stage(keys.groupBy(*by).agg(F.count("*").alias("_ls_n")).filter("_ls_n > 1").drop("_ls_n"), "survivors"), 32)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their length and prefix hash, and the (length, prefix) keys that repeat.

    Each round reads the table again and narrows it by a semi-join with what
    survived: the first hashes nothing, the second hashes a prefix of rows whose
    length repeats. Only keys are shuffled, never texts.
    """
    text = _text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_ls_text"), F.octet_length(text).cast("long").alias("_ls_len"))
    lengths = _survivors(rows.select("_ls_len"), ["_ls_len"])
    prefixed = rows.withColumn("_ls_prefix", F.xxhash64(F.substring("_ls_text", 1, PREFIX_CHARS)))
    return prefixed, _survivors(prefixed.join(lengths, "_ls_len", "left_semi").select("_ls_len", "_ls_prefix"), ["_ls_len", "_ls_prefix"])


def exact_groups(prefixed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, _ls_len, _ls_sha`` of each row whose length and prefix repeat.

    The third round: whole contents are hashed for these rows alone. Groups are
    counted with map-side partial aggregation; a group of any size is dealt to as
    many tasks as its share of the rows asks for.
    """
    hashed = prefixed.join(prefixes, ["_ls_len", "_ls_prefix"], "left_semi").select("doc_id", "_ls_len", F.sha2("_ls_text", 256).alias("_ls_sha"))
    full, seen = stage_measured(hashed, "full-hash", n=F.count("*"))
    groups = full.groupBy("_ls_len", "_ls_sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # One row of each equal (text, doc_id) stands for its repeats until the end.
    copies = full.groupBy("_ls_len", "_ls_sha", "doc_id").agg(F.count("*").alias("_ls_times"))
    joined = spread_join(copies, groups, ["_ls_len", "_ls_sha"], "group_size", seen["n"], ["doc_id"])
    return joined.withColumn("_ls_i", F.explode(F.sequence(F.lit(1), F.col("_ls_times").cast("int")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_ls_i") == 1)).alias("kept"), "_ls_len", "_ls_sha"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` of every row, and the text's SHA-256 if ``digest``.

    Rows that no round pairs with another are single; their digest, if asked for,
    is made where they lie.
    """
    prefixed, prefixes = candidates(docs, id_col, text_col)
    columns = ["doc_id", "keep_id", "group_size", "kept"] + ["text_sha256"] * digest
    met = exact_groups(prefixed, prefixes).withColumn("text_sha256", F.col("_ls_sha")).select(*columns)
    sha = [F.sha2("_ls_text", 256).alias("text_sha256")] * digest
    single = prefixed.join(prefixes, ["_ls_len", "_ls_prefix"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *sha)
    return met.unionByName(single)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows to drop are known by id, length and text hash, and few of them are
    broadcast, so that the texts stay where they are. A row's whole text is hashed
    only if its id and length are those of a row to drop. Rows that
    repeat a kept one in id and text are cut to one by each task before a shuffle.
    """
    prefixed, prefixes = candidates(docs, id_col, text_col)
    groups = stage(exact_groups(prefixed, prefixes).filter("NOT kept"), "exact-lost")
    own_id, own_len, own_sha, own_rank, hit = (free_name(docs, x) for x in ("id", "len", "sha", "rank", "hit"))
    lost = groups.select(F.col("doc_id").alias(own_id), F.col("_ls_len").alias(own_len), F.col("_ls_sha").alias(own_sha), F.col("keep_id").eqNullSafe(F.col("doc_id")).alias(hit)).distinct()
    lost = stage(lost, "exact-lost")
    asked = broadcast_if_small(stage(lost.select(own_id, own_len, F.lit(True).alias(hit)).distinct(), "exact-asked"), 32)
    same_id = F.col(id_col).eqNullSafe(asked[own_id])
    flagged = docs.join(asked, same_id & (F.octet_length(_text(text_col)) == asked[own_len]), "left").drop(own_id, own_len)
    rows = flagged.withColumn(own_sha, F.when(F.col(hit), F.sha2(_text(text_col), 256))).drop(hit)

    def meets(of: DataFrame, which: str, how: str) -> DataFrame:
        some = broadcast_if_small(lost.filter(which).select(F.col(own_id).alias(own_rank), F.col(own_sha).alias(hit)), 112)
        return of.join(some, F.col(id_col).eqNullSafe(some[own_rank]) & (F.col(own_sha) == some[hit]), how)

    left = meets(rows, f"NOT `{hit}`", "left_anti")
    if lost.filter(F.col(hit)).isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in docs.columns])
    # Of rows that repeat both id and text, any one stays.
    repeated = meets(left, f"`{hit}`", "left_semi")
    once = repeated.groupBy(id_col, own_sha).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(own_rank)).select(f"{own_rank}.*")
    return meets(left, f"`{hit}`", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(once)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest=True)


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
