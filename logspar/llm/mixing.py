"""Mixing sources to target weights by weighted fair queueing.

Cases: a null text has size 0; a document of size 0 is never taken; null is a
source of its own, after all others. Repeated rows are separate documents, and
rows that share an id are told apart by text and source. A source without words
has target 0. An empty table gives an empty result. Other columns are not read by
``mix_plan``; ``mix_documents`` carries them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspar.llm.common import broadcast_if_small, free_name, running_sum, stage

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is taken at most so many times its size.
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(_ls_key, source_size, target) of each source; ``sizes`` has _ls_key and size.

    The fair level is found in closed form instead of by rounds of resharing:
    with sources in order of cap / weight, the level once all smaller ones are
    full is (budget - their caps) / (the weights left), and the first source
    whose own ratio is above that level, with all after it, is not full. The
    windows run over one row per source.
    """
    table = sizes.groupBy("_ls_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("_ls_key")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = table.select("_ls_key", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * repeats).alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "_ls_key")
    table = (
        table.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(W.partitionBy()))
        .withColumn("free", F.col("cap") * F.col("left") > F.col("w") * (F.col("budget") - F.col("full")))
    )
    first = W.orderBy(F.col("cap") / F.col("w"), "_ls_key").rowsBetween(W.unboundedPreceding, 0)
    over = F.first(F.when(F.col("free"), F.struct("full", "left")), ignorenulls=True).over(first)
    share = F.col("w") * (F.col("budget") - F.col("over.full")) / F.col("over.left")
    return table.withColumn("over", over).select("_ls_key", "source_size", F.when(F.col("over").isNull(), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"), "budget")


def _content(text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(text_col), F.col(source_col))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row, and a
    hash of its text and source.

    Documents are shuffled by a seeded hash of their id. A document's virtual
    finish time is its source's running word count at its end, over the source's
    target; further passes over a source go on from the end of the last one. All
    (document, pass) entries are range-sorted by finish time and taken while the
    running total is within the budget. Both running totals are two-level prefix
    sums, so a source with a third of all rows is spread over many tasks.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    sizes = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("_ls_key"), size.alias("size"), _content(text_col, source_col).alias("_ls_content")).select(
            F.monotonically_increasing_id().alias("_ls_row"), "*", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_ls_mix")
        ),
        "mix-sizes",
    )
    targets = stage(source_targets(sizes), "mix-targets")
    # Rows that share an id come in the order of their content; only equal rows are ordered by place.
    placed = running_sum(sizes.select("_ls_row", "_ls_key", "size", "_ls_mix", "_ls_content"), ["_ls_key"], ["_ls_mix", "_ls_content", "_ls_row"], "size", "_ls_before")
    entries = (
        placed.filter("size > 0")
        .join(targets, "_ls_key")
        .withColumn("_ls_pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
        .select("_ls_row", "size", "_ls_mix", "_ls_content", "_ls_pass", "budget", ((F.col("_ls_pass") * F.col("source_size") + F.col("_ls_before") + F.col("size")) / F.col("target")).alias("_ls_finish"))
    )
    queue = running_sum(stage(entries, "mix-entries"), [], ["_ls_finish", "_ls_mix", "_ls_pass", "_ls_content", "_ls_row"], "size", "_ls_total")
    taken = queue.filter("_ls_total + size <= budget").groupBy("_ls_row").agg(F.sum("size").alias("_ls_taken"))
    return (
        sizes.join(targets.drop("budget"), "_ls_key")
        .join(taken, "_ls_row", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("_ls_taken", F.lit(0).cast("long")).alias("taken"), F.col("_ls_content").alias("content"))
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as the mix takes it.

    Rows equal in id, text and source are one another's equals: together they
    come as often as all of them are taken.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, seed).filter("taken > 0")
    own_id, own_hash, times, rows = (free_name(docs, x) for x in ("id", "content", "times", "rows"))
    repeats = F.col("taken") / F.col("size")
    found = plan.groupBy(F.col("doc_id").alias(own_id), F.col("content").alias(own_hash)).agg(F.sum(repeats).cast("int").alias(times), F.count("*").alias(rows))
    counted = stage(found, "mix-times")
    met = docs.join(broadcast_if_small(counted, 32), F.col(id_col).eqNullSafe(F.col(own_id)) & (_content(text_col, source_col) == F.col(own_hash)))
    out = met.filter(F.col(rows) == 1)
    if not counted.filter(F.col(rows) > 1).isEmpty():
        out = out.unionByName(met.filter(F.col(rows) > 1).dropDuplicates([own_id, own_hash]))
    return out.withColumn(rows, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w,
             source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
l AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f,
             CAST(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS r FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS i, cap * r > w * (budget - f) AS free FROM l),
c AS (SELECT f AS cf, r AS cr, i AS ci FROM o WHERE free ORDER BY i LIMIT 1),
t AS (SELECT k, source_size, budget, CASE WHEN ci IS NULL OR i < ci THEN CAST(cap AS DOUBLE)
             ELSE CAST(w * (budget - cf) AS DOUBLE) / CAST(cr AS DOUBLE) END AS target FROM o LEFT JOIN c ON TRUE),
p AS (SELECT d.doc_id, d.size, d.h, t.*, CAST(coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.k = t.k),
e AS (SELECT doc_id, size, h, pass, budget, CAST(pass * source_size + before + size AS DOUBLE) / target AS finish
      FROM p, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, h, pass, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
x AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE total <= budget GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(x.taken, 0) AS taken FROM p LEFT JOIN x ON p.doc_id = x.doc_id
"""
