r"""Secret scans with corpus-wide ownership frequency, in Spark expressions only.

Base kinds: ``assign``, ``access`` and ``hex``. For each candidate value the scan
counts the distinct repositories and owners it occurs in over the whole corpus.
A value that one owner alone has, in however many repositories, and that looks
live adds a span of kind ``live`` over the value; a value that more owners have
is a copied example, and its spans are given apart with these counts.

Cases: a null text counts as empty; texts are scanned whole; a null repository or
owner counts as one of its own; overlapping kinds are all reported; repeated rows
are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar.llm.common import spread_join, stage, stage_measured

# The base patterns, with the kinds in the order that breaks ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
MIN_CHARS = {"assign": 8, "access": 16, "hex": 32}

#: A value that more owners than this have is taken for a copied example.
MAX_LIVE_OWNERS = 1
#: A live-looking value has this many code points, letters and digits, and no such word.
MIN_LIVE_CHARS = 16
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234"

SPAN = "struct<start:bigint,rank:int,end:bigint,value_start:bigint,value:string>"


def _found(text: Column, pattern: str, group: int, kind: str) -> Column:
    """Spans of one kind: an array of (start, rank, end, value_start, value).

    ``split`` gives what lies between the matches, ``regexp_extract_all`` the
    matches; offsets are their running lengths. The group is at a match's end.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), value.alias("value"))
    rank = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (end - F.length(x["value"])).alias("value_start"), x["value"].alias("value"))
        return F.struct(end.alias("pos"), F.when(F.length(x["value"]) >= MIN_CHARS[kind], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """``doc_id, _ls_row, repo, owner, found``: the base spans of every row.

    A cheap test spares most texts each extraction. Runs of hex digits and key
    ids are matched at their least length at once, which finds the same spans
    as matching all runs and dropping short ones, since a run is matched whole.
    """
    text = F.col("_ls_text")
    none = F.array().cast(f"array<{SPAN}>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("_ls_text"))
    kinds = [("assign", ASSIGN, 1), ("access", r"AKIA[A-Z0-9]{12,}", 0), ("hex", r"[0-9a-f]{32,}", 0)]
    found = F.concat(*[F.when(text.rlike(p), _found(text, p, g, k)).otherwise(none) for k, p, g in kinds])
    return rows.select(F.monotonically_increasing_id().alias("_ls_row"), "doc_id", "repo", "owner", found.alias("found"))


def ownership(scanned: DataFrame) -> DataFrame:
    """``value_hash, n_repos, n_owners, n_found`` of each candidate value.

    Two levels: counts by (value, repository, owner) combine on the map side, so
    a value in a third of all rows moves a row for each task and repository;
    then these few rows are counted by value.
    """
    each = scanned.select("repo", "owner", F.explode("found").alias("s")).groupBy(F.sha2("s.value", 256).alias("value_hash"), "repo", "owner").agg(F.count("*").alias("n"))
    mark = lambda c: F.countDistinct(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")))
    return each.groupBy("value_hash").agg(mark("repo").alias("n_repos"), mark("owner").alias("n_owners"), F.sum("n").alias("n_found"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """``doc_id, base, live, copied``: arrays of (start, rank, end) of every row;
    ``copied`` has the base spans of copied examples, with n_repos and n_owners."""
    scanned, seen = stage_measured(scan(docs, id_col, text_col, repo_col, owner_col), "secrets", n=F.coalesce(F.sum(F.size("found").cast("long")), F.lit(0)))
    owned = stage(ownership(scanned), "ownership")
    looks = (F.length("s.value") >= MIN_LIVE_CHARS) & F.col("s.value").rlike("[0-9]") & F.col("s.value").rlike("[A-Za-z]") & ~F.col("s.value").rlike(PLACEHOLDER)
    each = scanned.select("_ls_row", F.explode("found").alias("s")).select("_ls_row", F.sha2("s.value", 256).alias("value_hash"), looks.alias("looks"), "s.start", "s.rank", "s.end", "s.value_start")
    met = spread_join(each, owned, ["value_hash"], "n_found", seen["n"], ["_ls_row"])
    alone = F.col("n_owners") <= MAX_LIVE_OWNERS
    span = F.when(alone & F.col("looks"), F.struct(F.col("value_start").alias("start"), F.lit(KINDS.index("live")).alias("rank"), F.col("end").alias("end")))
    copy = F.when(~alone, F.struct("start", "rank", "end", "n_repos", "n_owners"))
    live = met.groupBy("_ls_row").agg(F.collect_set(span).alias("live"), F.array_sort(F.collect_list(copy)).alias("copied"))
    base = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return scanned.select("_ls_row", "doc_id", base.alias("base")).join(live, "_ls_row", "left").select(
        "doc_id", "base", F.coalesce("live", empty).alias("live"), F.coalesce("copied", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,n_repos:bigint,n_owners:bigint>>")).alias("copied")
    )


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "live"))).alias("spans"))


_SQL_KIND = r"""
{k} AS (
  SELECT r, list_transform(list_zip(list_slice(g, 1, len(m)), m, v), lambda z: {{'gap': length(z[1]), 'm': length(z[2]), 'v': z[3]}}) AS z
  FROM (SELECT r, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM d)),
{k}_s AS (
  SELECT r, '{k}' AS kind, {rank} AS rank, u.v AS value, pos - u.m AS s, pos AS e FROM (
    SELECT r, u, CAST(sum(u.gap + u.m) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS pos
    FROM (SELECT r, unnest(z) AS u, generate_subscripts(z, 1) AS i FROM {k})) WHERE length(u.v) >= {least})"""

OP5_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        _SQL_KIND.format(k=k, p="'" + p.replace("'", "''") + "'", group=g, rank=i, least=MIN_CHARS[k])
        for i, (k, p, g) in enumerate([("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX + "", 0)])
    )
    + rf""",
base AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
own AS (SELECT value FROM base JOIN d USING (r) GROUP BY value HAVING count(DISTINCT coalesce('+' || source, '-')) <= {MAX_LIVE_OWNERS}),
live AS (SELECT DISTINCT r, 'live' AS kind, 3 AS rank, e - length(value) AS s, e FROM base
         WHERE length(value) >= {MIN_LIVE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
           AND NOT regexp_matches(value, '{PLACEHOLDER}') AND value IN (SELECT value FROM own)),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS b FROM base GROUP BY r),
x AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
      FROM (SELECT r, kind, rank, s, e FROM base UNION ALL SELECT r, kind, rank, s, e FROM live) GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.r = a.r LEFT JOIN x ON d.r = x.r
"""
)
