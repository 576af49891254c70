r"""URL filters as a temporal list join.

A list is a table of dated entries ``list_name, kind, value, action, on_date``:
``action`` is ``add`` or ``remove``; ``kind`` is ``host`` (that host alone),
``domain`` (the host or any below it) or ``prefix`` (host, with a path or alone,
up to a ``/`` or the end). Entries of one (list, kind, value) become validity intervals
[from, to), and each capture is judged by the intervals open when it was
fetched. ``allow`` lists overrule all others.

Cases: a null, empty or malformed URL, a null fetch date and an empty list match
nothing; an entry with a null in any column or nothing as its value is ignored;
case, a trailing dot of the host and needless slashes of a value are ignored; of several entries on
one date the last in order add < remove counts; repeated entries count once;
repeated captures are judged one by one; case, port, user info, a trailing dot of
the host, query and fragment of a URL are ignored. Long URLs are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspar.llm.common import broadcast_if_small, stage

ALLOW_LIST = "allow"

#: The list that the query applies: (list_name, kind, value, action, on_date).
ENTRIES = (
    ("malware", "host", "tionsh.example.net", "add", "2024-02-01"),
    ("malware", "host", "tionsh.example.net", "remove", "2024-03-15"),
    ("malware", "host", "tionsh.example.net", "add", "2024-08-01"),
    ("spam", "domain", "tionble.example.com", "add", "2024-01-10"),
    ("spam", "domain", "tionble.example.com", "remove", "2024-11-20"),
    ("spam", "domain", "ththth.example.org", "add", "2024-06-01"),
    ("adult", "prefix", "thther.example.org/en", "add", "2024-04-01"),
    ("adult", "prefix", "tionsh.example.net/fr", "add", "2024-01-01"),
    ("adult", "prefix", "tionsh.example.net/fr", "remove", "2024-05-05"),
    ("allow", "domain", "tiontion.example.com", "add", "2024-01-01"),
    ("allow", "prefix", "m.ththth.example.net/en", "add", "2024-09-01"),
    ("spam", "domain", "example.net", "add", "2024-10-01"),
    ("spam", "domain", "tiontion.example.com", "add", "2024-03-01"),
)


def _normal(value: Column) -> Column:
    """An entry's value as the keys of URLs are written."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "/+", "/"), "/$", "")
    return F.regexp_replace(plain, r"^([^/]*)\.(?=/|$)", "$1")


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, key, from_date, to_date`` (null: still open), not overlapping."""
    named = ["list_name", "kind", "value", "action", "on_date"]
    valid = entries.select(*named).dropna().filter(F.col("action").isin("add", "remove") & F.col("kind").isin("host", "domain", "prefix"))
    valid = valid.withColumn("value", _normal(F.col("value"))).filter("value <> ''")
    by = ["list_name", "kind", "value"]
    # One row for each date, the last action counting; then the next date of the other action closes it.
    daily = valid.groupBy(*by, "on_date").agg(F.max("action").alias("action"))
    w = W.partitionBy(*by).orderBy("on_date")
    turns = daily.withColumn("was", F.lag("action").over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col("action")))
    spans = turns.withColumn("to_date", F.lead("on_date").over(w)).filter("action = 'add'")
    return spans.select("list_name", F.concat(F.col("kind"), F.lit(":"), "value").alias("key"), F.col("on_date").alias("from_date"), "to_date")


def _keys(url: Column) -> Column:
    """Every key that an entry matching this URL can have."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"\.$", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    every = F.concat(F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("prefix:"), host)), domains, F.coalesce(prefixes, F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(every))


def url_verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetch_date") -> DataFrame:
    """``page_id, fetch_date, n_active, lists, blocked``, one row per capture.

    Keys that no entry has are left out first. The as-of join is on key equality
    with the date inside the interval. It runs over distinct (key, date) pairs, so a
    host with a third of all captures meets its intervals once a day. What matched,
    at most one row for each list key and date, is then joined to the captures. The
    list's keys and the matches are broadcast if they are small by count.
    """
    rows = stage(captures.select(F.monotonically_increasing_id().alias("_ls_row"), F.col(id_col).alias("page_id"), F.col(date_col).cast("date").alias("fetch_date"), _keys(F.col(url_col)).alias("_ls_keys")), "captures")
    open_ = stage(intervals(entries), "intervals")
    listed = broadcast_if_small(stage(open_.select("key").distinct(), "list-keys"), 96)
    exploded = rows.select("_ls_row", "fetch_date", F.explode("_ls_keys").alias("key")).join(listed, "key", "left_semi")
    asked = exploded.select("key", "fetch_date").distinct()
    inside = (asked["key"] == open_["key"]) & (asked["fetch_date"] >= open_["from_date"]) & (open_["to_date"].isNull() | (asked["fetch_date"] < open_["to_date"]))
    active = broadcast_if_small(stage(asked.join(open_, inside).groupBy(asked["key"], "fetch_date").agg(F.collect_set("list_name").alias("names")), "active"), 192)
    hits = exploded.join(active, ["key", "fetch_date"]).groupBy("_ls_row").agg(F.sum(F.size("names")).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return rows.join(hits, "_ls_row", "left").select(
        "page_id", "fetch_date", F.coalesce("n", F.lit(0).cast("long")).alias("n_active"), F.array_join(names, ",").alias("lists"), ((F.size(names) > 0) & ~F.array_contains(names, ALLOW_LIST)).alias("blocked")
    )


def list_entries(spark: SparkSession, entries: tuple = ENTRIES) -> DataFrame:
    """A Python list of entries as a table, made by SQL literals."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)}, {quote(d)}, DATE {quote(e)})" for a, b, c, d, e in entries)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(list_name, kind, value, action, on_date)")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. They carry no fetch time, so one is dealt by id over 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", day.alias("fetch_date"))
    return url_verdicts(pages, list_entries(spark)).select("page_id", F.col("fetch_date").cast("string").alias("fetch_date"), "n_active", "lists", "blocked")


OP2_SQL = r"""
WITH e(list_name, kind, value, action, on_date) AS (VALUES
""" + ",\n".join(f"  ('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in ENTRIES) + r"""),
i AS (SELECT * FROM (SELECT *, lead(on_date) OVER (PARTITION BY list_name, kind, value ORDER BY on_date) AS until FROM e) WHERE action = 'add'),
p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS d,
             lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h,
             lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
m AS (SELECT page_id, list_name FROM p JOIN i ON d >= on_date AND (until IS NULL OR d < until) AND (
        (kind = 'host' AND h = value) OR (kind = 'domain' AND (h = value OR ends_with(h, '.' || value)))
        OR (kind = 'prefix' AND starts_with(h || path || '/', value || '/')))),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS l, bool_or(list_name = 'allow') AS a FROM m GROUP BY page_id)
SELECT p.page_id, CAST(d AS VARCHAR) AS fetch_date, coalesce(n, 0) AS n_active, coalesce(l, '') AS lists, n IS NOT NULL AND NOT a AS blocked
FROM p LEFT JOIN g ON p.page_id = g.page_id
"""
