"""Named queries over the driver's tables, each with the SQL that it must equal.

The ``events`` table stands for a log: ``props`` is a JSON text with a numeric
``k`` (the status), ``value`` floored is the latency, the user is the trace id.
The log is typed once a session and table, with its metadata; queries then
filter plain Parquet columns. Queries over files are in ``file_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspar import file_queries
from logspar.functions import log_text as T
from logspar.operators import bitslice, promotion, report, rowgroups, search
from logspar.plans.dialect import parse_compat, parse_strict
from logspar.plans.predicates import And, Eq, Gt, overlaps, row_filter
from logspar.sources import files, ndjson, store
from logspar.streaming import staging

STATUS, LATENCY, BITS, GROUP = 69, 20, 10, 1024


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as a log, parsed from its JSON texts."""
    row = F.col("event_id")
    return events(spark, sf_dir).select(
        row.alias("row_id"),
        T.block(row).alias("block"),
        T.lane(row).alias("lane"),
        rowgroups.group_id("event_id", GROUP).alias("rg"),
        "ts",
        "event_type",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("status"),
        F.floor("value").cast("bigint").alias("latency"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("trace_id"),
    )


_STORES: dict[tuple, store.LogStore] = {}


def log_store(spark: SparkSession, sf_dir: str) -> store.LogStore:
    """The typed log of ``events`` and its metadata, written anew when the table changes."""
    key = (spark.sparkContext.applicationId, *files.mark(spark, f"{sf_dir}/events.parquet"))
    if key not in _STORES:
        _STORES[key] = store.write(raw_log(spark, sf_dir), files.scratch(spark, "typed-log"), ["status", "latency", "row_id"], {"trace_id": 100_000})
    return _STORES[key]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_store(spark, sf_dir).rows()


LOG_SQL = """WITH log AS (SELECT event_id AS row_id, event_id // 64 AS block, CAST(event_id % 64 AS INTEGER) AS lane, event_id // 1024 AS rg, ts, event_type, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS status, CAST(floor(value) AS BIGINT) AS latency, 'u-' || user_id AS trace_id FROM events) """


def numeric_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_where(log(spark, sf_dir), parse_compat(f"status == {STATUS} AND latency > {LATENCY}").column())


def numeric_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).filter(parse_compat(f"status=={STATUS}&&latency>{LATENCY}").column()).select("row_id", "status", "latency")


def compat_latency_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_where(log(spark, sf_dir), parse_compat("latency > 0").column())


def strict_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).filter(parse_strict('(status >= 98 OR NOT latency < 300) AND event_type != "click"'))
    return rows.select("row_id", "status", "latency", "event_type")


def three_conjunct_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", 3).otherwise(1)
    rows = log(spark, sf_dir).withColumn("severity", severity)
    return search.count_where(rows, row_filter(And(And(Eq("status", 50), Gt("latency", 5)), Eq("severity", 1))))


def defaulted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts of which some lack a field, or have it of another type."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("row_id") % 4 == 0, F.concat(F.lit('{"status":"'), k, F.lit('"}'))).when(F.col("row_id") % 4 == 1, F.concat(F.lit('{"status":'), k, F.lit(".5}"))).when(F.col("row_id") % 4 == 2, F.concat(F.lit('{"status":-'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"status":'), k, F.lit("}")))
    made = T.json_bigint(F.col("value"), "status")["status"]
    return log(spark, sf_dir).select("row_id", text.alias("value")).select("row_id", T.defaulted(made).alias("status"))


def substring_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_occurrences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", parse_compat('contains("the")').pattern)


def substring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_lines_with(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "the")


def json_field_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"))


def digit_run_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeezed = F.replace(F.col("props"), F.lit(" "), F.lit(""))
    return events(spark, sf_dir).select("event_id", T.digit_run(squeezed, "k").alias("k"), T.digit_run(squeezed, "absent").alias("absent"))


def block_lane_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("row_id", "block", "lane")


def zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroups.zone_maps(log(spark, sf_dir), ["status", "latency"]).drop("nulls_status", "nulls_latency")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_store(spark, sf_dir).zones()


def zone_pruned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroups.surviving_groups(_meta(spark, sf_dir), And(Gt("row_id", 3000), Eq("status", STATUS)))


def zone_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroups.pruned_scan(log(spark, sf_dir), _meta(spark, sf_dir), And(Gt("row_id", 3000), Eq("status", STATUS))).select("row_id", "status")


def ts_pruned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("rg", F.col("block"))
    zones = rowgroups.zone_maps(rows, ["ts"])
    return zones.filter(overlaps(F.col("min_ts"), F.col("max_ts"), F.lit("2024-01-20").cast("timestamp_ntz"), F.lit("9999-01-01").cast("timestamp_ntz"))).select("rg")


def bloom_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = log_store(spark, sf_dir)
    return rowgroups.pruned_scan(made.rows(), made.zones(), Eq("trace_id", "u-8"), {"trace_id": made.blooms("trace_id")}).select("row_id", "trace_id")


def bloom_zone_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = log_store(spark, sf_dir)
    node = And(Eq("trace_id", "u-8"), And(Gt("latency", LATENCY), Gt("row_id", 3000)))
    return rowgroups.pruned_scan(made.rows(), made.zones(), node, {"trace_id": made.blooms("trace_id")}).select("row_id", "trace_id", "latency")


def block_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("latency", F.when(F.col("latency") > 100, F.col("latency")))
    return rowgroups.presence(rows, ["status", "latency"])


def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bitslice.planes(log(spark, sf_dir), "status", BITS)
    return made.select("block", F.posexplode("planes").alias("bit", "plane"))


def bit_planes_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bitslice.planes(log(spark, sf_dir), "status", BITS).select(F.posexplode("planes").alias("bit", "plane"))
    return made.groupBy("bit").agg(F.sum(F.bit_count("plane").cast("bigint")).alias("ones"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bitslice.planes_of(log(spark, sf_dir), {"s": ("status", BITS), "l": ("latency", 12)})
    mask = bitslice.equal_mask(F.col("s"), STATUS, BITS, F.col("valid")).bitwiseAND(bitslice.greater_mask(F.col("l"), LATENCY, 12, F.col("valid")))
    return both.select("block", mask.alias("mask"))


def bitsliced_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.match_count(_masked(spark, sf_dir), F.col("mask"))


def mask_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _masked(spark, sf_dir).select("block", F.explode(bitslice.lanes(F.col("mask"))).alias("lane"))
    return found.select((F.col("block") * 64 + F.col("lane")).alias("row_id"))


def unsliced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.values(bitslice.planes(log(spark, sf_dir), "status", BITS), out="status")


def plane_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.plane_xor(bitslice.planes(log(spark, sf_dir), "status", 7))


def deferred_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return search.reconstruct(rows.select("row_id", "status", "latency"), rows.select("row_id", "props"), parse_compat(f"status == {STATUS} AND latency > {LATENCY}").column())


def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_matches(numeric_filter_rows(spark, sf_dir))


def staging_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.batches(log(spark, sf_dir))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream into Parquet, and read back."""
    root = files.scratch(spark, "stream")
    source = f"{sf_dir}/events.parquet*"
    staging.ingest_parquet(spark, source, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type", "props")


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead file of all events, where the SQL's third is blank lines, read back."""
    numbered = F.concat_ws("\t", F.col("row_id").cast("string"), "props")
    ends = F.when(F.col("row_id") % 3 == 0, F.concat(numbered, F.lit("\r"))).when(F.col("row_id") % 3 == 1, F.lit("")).otherwise(numbered)
    path = f"{files.scratch(spark, 'recover')}/wal"
    log(spark, sf_dir).select(ends.alias("value")).write.text(path)
    parts = F.split("value", "\t", 2)
    return ndjson.recover_log(spark, path).select(parts[0].cast("bigint").alias("row_id"), parts[1].alias("value"))


def field_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = promotion.field_heat(events(spark, sf_dir), "event_type")
    density = F.lit(0.05)
    return heat.select("event_type", "access_count", promotion.score(F.col("access_count"), density).alias("score"), promotion.should_promote(F.col("access_count"), density).alias("promote"))


def promote_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.promote(events(spark, sf_dir).select("event_id", "props"), "props", "k").select("event_id", "k")


def warm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.length("event_type") == 4).agg(F.count("*").alias("matches"))


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.sum(F.octet_length("props").cast("bigint")).alias("bytes"), F.ceil(F.count("*") / 64).cast("bigint").alias("blocks"))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _meta(spark, sf_dir)
    return rowgroups.surviving_groups(meta, Gt("row_id", 5000)).agg(F.count("*").alias("surviving"))


def zone_map_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of a field that only some groups have: null where a group has no value."""
    rows = log(spark, sf_dir).withColumn("late", F.when(F.col("rg") % 2 == 1, F.col("latency")))
    return rowgroups.zone_maps(rows, ["late"])


def group_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set bits of each plane of each group of 65,536 rows."""
    made = bitslice.group_planes(bitslice.planes(log(spark, sf_dir), "status", BITS))
    ones = F.aggregate("words", F.lit(0).cast("bigint"), lambda acc, w: acc + F.bit_count(w).cast("bigint"))
    return made.select("rg", "bit", F.size("words").cast("bigint").alias("words"), ones.alias("ones"))


def plane_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bitslice.word_checksum(bitslice.planes(log(spark, sf_dir), "status", BITS))
    return made.select(F.col("checksum").cast("string").alias("checksum"))


def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that queries asked for, judged by how often and by their measured density."""
    rows, judged = log(spark, sf_dir), []
    asked = promotion.field_heat(rows.select(F.when(F.col("status") < 50, "k").when(F.col("status") < 60, "rare").otherwise("absent").alias("field")))
    rare = F.when(F.col("row_id") % 200 == 0, F.col("status"))
    for field, value in (("k", F.get_json_object("props", "$.k")), ("rare", rare), ("absent", F.get_json_object("props", "$.absent"))):
        judged.append(promotion.density(rows, value).select(F.lit(field).alias("field"), "density"))
    heat = asked.join(F.broadcast(judged[0].unionAll(judged[1]).unionAll(judged[2])), "field")
    return heat.select("field", "access_count", "density", promotion.should_promote(F.col("access_count"), F.col("density")).alias("promote"))


def field_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of fields in the typed log, and whether its fingerprint follows the schema."""
    rows = log(spark, sf_dir)
    same = promotion.fingerprint(rows) == promotion.fingerprint(log(spark, sf_dir)) != promotion.fingerprint(rows.drop("ts"))
    return spark.createDataFrame([(f, promotion.slot(rows, f), same) for f in ("row_id", "status", "nowhere")], "field string, slot int, same boolean")


def compat_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a substring query that mean the same, and one whose quotes are part of it."""
    rows = log(spark, sf_dir)
    counts = [search.count_occurrences(rows, "props", parse_compat(q).pattern).select(F.lit(q).alias("query"), "matches") for q in ('contains( "k" )', "contains(k)", '"k"', "k", "'k'")]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out


def interpreted_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric filter with and without compiled code."""
    query = lambda: numeric_filter_count(spark, sf_dir)
    return spark.createDataFrame([(report.interpreted(spark, query)[0].matches, query().first().matches)], "interpreted bigint, compiled bigint")


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries ran, whether the longest bounds all, and what the last gave."""
    stats = report.QueryStats()
    for _ in range(3):
        rows = stats.run(lambda: numeric_filter_count(spark, sf_dir))
    return spark.createDataFrame([(stats.total, stats.longest == max(stats.seconds) > 0, rows[0].matches)], "queries bigint, bounded boolean, matches bigint")


QUERIES = {
    f.__name__: f
    for f in (
        numeric_filter_count, numeric_filter_rows, compat_latency_only, strict_or_filter, three_conjunct_filter, defaulted_fields, substring_occurrences,
        substring_lines, json_field_project, digit_run_field, block_lane_index, zone_maps, zone_pruned_groups, zone_pruned_scan, ts_pruned_groups,
        bloom_pruned_scan, block_presence, bit_planes, bit_planes_popcount, bitsliced_filter_count, mask_to_rows, unsliced_values, plane_xor,
        deferred_reconstruct, first_matches, staging_batches, stream_ingest, wal_recover, field_heat, promote_field, warm_scan, file_bytes, group_counts,
        bloom_zone_pruned_scan, zone_map_reset, group_planes, plane_checksum, promotion_candidates, field_slots, compat_contains, interpreted_filter_count,
        query_stats,
    )
} | file_queries.QUERIES

_MATCH = f"status = {STATUS} AND latency > {LATENCY}"
_PLANE = "(status >> b) & 1 = 1"
_LANE_BIT = "CASE WHEN lane = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << lane END"

ORACLES = {
    "numeric_filter_count": LOG_SQL + f"SELECT count(*) AS matches FROM log WHERE {_MATCH}",
    "numeric_filter_rows": LOG_SQL + f"SELECT row_id, status, latency FROM log WHERE {_MATCH}",
    "compat_latency_only": LOG_SQL + "SELECT count(*) AS matches FROM log WHERE status = 0 AND latency > 0",
    "strict_or_filter": LOG_SQL + "SELECT row_id, status, latency, event_type FROM log WHERE (status >= 98 OR latency >= 300) AND event_type <> 'click'",
    "three_conjunct_filter": LOG_SQL + "SELECT count(*) AS matches FROM log WHERE status = 50 AND latency > 5 AND CASE WHEN event_type = 'error' THEN 3 ELSE 1 END = 1",
    "defaulted_fields": LOG_SQL + "SELECT row_id, CASE WHEN row_id % 4 = 3 THEN status ELSE 0 END AS status FROM log",
    "substring_occurrences": "SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS matches FROM documents",
    "substring_lines": "SELECT count(*) AS matches FROM documents WHERE contains(text, 'the')",
    "json_field_project": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "digit_run_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(0 AS BIGINT) AS absent FROM events",
    "block_lane_index": LOG_SQL + "SELECT row_id, block, lane FROM log",
    "zone_maps": LOG_SQL + "SELECT rg, count(*) AS n, min(status) AS min_status, max(status) AS max_status, min(latency) AS min_latency, max(latency) AS max_latency FROM log GROUP BY rg",
    "zone_pruned_groups": LOG_SQL + f"SELECT rg FROM log GROUP BY rg HAVING max(row_id) > 3000 AND {STATUS} BETWEEN min(status) AND max(status)",
    "zone_pruned_scan": LOG_SQL + f"SELECT row_id, status FROM log WHERE row_id > 3000 AND status = {STATUS}",
    "ts_pruned_groups": LOG_SQL + "SELECT block AS rg FROM log GROUP BY block HAVING max(ts) >= TIMESTAMP '2024-01-20'",
    "bloom_pruned_scan": LOG_SQL + "SELECT row_id, trace_id FROM log WHERE trace_id = 'u-8'",
    "block_presence": LOG_SQL + "SELECT rg, block, max(status IS NOT NULL) AS has_status, max(latency > 100) AS has_latency FROM log GROUP BY rg, block",
    "bit_planes": LOG_SQL + f"SELECT block, CAST(b AS INTEGER) AS bit, bit_or(CASE WHEN {_PLANE} THEN {_LANE_BIT} ELSE 0 END) AS plane FROM log, range({BITS}) t(b) GROUP BY block, b",
    "bit_planes_popcount": LOG_SQL + f"SELECT CAST(b AS INTEGER) AS bit, CAST(sum((status >> b) & 1) AS BIGINT) AS ones FROM log, range({BITS}) t(b) GROUP BY b",
    "bitsliced_filter_count": LOG_SQL + f"SELECT count(*) AS matches FROM log WHERE {_MATCH}",
    "mask_to_rows": LOG_SQL + f"SELECT row_id FROM log WHERE {_MATCH}",
    "unsliced_values": LOG_SQL + "SELECT block, lane, status FROM log",
    "plane_xor": LOG_SQL + f"SELECT bit_xor(CASE WHEN {_PLANE} THEN {_LANE_BIT} ELSE 0 END) AS plane_xor FROM log, range(7) t(b)",
    "deferred_reconstruct": LOG_SQL + f"SELECT row_id, props FROM log WHERE {_MATCH}",
    "first_matches": LOG_SQL + f"SELECT row_id, status, latency FROM log WHERE {_MATCH} ORDER BY row_id LIMIT 3",
    "staging_batches": LOG_SQL + "SELECT row_id // 1000 AS batch, count(*) AS n FROM log GROUP BY 1",
    "stream_ingest": "SELECT event_id, event_type, props FROM events",
    "wal_recover": LOG_SQL + "SELECT row_id, props AS value FROM log WHERE row_id % 3 <> 1",
    "field_heat": "SELECT event_type, count(*) AS access_count, CAST(0.7 AS DOUBLE) * count(*) + CAST(0.3 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS score, true AS promote FROM events GROUP BY event_type",
    "promote_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "warm_scan": "SELECT count(*) AS matches FROM events WHERE length(event_type) = 4",
    "file_bytes": "SELECT CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(ceil(count(*) / 64) AS BIGINT) AS blocks FROM events",
    "group_counts": LOG_SQL + "SELECT count(*) AS surviving FROM (SELECT rg FROM log GROUP BY rg HAVING max(row_id) > 5000)",
    "bloom_zone_pruned_scan": LOG_SQL + f"SELECT row_id, trace_id, latency FROM log WHERE trace_id = 'u-8' AND latency > {LATENCY} AND row_id > 3000",
    "zone_map_reset": LOG_SQL + "SELECT rg, count(*) AS n, min(CASE WHEN rg % 2 = 1 THEN latency END) AS min_late, max(CASE WHEN rg % 2 = 1 THEN latency END) AS max_late, CAST(count(*) FILTER (rg % 2 <> 1 OR latency IS NULL) AS BIGINT) AS nulls_late FROM log GROUP BY rg",
    "group_planes": LOG_SQL + f"SELECT row_id // 65536 AS rg, CAST(b AS INTEGER) AS bit, CAST(1024 AS BIGINT) AS words, CAST(sum((status >> b) & 1) AS BIGINT) AS ones FROM log, range({BITS}) t(b) GROUP BY 1, 2",
    "plane_checksum": LOG_SQL + f"SELECT CAST(sum(CASE WHEN {_PLANE} THEN CAST(power(CAST(2 AS DOUBLE), lane) AS HUGEINT) ELSE 0 END) % CAST('18446744073709551616' AS HUGEINT) AS VARCHAR) AS checksum FROM log, range({BITS}) t(b)",
    "promotion_candidates": LOG_SQL
    + """, a AS (SELECT CASE WHEN status < 50 THEN 'k' WHEN status < 60 THEN 'rare' ELSE 'absent' END AS field, count(*) AS access_count FROM log GROUP BY 1),
  d AS (SELECT 'k' AS field, CAST(count(json_extract_string(props, '$.k')) AS DOUBLE) / count(*) AS density FROM log
        UNION ALL SELECT 'rare', CAST(count(CASE WHEN row_id % 200 = 0 THEN status END) AS DOUBLE) / count(*) FROM log UNION ALL SELECT 'absent', CAST(0 AS DOUBLE))
  SELECT field, access_count, density, CAST(0.7 AS DOUBLE) * access_count + CAST(0.3 AS DOUBLE) * density > 0.15 AND density > CAST(0.01 AS DOUBLE) AS promote FROM a JOIN d USING (field)""",
    "field_slots": "SELECT * FROM (VALUES ('row_id', 0, true), ('status', 7, true), ('nowhere', -1, true)) t(field, slot, same)",
    "compat_contains": """SELECT q AS query, CAST(sum((length(props) - length(replace(props, p, ''))) // length(p)) AS BIGINT) AS matches
  FROM events, (VALUES ('contains( "k" )', 'k'), ('contains(k)', 'k'), ('"k"', 'k'), ('k', 'k'), (chr(39) || 'k' || chr(39), chr(39) || 'k' || chr(39))) t(q, p) GROUP BY q""",
    "interpreted_filter_count": LOG_SQL + f"SELECT count(*) AS interpreted, count(*) AS compiled FROM log WHERE {_MATCH}",
    "query_stats": LOG_SQL + f"SELECT CAST(3 AS BIGINT) AS queries, true AS bounded, count(*) AS matches FROM log WHERE {_MATCH}",
} | file_queries.ORACLES
