import json
import random

import pytest
from pyspark.sql import functions as F

from logspar import cli, queries
from logspar.functions import log_text as T
from logspar.operators import bitslice, promotion, report, rowgroups, search
from logspar.plans.predicates import And, Eq, Gt, may_match, row_filter
from logspar.sources import agb, files, ndjson, store
from logspar.streaming import staging, wal


def lines_file(path, lines, end="\n"):
    path.write_bytes("".join(x + end for x in lines).encode())
    return str(path)


def test_numeric_defaults(spark, tmp_path):
    lines = ['{"status":"200","latency":1}', '{"status":200.5,"latency":1}', '{"status":-5,"latency":1}', '{"status":null}', '{"latency":9,"status":500}', '{"status": 404 , "latency": 7}', "not json", '{"status":200', ""]
    rows = ndjson.with_fields(ndjson.staged_batch(spark, lines), "status", "latency").collect()
    assert [(r.status, r.latency) for r in rows] == [(0, 1), (0, 1), (0, 1), (0, 0), (500, 9), (404, 7), (0, 0), (0, 0), (0, 0)]
    path = lines_file(tmp_path / "a.json", lines)
    assert search.run_query(spark, "status == 404 AND latency > 6", path) == 1
    assert search.run_query(spark, "latency > 0", path) == 3
    assert search.run_query(spark, "status >= 404 AND latency < 9", path, strict=True) == 1


def test_values_beyond_signed(spark, tmp_path):
    big = [2**63 - 1, 2**63, 2**64 - 1, 2**64]
    path = lines_file(tmp_path / "big.json", ['{"status": %d, "latency": 5}' % v for v in big])
    for v in big:  # the last is too large for a query, which then asks for 0, and for a field, which then is 0
        assert search.run_query(spark, f"status == {v} AND latency > 1", path) == 1


def test_occurrences(spark, tmp_path):
    path = lines_file(tmp_path / "t", ["aaaa", "a.b axb", "x"])
    for pattern, n in (("aa", 2), ("a.b", 1), ("", 0), ("x\nX", 0), ("b\nx", 1), ("absent", 0)):
        assert search.run_query(spark, f'contains("{pattern}")', path) == n
    empty = lines_file(tmp_path / "empty", [])
    assert search.run_query(spark, "aa", empty) == 0 and search.run_query(spark, "latency > 0", empty) == 0
    with pytest.raises(Exception):
        search.run_query(spark, "aa", str(tmp_path / "none"))


def test_offsets_across_splits(spark, tmp_path):
    lines = [f"é{i}" * (i % 7) + "\r" * (i % 2) for i in range(3000)]
    path = lines_file(tmp_path / "long", lines)
    data = (tmp_path / "long").read_bytes()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ndjson.numbered_lines(spark, path).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in rows] == lines and [r.row_id for r in rows] == list(range(3000))
    assert all(data[r.byte_offset :].startswith(r.value.encode()) for r in rows)
    assert all((r.block, r.lane) == divmod(r.row_id, 64) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 130])
def test_block_file_round_trip(spark, tmp_path, n):
    values = [0, 1, 255, 256, 456, 500, 2**63 - 1]
    rows = [(values[i % 7], values[(i * 3) % 7]) for i in range(n)]
    path = lines_file(tmp_path / "in.json", [json.dumps({"status": a, "latency": b}) for a, b in rows])
    out = str(tmp_path / "out.agb")
    stats = agb.convert(spark, path, out)
    blocks = -(-n // 64)
    assert stats == {"records": n, "blocks": blocks, "data_bytes": blocks * 1024, "index_bytes": blocks * 512}
    if n:
        read = agb.read_blocks(spark, out, n)
        for k, f in enumerate(agb.FIELDS):
            got = {(r.block, r.lane): r.value for r in bitslice.values(read, f"p_{f}").collect()}
            assert got == {divmod(i, 64): v[k] for i, v in enumerate(rows)}
        assert agb.count_matches(spark, out, n, 456, 0) == sum(a == 456 and b > 0 for a, b in rows)
        assert agb.count_matches(spark, out, n, 0, 255) == sum(a == 0 and b > 255 for a, b in rows)
        data = open(path, "rb").read()
        for r in agb.read_index(spark, out + ".idx").collect():
            if (i := r.block * 64 + r.lane) < n:
                assert data[r.byte_offset :].startswith(json.dumps({"status": rows[i][0], "latency": rows[i][1]}).encode())


def test_plane_checksum(spark):
    rows = spark.range(130).select(T.block(F.col("id")).alias("block"), T.lane(F.col("id")).alias("lane"), (F.lit(2**62) + F.col("id")).alias("v"))
    made = bitslice.planes(rows, "v")
    words = [w for r in made.collect() for w in r.planes]
    assert bitslice.word_checksum(made).first().checksum == sum(w % 2**64 for w in words) % 2**64


def test_pruning_never_changes_an_answer(spark):
    rng = random.Random(5)
    data = [(i, i // 64, rng.choice([None, i // 10, rng.randrange(900)]), rng.randrange(300), f"t{rng.randrange(40)}") for i in range(1000)]
    rows = spark.createDataFrame(data, "row_id bigint, rg bigint, status bigint, latency bigint, trace_id string").cache()
    meta = rowgroups.zone_maps(rows, ["status", "latency"]).cache()
    for _ in range(12):
        node = And(Eq("status", rng.randrange(120)), rng.choice([None, Gt("latency", rng.randrange(300)), Eq("trace_id", "t3"), Gt("row_id", 400)]))
        assert {r.row_id for r in rowgroups.pruned_scan(rows, meta, node).collect()} == {r.row_id for r in rows.filter(row_filter(node)).collect()}


def test_bloom_has_no_false_negative(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 1000).alias("rg"), F.concat(F.lit("k"), F.col("id")).alias("key"))
    filters = rowgroups.bloom_filters(rows, "key").cache()
    for i in (0, 7, 999, 1000, 1500, 2999):
        assert i // 1000 in {r.rg for r in rowgroups.bloom_contains(filters, f"k{i}").filter("hit").collect()}
    assert rowgroups.bloom_contains(filters, "absent").filter("hit").count() == 0


def test_metadata_tests(spark):
    meta = spark.createDataFrame([(0, 200, 404, 10, 85)], "rg int, min_status int, max_status int, min_latency int, max_latency int")
    zone = lambda f: (F.col(f"min_{f}"), F.col(f"max_{f}"))
    bloom = lambda f, v: F.lit(v == "abc-123")
    for node, kept in ((Eq("status", 500), 0), (Gt("latency", 100), 0), (Eq("trace_id", "xyz-999"), 0), (And(Eq("status", 200), Eq("trace_id", "abc-123")), 1), (None, 1)):
        assert meta.filter(may_match(node, zone, bloom)).count() == kept


def test_stream_restart(spark, tmp_path):
    source, target, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    lines_file(source / "1", ['{"status":200,"latency":45,"trace_id":"abc"}', '{"status":500}'])
    staging.ingest(spark, str(source), target, check).awaitTermination()
    lines_file(source / "2", ['{"status":404,"latency":12}'])
    for _ in range(2):
        staging.ingest(spark, str(source), target, check).awaitTermination()
    rows = spark.read.parquet(target).orderBy("status").collect()
    assert [(r.status, r.latency, r.trace_id) for r in rows] == [(200, 45, "abc"), (404, 12, None), (500, None, None)]


def test_recovery(spark, tmp_path):
    (tmp_path / "wal").write_bytes(b"a\r\n\n\r\nb\nc")
    assert [r.value for r in ndjson.recover_log(spark, str(tmp_path / "wal")).collect()] == ["a", "", "b", "c"]


def test_promotion(spark):
    rows = spark.createDataFrame([('{"k":5}',), ("{}",), ("bad",)], "props string")
    assert [r.k for r in promotion.promote(rows, "props", "k").collect()] == [5, None, None]
    with pytest.raises(ValueError):
        promotion.promote(rows, "props", "props")
    judged = spark.sql("SELECT 1 AS c, 0.05D AS d UNION ALL SELECT 9, 0.001D UNION ALL SELECT NULL, NULL").select(promotion.should_promote(F.col("c"), F.col("d")).alias("p"))
    assert [r.p for r in judged.collect()] == [True, False, False]
    assert promotion.fingerprint(rows) == promotion.fingerprint(rows) and promotion.slot(rows, "x") == -1


def test_command_line(spark, tmp_path, capsys):
    path = lines_file(tmp_path / "x.json", ['{"status":500,"latency":200}', '{"status":500,"latency":20}'])
    assert cli.main(["status == 500 AND latency > 100", path], spark) == 0
    assert "TOTAL MATCHING RECORDS : 1" in capsys.readouterr().out
    assert cli.main([], spark) == 1 and cli.main(["latency > 1", path + "none"], spark) == 1
    assert cli.main(["--convert", path, str(tmp_path / "o.agb")], spark) == 0


def test_wal_recover_reads_a_file(spark):
    made = queries.wal_recover(spark, "/root/testdata/sf0.001")
    assert made.inputFiles() and all("/wal/" in f for f in made.inputFiles())


def test_unsigned_values_in_block_file(spark, tmp_path):
    values = [2**63 - 1, 2**63, 2**64 - 1, 0]
    path = lines_file(tmp_path / "u.json", ["bad", *['  {"status": %d, "latency": %d, "severity": 3}' % (v, v) for v in values]])
    out, fields = str(tmp_path / "u.agb"), ("status", "latency", "severity")
    assert agb.convert(spark, path, out, fields)["records"] == 4
    got = bitslice.values(agb.read_blocks(spark, out, 4, fields), "p_status").orderBy("lane").collect()
    assert [r.value % 2**64 for r in got] == values
    assert [r.byte_offset for r in agb.read_index(spark, out + ".idx").orderBy("lane").limit(4).collect()] == [6 + sum(len('  {"status": %d, "latency": %d, "severity": 3}\n' % (v, v)) for v in values[:i]) for i in range(4)]
    agb.convert(spark, path, out)
    for v in values:
        assert agb.count_matches(spark, out, 4, v, 5) == (v > 5)
    rows = agb.reconstruct(spark, path, out, 4, agb.match_mask(2**63, 2**63 - 1)).collect()
    assert [r.value for r in rows] == ['{"status": %d, "latency": %d, "severity": 3}' % (2**63, 2**63)]
    with pytest.raises(ValueError):
        files.mounted("s3a://x/y")


def test_group_planes(spark):
    rows = spark.range(0, 70_000, 7).select(T.block(F.col("id")).alias("block"), T.lane(F.col("id")).alias("lane"), (F.col("id") % 5).alias("v"))
    got = {(r.rg, r.bit): r.words for r in bitslice.group_planes(bitslice.planes(rows, "v", 3)).collect()}
    assert set(got) == {(g, b) for g in (0, 1) for b in range(3)} and all(len(w) == 1024 for w in got.values())
    for (g, b), words in got.items():
        for i, w in enumerate(words):
            want = sum(1 << k for k in range(64) if (n := g * 65536 + i * 64 + k) < 70_000 and n % 7 == 0 and n % 5 >> b & 1)
            assert w % 2**64 == want


def test_typed_log_is_pruned_by_parquet(spark, sf_dir, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown = plan(queries.numeric_filter_count(spark, sf_dir))
    assert "EqualTo(status,69)" in shown and "GreaterThan(latency,20)" in shown and "props" not in shown
    assert "In(rg" in plan(queries.zone_pruned_scan(spark, "/root/testdata/sf0.01"))
    rows = spark.range(0, 8000, 1, 1).select(F.col("id").alias("row_id"), F.expr("id div 1000").alias("rg"), F.xxhash64("id").cast("string").alias("key"))
    rowgroups.write_grouped(rows, str(tmp_path / "g"), {"key": 8000}, 1000)
    asked = spark.read.parquet(str(tmp_path / "g")).filter(F.col("key") == "absent")
    for row in (asked, spark.read.parquet(str(tmp_path / "g")).filter("row_id > 6999")):
        scanned = row.select("row_id")
        scanned.collect()
        node = scanned._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().head()
        read = node.metrics().apply("numOutputRows").value()
        assert read <= 1000


def test_bloom_prunes_in_the_driver_of_pruning(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.expr("id div 1000").alias("rg"), (F.col("id") % 50).alias("latency"), F.concat(F.lit("t"), F.col("id")).alias("trace_id"))
    made = store.write(rows, f"file://{tmp_path}/s", ["latency", "row_id"], {"trace_id": 4000})
    node = And(Eq("trace_id", "t1500"), Gt("latency", -1))
    groups = lambda n: {r.rg for r in rowgroups.surviving_groups(made.zones(), n, {"trace_id": made.blooms("trace_id")}).collect()}
    assert 1 in groups(node) and len(groups(node)) < 4
    assert groups(And(node, Gt("row_id", 1999))) == set() and groups(Eq("other", "x")) == {0, 1, 2, 3}
    got = rowgroups.pruned_scan(made.rows(), made.zones(), node, {"trace_id": made.blooms("trace_id")})
    assert [r.row_id for r in got.collect()] == [1500]


def test_write_ahead_log(spark, tmp_path):
    log, target = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    assert wal.recover(spark, log).count() == 0 and wal.pending(spark, log) == []
    for batch, lines in ((0, ["a\r", "", "b"]), (1, ["c"]), (1, ['{"status":7}'])):
        wal.append(ndjson.staged_batch(spark, lines), log, batch)
    assert sorted((r.batch, r.value) for r in wal.recover(spark, log).collect()) == [(0, "a"), (0, "b"), (1, '{"status":7}')]
    wal.truncate(spark, log, 0)
    # What is left is stored before new lines are.
    assert staging.ingest_lines(spark, ['{"status":8}\n', "x\n", '{"status":9}'], target, log, 2) == 3
    rows = spark.read.parquet(target).groupBy("batch_id").agg(F.sum("status").alias("s")).orderBy("batch_id").collect()
    assert [(r.batch_id, r.s) for r in rows] == [(1, 7), (2, 8), (3, 9)] and wal.pending(spark, log) == []


def test_new_checkpoint_keeps_older_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines_file(tmp_path / "in" / "1", ['{"status":1}'])
    for n in (1, 2):
        staging.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"check{n}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_command_line_strict_and_stdin(spark, tmp_path, capsys):
    path = lines_file(tmp_path / "s.json", ['{"status":500,"name":"a"}', '{"status":500,"name":"b"}'])
    assert cli.main(["--strict", 'status >= 500 AND name == "b"', path], spark) == 0
    assert "TOTAL MATCHING RECORDS : 1" in capsys.readouterr().out
    assert cli.main(["--stream-ingest", str(tmp_path / "t")], spark, lines=['{"status":1}\n'] * 3) == 0
    assert "rows 3" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_reports(spark, tmp_path):
    stats = report.QueryStats()
    assert stats.run(lambda: spark.range(3))[2].id == 2 and stats.total == 1 and stats.longest > 0
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    assert len(report.interpreted(spark, lambda: spark.range(4))) == 4 and spark.conf.get(key) == before
    (tmp_path / "x").write_bytes(b"12345")
    assert report.storage(spark, str(tmp_path / "x"), str(tmp_path / "x"))["ratio"] == 1
