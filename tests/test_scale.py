"""What one task or the driver holds doesn't grow with the table."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspar import file_queries
from logspar.sources import agb, files, ndjson
from logspar.streaming import staging, wal


def most_read(spark, run):
    """Rows that the largest task got from shuffles, among the tasks that ``run`` started."""
    context = spark.sparkContext._jsc.sc()

    def tasks():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        for stage in (stages.apply(i) for i in range(stages.size())):
            found = context.statusStore().taskList(stage.stageId(), stage.attemptId(), 10_000)
            for task in (found.apply(i) for i in range(found.size())):
                if task.taskMetrics().isDefined():
                    yield task.taskId(), task.taskMetrics().get().shuffleReadMetrics().recordsRead()

    before, key = dict(tasks()), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # small tables would be put together
    try:
        run()
    finally:
        spark.conf.unset(key)
    return max((n for task, n in tasks() if task not in before), default=0)


def test_log_file_is_no_single_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(file_queries, "_MADE", {})
    paths = []
    largest = most_read(spark, lambda: paths.append(file_queries.log_file(spark, sf_dir)))
    want = [r.value for r in file_queries._lines(spark, sf_dir).orderBy("event_id").collect()]
    assert open(files.mounted(paths[0]), newline="").read() == "".join(x + "\n" for x in want)
    assert largest < len(want) / 2


@pytest.mark.parametrize("mounted", [True, False])
def test_parts_make_one_file(spark, tmp_path, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(files, "mounted", lambda path: (_ for _ in ()).throw(ValueError(path)))
    for n in (0, 1, 500):
        rows = spark.range(n, numPartitions=3).select((-F.col("id")).alias("k"), F.concat(F.lit("é"), F.col("id").cast("string"), F.lit("\r")).alias("value"))
        ndjson.write_file(rows, "k", f"file://{tmp_path}/{n}")
        assert (tmp_path / str(n)).read_bytes().decode() == "".join(f"é{i}\r\n" for i in reversed(range(n)))
        assert not (tmp_path / f"{n}-parts").exists()


def test_lines_of_one_split_are_numbered_by_many_tasks(spark, tmp_path, monkeypatch):
    lines = [("bad" if i % 9 == 4 else " " * (i % 3) + '{"i":%d}' % i) + "\r" * (i % 2) for i in range(20_000)]
    (tmp_path / "log").write_text("".join(x + "\n" for x in lines), newline="")
    monkeypatch.setattr(ndjson, "CHUNK_LINES", 1000, raising=False)
    rows = []
    assert spark.read.text(str(tmp_path / "log")).rdd.getNumPartitions() == 1
    assert most_read(spark, lambda: rows.extend(ndjson.numbered_lines(spark, str(tmp_path / "log"), documents=True).collect())) < 12_000
    data, whole = (tmp_path / "log").read_bytes(), [x for x in lines if x != "bad" and x != "bad\r"]
    assert [r.value for r in sorted(rows, key=lambda r: r.row_id)] == whole and sorted(r.row_id for r in rows) == list(range(len(whole)))
    assert all(data[r.byte_offset :].startswith(r.value.lstrip(" ").encode()) for r in rows)


def test_offsets_of_matches_need_no_join(spark, sf_dir):
    found = file_queries.agb_reconstruct(spark, sf_dir)
    assert found.count() and found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
    path, stats = file_queries.block_file(spark, sf_dir)
    both = agb.read_blocks(spark, path, stats["records"], index=True).select("block", F.posexplode("offsets").alias("lane", "byte_offset"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, agb.read_index(spark, path + ".idx").collect()))
    plan = agb.reconstruct(spark, file_queries.log_file(spark, sf_dir), path, stats["records"], agb.match_mask(69, 20))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((block" not in plan


def test_round_trip_moves_no_row(spark, sf_dir):
    assert "Exchange" not in file_queries.agb_roundtrip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_table_stay_off_the_driver(spark, sf_dir, monkeypatch):
    def held(*_):
        raise AssertionError("lines at the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", held)
    monkeypatch.setattr(ndjson, "staged_batch", held)
    assert sum(r.n for r in file_queries.line_ingest(spark, sf_dir).collect()) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_numbered_lines_are_taken_in_batches(spark, tmp_path):
    log, target = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    wal.append(ndjson.staged_batch(spark, ['{"status":7}']), log, 4)
    lines = spark.createDataFrame([(i, '{"status":%d}' % i if i else "") for i in range(5)], "row_id bigint, value string")
    assert staging.ingest_numbered(spark, lines, target, log, 2) == 5 and wal.pending(spark, log) == []
    assert sorted((r.batch_id, r.value) for r in spark.read.parquet(target).collect()) == [(4, '{"status":7}'), (5, ""), (5, '{"status":1}'), (6, '{"status":2}'), (6, '{"status":3}'), (7, '{"status":4}')]
    assert staging.ingest_numbered(spark, lines.limit(0), target, log, 2) == 0
