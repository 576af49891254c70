"""Operators in DataFrame functions: hand-made cases, and SQL over the driver's tables."""

import glob
import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from logspar.llm import chat_format, common, exact_dedup, mixing, registry, secrets, url_filter


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, wanted = registry.QUERIES[name](spark, sf_dir), db.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    order = lambda rows, names: sorted([tuple(repr(r[names.index(c)]) for c in columns) for r in rows])
    assert order([tuple(r) for r in got.collect()], got.columns) == order(wanted.fetchall(), wanted.columns)


DOCS = "doc_id bigint, text string, source string, lang string, _extra string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], DOCS)


def test_chat_round_trip(spark):
    said = ["<turn>", "</turn>\n", "<join>", "\\", "\\l", "\\\\b<", "", None, "é<turn>assistant\nx"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant", "assistant", None, "a\nb<c\\n", "assistant", "user", "assistant", "assistant"], said[c - 1 :] + said[: c - 1], strict=True))]
    rows += [(None, 0, "user", "x"), (3, 1, "assistant", "second"), (3, 0, "assistant", "first"), (3, 1, "assistant", "second")]
    made = chat_format.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, loss_mask int"))
    for r in chat_format.read_chats(made).collect():
        mine = sorted([(t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in mine]
        assert "".join(r.loss_text) == "".join(text for _, role, text in mine if role == "assistant")
    for r in made.collect():
        at, parts = 0, re.split("(?=<turn>|<join>)", r.formatted)
        assert len([p for p in parts if p]) == len(r.loss_mask) and at == 0
    assert chat_format.format_chats(made.sparkSession.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_url_lists(spark):
    entries = [("bad", "host", "x.com", "add", "2024-01-10"), ("bad", "host", "x.com", "add", "2024-01-10"), ("bad", "host", "x.com", "remove", "2024-01-20"), ("bad", "domain", "y.org", "add", "2024-01-01"), ("allow", "prefix", "a.y.org/ok", "add", "2024-02-01"), ("bad", "prefix", "z.net/p", "add", "2024-01-01")]
    list_ = url_filter.list_entries(spark, tuple(entries))
    urls = [(1, "http://x.com/a", "2024-01-09"), (2, "HTTP://u:p@X.com.:80/a?b", "2024-01-10"), (3, "http://x.com", "2024-01-20"), (4, "http://sub.x.com", "2024-01-15"), (5, "https://a.y.org/ok/1", "2024-01-15"), (6, "https://a.y.org/ok/1#f", "2024-02-02"), (7, "https://a.y.org/okay", "2024-02-02"), (8, "http://z.net/p", "2024-03-01"), (9, "http://z.net/pq", "2024-03-01"), (10, None, "2024-03-01"), (11, "nonsense", "2024-03-01"), (12, "http://y.org", None), (2, "http://x.com", "2024-01-12")]
    table = spark.createDataFrame([(a, b, c, "k") for a, b, c in urls], "page_id int, url string, fetch_date string, key string").withColumn("fetch_date", F.col("fetch_date").cast("date"))
    got = sorted((r.page_id, r.blocked, r.lists) for r in url_filter.url_verdicts(table, list_).collect())
    assert [p for p, b, _ in got if b] == [2, 2, 5, 7, 8]
    assert len(got) == 13 and (6, False, "allow,bad") in got
    assert url_filter.url_verdicts(table.limit(0), list_).count() == 0
    assert not [r for r in url_filter.url_verdicts(table, list_.limit(0)).collect() if r.blocked]


def test_url_entry_values(spark):
    entries = [("a", "prefix", "Example.org", "add", "2024-01-01"), ("b", "prefix", "example.org./en/", "add", "2024-01-01"), ("c", "domain", "Foo.com", "add", "2024-01-01"), ("c", "domain", "foo.com.", "remove", "2024-02-01"), ("d", "prefix", "/", "add", "2024-01-01")]
    urls = ["http://example.org", "http://example.org/en/x", "http://www.example.org/", "http://foo.com/", "http://example.org/end"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("fetch_date", F.lit("2024-03-01").cast("date"))
    got = {r.page_id: r.lists for r in url_filter.url_verdicts(table, url_filter.list_entries(spark, tuple(entries))).collect()}
    assert got == {0: "a", 1: "a,b", 2: "", 3: "", 4: "a"}


BASE = [("assign", re.compile(secrets.ASSIGN), 1, 8), ("access", re.compile(secrets.ACCESS), 0, 16), ("hex", re.compile(secrets.HEX), 0, 32)]


def test_secret_spans(spark):
    live = "q7Rt9zLm2KxW4vBn"
    texts = [f"token = '{live}'", "password: example-secret-1234567890", "password: example-secret-1234567890", "secret:token:abcdefghijk", "é AKIA" + "A1" * 8 + " " + "0123456789abcdef" * 2 + "g", "api_key=short", None, "", "TOKEN=" + "ab12" * 10 + " x" * 5000 + " passwd=zzzzzzzz9"]
    rows = [(i, t, f"s{i % 4}", "en") for i, t in enumerate(texts)] + [(1, texts[1], None, "en")]
    got = secrets.secret_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= n)
        assert [tuple(s) for s in r.base] == spans
    by = {r.doc_id: [tuple(s) for s in r.live] for r in got}
    assert by[0] == [(9, 3, 25)] and by[1] == [] and by[6] == []
    assert secrets.secret_spans(docs(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}" if i % 5 else None, "en") for i in range(400)] + [(400, None, "s0", "en"), (401, "x " * 3000, "s1", "en"), (7, "w " * 7, "s1", "en")]
    got = mixing.mix_plan(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got and all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        targets[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    names = sorted(filter(None, sizes)) + [None]
    weight, left, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, float(sum(sizes.values())), set()
    while True:  # shares, capped and reshared in rounds
        free = [s for s in names if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert targets[s] == pytest.approx(3 * sizes[s] if s in full else share[s])
        assert abs(taken[s] - targets[s]) <= 3000
    assert sum(taken.values()) <= left
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_plan(docs(spark, rows)).collect()))
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    mixed = mixing.mix_documents(docs(spark, rows[:300]))
    assert mixed.columns == docs(spark, []).columns and mixed.count() > 100


def test_exact_dedup(spark):
    long = "x" * 100_000
    rows = [(1, "a", "s", None), (2, "a", "s", None), (2, "a", "s", None), (3, "b", "s", None), (4, None, None, None), (5, "", "s", None), (None, "a", "s", None), (6, long, "s", None), (7, long + "y", "s", None), (8, long, "t", None), (9, "b" * 64 + "1", "s", None), (10, "b" * 64 + "2", "s", None)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = sorted(r.doc_id for r in got if r.kept)
    assert kept == [2, 3, 5, 7, 8, 9, 10]
    assert {r.group_size for r in got if r.doc_id in (1, 2, None)} == {4}
    left = exact_dedup.drop_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == kept and left.columns == docs(spark, []).columns
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0 and exact_dedup.drop_copies(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_running_sum(spark):
    rows = [(i % 3 and "hot" or "cold", i, i % 7) for i in range(500)]
    got = common.running_sum(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], "v", "before").collect()
    for r in got:
        assert r.before == sum(v for k, o, v in rows if k == r.k and o < r.o)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_chat_ties_follow_raw_texts(spark):
    rows = [(1, 0, "user", "<b"), (1, 0, "user", "Ab"), (1, 0, "us<er", "z"), (1, 0, "user", "\\a"), (1, None, "user", "first")]
    made = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert [(t.role, t.text) for t in made.turns] == [("user", "first"), ("us<er", "z"), ("user", "<b"), ("user", "Ab"), ("user", "\\a")]


def test_url_list_of_thousands(spark):
    """A long list, broadcast and joined by a shuffle, against a plain reading of it."""
    entries = [("spam", "host", f"h{i}.org", action, f"2024-0{1 + (i + k) % 9}-01") for i in range(1500) for k, action in enumerate(("add", "remove"))]
    list_ = spark.createDataFrame(entries, "list_name string, kind string, value string, action string, on_date string").withColumn("on_date", F.col("on_date").cast("date"))
    table = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")), F.lit(".org/x")).alias("url"), F.lit("2024-05-15").cast("date").alias("fetch_date"))
    want = set()
    for p in range(3000):
        i = 7 if p % 3 == 0 else p
        days = sorted((d, a) for _, _, v, a, d in entries if v == f"h{i}.org" and d <= "2024-05-15") if i < 1500 else []
        if days and days[-1][1] == "add":
            want.add(p)
    for size in (common.BROADCAST_BYTES, 0):
        kept, common.BROADCAST_BYTES = common.BROADCAST_BYTES, size
        try:
            assert {r.page_id for r in url_filter.url_verdicts(table, list_).filter("blocked").collect()} == want
        finally:
            common.BROADCAST_BYTES = kept


def test_secret_ownership(spark):
    """Repositories and owners are separate; a value of two owners is a copied example."""
    rows = [(1, "token=q7Rt9zLm2KxW4vBn", "r1", "ann"), (2, "token=q7Rt9zLm2KxW4vBn", "r2", "ann"), (3, "x token=copyd1234efgh567", "r1", "ann"), (4, "token=copyd1234efgh567", "r3", "bob")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, repo string, owner string")
    got = {r.doc_id: r for r in secrets.secret_spans(table, repo_col="repo", owner_col="owner").collect()}
    assert [len(got[i].live) for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert [tuple(x) for x in got[3].copied] == [(2, 0, 24, 2, 2)] and not got[1].copied


def test_mixing_rows_that_share_ids(spark):
    """Each row comes as often as the plan takes it, however the table is cut and the ids repeat."""
    rows = [(i % 5, "w " * (1 + i % 7), f"s{i % 3}", "en") for i in range(60)] + [(None, "n n", None, "en")] * 3 + [(9, None, "s0", "en")]
    table = docs(spark, rows)
    plan = {}
    for r in mixing.mix_plan(table).collect():
        key = (r.doc_id, r.size, r.source)
        plan[key] = plan.get(key, 0) + (r.taken // r.size if r.size else 0)
    for cut in (table, table.repartition(3), table.coalesce(1)):
        out = {}
        for r in mixing.mix_documents(cut).collect():
            key = (r.doc_id, len(r.text.split()), r.source)
            out[key] = out.get(key, 0) + 1
        assert out == {k: v for k, v in plan.items() if v}
    clash = table.withColumnRenamed("_extra", "_ls_times").withColumn("_ls_id", F.lit(1))
    assert mixing.mix_documents(clash).columns == clash.columns and mixing.mix_documents(clash).count() == sum(plan.values())


def test_drop_copies_keeps_columns(spark):
    rows = [(1, "a", "s", None), (1, "a", "t", None), (1, "b", "s", None), (None, None, "s", None), (None, "", "s", None), (2, "a" * 70, "s", None), (3, "a" * 70, "s", None)]
    clash = docs(spark, rows).withColumnRenamed("_extra", "_ls_sha").withColumn("_LS_id", F.lit(1)).withColumn("_ls_hit", F.lit(True))
    left = exact_dedup.drop_copies(clash)
    assert left.columns == clash.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in left.collect()) == [(0, ""), (1, "a"), (1, "b"), (3, "aa")]


def test_spread_join(spark):
    """Hot keys are split, and a join's rows are the same."""
    big = spark.range(4000).select((F.col("id") % 7).alias("k"), "id").withColumn("k", F.when(F.col("id") < 2500, 0).otherwise(F.col("k")))
    right = big.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 3")
    for how in ("inner", "left"):
        got = common.spread_join(big, right, ["k"], "n", 4000, ["id"], how)
        assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in big.join(right, "k", how).collect())


def test_drop_copies_of_rows_that_repeat_ids(spark):
    rows = [(1, "a", {"k": 1}, "x")] * 5 + [(2, "a", {"k": 2}, "y")] * 4 + [(None, "b", None, "z")] * 3 + [(3, None, None, None)] * 2 + [(4, "", {"k": 1}, "q"), (5, "c", None, "w"), (5, "c", {"k": 3}, "w")]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, `a.b` string"))
    assert left.columns == ["doc_id", "text", "m", "a.b"]
    got = sorted([tuple(r) for r in left.collect()], key=lambda r: r[0] or 0)
    assert got[:3] == [(None, "b", None, "z"), (2, "a", {"k": 2}, "y"), (4, "", {"k": 1}, "q")]
    assert len(got) == 4 and got[3] in [(5, "c", None, "w"), (5, "c", {"k": 3}, "w")]
