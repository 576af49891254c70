"""Embedding near-dedup by NN-descent.

Vectors are compared only within one label. Equal vectors are one node that
stands for all its copies. Every node has a list of its nearest neighbours found
so far. Lists start from rows next to each other in several locality-sensitive
orders. Then, in rounds, all that are around one node, its neighbours and those
that have it as theirs, are compared with each other (neighbours of neighbours),
and better ones enter the lists. Only around nodes where something is new is
anything compared. A hub, which very many list, deals them to blocks, anew in
each round; it drops none.

A list has LIST entries. One whose entries are all links (at the threshold or
above) is saturated and is enlarged: it keeps links up to LARGEST. A node that
saturates this too leaves the search and is compared with all nodes of its part
instead, in blocks and without making pairs. So a link may be missed only
between two nodes that both have fewer than LARGEST links.

A part is the nodes of one label and length. Orders are made about its centre,
with bits that follow its size. What the search finds is audited: by nodes, a
scan of all for a sample of them, those with a single link apart; and by probes,
vectors planted at the threshold from sampled nodes, which take part in the
search and stand for lone pairs, so the recall is measured where no sampled node
has a link. A part that falls short gets more orders, and one that still does
when more would cost what a scan costs has all its nodes compared with all.
Every similarity is computed in double precision.

Cases: a vector that is null, empty, zero or holds a null or non-finite component,
or whose label is null, links with nothing; vectors of different lengths are not
compared; rows that repeat a ``vec_id`` are vectors of their own; a null
``vec_id`` is above all others; very large and very small components are scaled;
an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspar.llm.common import connected_components, spread_join, stage, stage_measured, unstage

THRESHOLD = 0.98
#: Neighbours in a list, and in one that all are links.
LIST, LARGEST = 8, 64
#: Orders to begin with, and at most while a scan would copy a row fewer times; most hyperplane bits of an order; rows compared on either side of each.
ORDERS, MOST_ORDERS, BITS, AHEAD = 6, 14, 24, 64
#: Rows that meet around a node at once, and rounds after which the audit is asked.
MEET, ROUNDS = 64, 8
#: Nodes of a part audited, and as many probes; parts audited, the largest first; and the recall asked for of each.
AUDIT, AUDITED_PARTS, RECALL = 200, 200, 0.97

NEIGHBOURS = "node bigint, nbrs array<bigint>, sims array<double>, old array<boolean>"


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class _Packed:
    """Unit vectors in double precision out of a column of packed ones."""

    def __init__(self, column: pa.Array, kind: str):
        self.ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        self.data, self.kind = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.dtype(kind)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Of the rows from ``lo`` to ``hi``, which have one length."""
        flat = self.data[self.ends[lo] : self.ends[hi]].view(self.kind).astype(np.float64)
        return _unit(flat.reshape(hi - lo, -1)) if hi > lo else np.zeros((0, 1))


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """``row, vec_id, part, vec`` and the vectors' kind: vec is the components' bytes,
    null (as part) for a vector that links with nothing."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind, name = ("<f4", "float") if element == "float" else ("<f8", "double")
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{name}>").alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = (column.flatten().to_numpy(zero_copy_only=False) + np.dtype(kind).type(0)).astype(kind)  # -0.0 becomes 0.0
            ends = np.cumsum(size)
            count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[ends] - c[ends - size]  # noqa: B023, E731
            ok = (size > 0) & (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            data, w = flat.tobytes(), flat.itemsize
            vec = [data[(e - n) * w : e * w] if o else None for o, n, e in zip(ok.tolist(), size.tolist(), ends.tolist(), strict=True)]
            part = [f"{n}:{x}" if o else None for o, n, x in zip(ok.tolist(), size.tolist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.string()), pa.array(vec, pa.binary())], names=["row", "vec_id", "part", "vec"])

    return rows.mapInArrow(pack, f"row bigint, vec_id {id_type}, part string, vec binary"), kind


def _runs(batches: Iterator[pa.RecordBatch], keys: list[int], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on tables of whole runs of equal keys, with the runs' borders;
    rows come sorted by the keys."""

    def borders(batch: pa.RecordBatch) -> np.ndarray:
        change, n = np.zeros(batch.num_rows - 1, bool), batch.num_rows
        for k in keys:
            x = batch.column(k)
            change |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = borders(batch)
        if len(ends) > 2 or (len(held) > 1 and len(borders(pa.concat_batches([held[-2].slice(held[-2].num_rows - 1), batch.slice(0, 1)]))) > 2):
            every = pa.concat_batches(held)
            ends = borders(every)
            cut = int(ends[-2])
            yield from work(every.slice(0, cut), ends[:-1])
            held = [every.slice(cut)]
    if held:
        every = pa.concat_batches(held)
        yield from work(every, borders(every))


def _lists(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, old: np.ndarray) -> pa.RecordBatch:
    """One row a node with its best neighbours: LIST, or more if all are links."""
    order = np.lexsort((~old, nbr, node))  # of one pair's entries the first, an old one if there is any
    node, nbr, sim, old = node[order], nbr[order], sim[order], old[order]
    first = np.append(True, (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1]))[: len(node)]
    node, nbr, sim, old = node[first], nbr[first], sim[first], old[first]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim, old = node[order], nbr[order], sim[order], old[order]
    heads = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    start = heads(node)
    rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    keep = (rank < LIST) | (sim >= THRESHOLD) & (rank < LARGEST)
    node, nbr, sim, old = node[keep], nbr[keep], sim[keep], old[keep]
    start = heads(node)
    offsets = pa.array(np.append(start, len(node)), pa.int32())
    some = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (nbr.astype(np.int64), sim.astype(np.float64), old.astype(bool))]
    return pa.RecordBatch.from_arrays([pa.array(node[start].astype(np.int64)), *some], names=["node", "nbrs", "sims", "old"])


def merged(some: DataFrame) -> DataFrame:
    """One list for each node out of partial ones."""

    def work(batch: pa.RecordBatch, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False)
        yield _lists(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size), flat(1), flat(2), flat(3).astype(bool))

    return some.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: _runs(batches, [0], work), NEIGHBOURS)


def parts_of(table: DataFrame, kind: str) -> DataFrame:
    """``part, n, centre``: nodes of each part, and the mean of their unit vectors, packed."""

    def emit(sums: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s.tobytes() for _, s in sums.values()], pa.binary())], names=["part", "n", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), dtype=object)
            for part in set(parts.tolist()):
                took = batch.column(1).take(pa.array(np.flatnonzero(parts == part)))
                n, s = sums.get(part, (0, 0))
                sums[part] = [n + len(took), s + _Packed(took, kind).rows(0, len(took)).sum(axis=0)]
            if len(sums) > 1000:  # a task of very many parts doesn't hold them all
                yield emit(sums)
                sums = {}
        yield emit(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, 0
        for batch in batches:
            for part, m, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield emit({at: [n, total / n]})
                    at, n, total = part, 0, 0
                n, total = n + m, total + np.frombuffer(s)
        if at is not None:
            yield emit({at: [n, total / n]})

    schema = "part string, n bigint, total binary"
    sums = table.select("part", "vec").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part")
    return sums.mapInArrow(add, schema).withColumnRenamed("total", "centre")


def sampled(table: DataFrame, audited: DataFrame, kind: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Node ids and unit vectors of up to AUDIT nodes, a tenth at most, of each part of ``audited``."""
    w = W.partitionBy("part").orderBy(F.xxhash64("node"), "node")
    first = table.select("node", "part").join(F.broadcast(audited.select("part", "n")), "part").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= AUDIT)
    rows = first.filter(F.col("rank") <= F.ceil(F.col("n") / 10)).select("node").join(table, "node")
    by: dict[str, tuple[list[int], list[np.ndarray]]] = {}
    for r in rows.select("part", "node", "vec").collect():
        ids, vecs = by.setdefault(r.part, ([], []))
        ids.append(r.node)
        vecs.append(np.frombuffer(r.vec, kind).astype(np.float64))
    return {p: (np.array(i), _unit(np.array(v))) for p, (i, v) in by.items()}


def probes(sample: dict[str, tuple[np.ndarray, np.ndarray]], kind: str) -> list[tuple[int, str, bytes]]:
    """``node, part, vec`` of a vector at the threshold from each sampled node n; its id is -1 - n."""
    made = []
    for seed, (part, (ids, unit)) in enumerate(sorted(sample.items())):
        if unit.shape[1] == 1:
            continue
        away = np.random.default_rng(seed).standard_normal(unit.shape)
        away = _unit(away - (away * unit).sum(axis=1, keepdims=True) * unit)
        at = (THRESHOLD + 1e-6) * unit + np.sqrt(1 - (THRESHOLD + 1e-6) ** 2) * away
        made += [(-1 - n, part, v.astype(kind).tobytes()) for n, v in zip(ids.tolist(), at, strict=True)]
    return made


def first_lists(table: DataFrame, parts: DataFrame, n_nodes: int, kind: str, orders: range) -> DataFrame:
    """Partial lists of neighbours near each other in some order.

    An order sorts nodes by the signs of random projections, as many as follow
    from the part's size and taken from its centre, and then by one more
    projection. Each task walks its sorted rows and compares each row with the
    AHEAD rows on either side; the work is linear in the nodes.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array(batch.column(1).to_pylist(), dtype=object)
            for part in set(parts.tolist()):
                took = batch.take(pa.array(np.flatnonzero(parts == part)))
                off = _Packed(took.column(2), kind).rows(0, took.num_rows) - np.frombuffer(took.column(4)[0].as_py())
                bits = min(BITS, max(0, round(np.log2(took.column(3)[0].as_py() / (4 * AHEAD)))))
                for t in orders:
                    planes = np.random.default_rng(1000 + t).standard_normal((off.shape[1], BITS + 1))
                    at = off @ planes
                    code = ((at[:, :bits] > 0) * (1 << np.arange(bits))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(off), t, np.int32)), took.column(1), pa.array(code.astype(np.int32)), pa.array(at[:, BITS]), took.column(0), took.column(2)], names=["t", "part", "code", "at", "node", "vec"])

    def near(unit: np.ndarray, node: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Entries of the rows from ``lo`` to ``hi`` out of one run."""
        found = []
        for x in range(lo, hi, AHEAD):
            y = min(x + AHEAD, hi)
            left, right = max(0, x - AHEAD), min(len(unit), y + AHEAD)
            sim = unit[x:y] @ unit[left:right].T
            gap = np.abs(np.arange(x, y)[:, None] - np.arange(left, right)[None, :])
            sim[(gap == 0) | (gap > AHEAD)] = -2.0
            k = min(LIST, sim.shape[1])
            j = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(y - x), k)
            j = j.ravel()
            many = np.flatnonzero((sim >= THRESHOLD).sum(axis=1) > LIST)
            if len(many):  # their lists are enlarged
                top = min(LARGEST, sim.shape[1])
                more = np.argpartition(-sim[many], top - 1, axis=1)[:, :top]
                at = np.repeat(many, top), more.ravel()
                link = sim[at] >= THRESHOLD
                i, j = np.concatenate([i, at[0][link]]), np.concatenate([j, at[1][link]])
            ok = sim[i, j] > -2.0
            i, j = i[ok], j[ok]
            found.append((node[x + i], node[left + j], sim[i, j]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3)) if found else ()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, done = None, 0

        def settle(batch: pa.RecordBatch, done: int, last: bool) -> Iterator[pa.RecordBatch]:
            # Rows from ``done`` on that have all they are compared with.
            n = batch.num_rows
            until = n if last else max(done, n - AHEAD)
            t, part = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), dtype=object)
            node, vec = batch.column(4).to_numpy(zero_copy_only=False), _Packed(batch.column(5), kind)
            starts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), n]
            found = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                a, b = max(lo, done), min(hi, until)
                if b > a:
                    found.append(near(vec.rows(lo, hi), node[lo:hi], a - lo, b - lo))
            found = [f for f in found if f]
            if found:
                a, b, s = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield _lists(a, b, s, np.zeros(len(a), bool))

        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.concat_batches([carry, batch])
            yield from settle(batch, done, False)
            n = batch.num_rows
            until = max(done, n - AHEAD)
            back = max(0, until - AHEAD)
            carry, done = batch.slice(back), until - back
        if carry is not None:
            yield from settle(carry, done, True)

    rows = spread_join(table.select("node", "part", "vec"), parts, ["part"], "n", n_nodes, ["node"]).select("node", "part", "vec", "n", "centre")
    placed = stage(rows.mapInArrow(keyed, "t int, part string, code int, at double, node bigint, vec binary"), "orders")
    ordered = placed.repartitionByRange("t", "part", "code", "at").sortWithinPartitions("t", "part", "code", "at")
    return ordered.mapInArrow(compare, NEIGHBOURS)


def links_in() -> Column:
    """How many entries of a list are links."""
    return F.size(F.filter("sims", lambda s: s >= THRESHOLD))


def stage_lists(some: DataFrame) -> tuple[DataFrame, dict]:
    """Merged lists, written, with their numbers of links and entries and whether any is new."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return stage_measured(merged(some), "lists", links=total(links_in()), entries=total(F.size("nbrs")), fresh=total(F.size(F.filter("old", lambda x: ~x))), settled=total(links_in() >= LARGEST))


def descend(lists: DataFrame, entries: int, table: DataFrame, kind: str, turn: int) -> DataFrame:
    """One round: what is around a node is compared with each other, where at
    least one of the two is new there. Partial lists come out, with only what
    betters the lists there are."""
    state = lists.filter(links_in() < LARGEST)
    each = state.select("node", F.explode(F.arrays_zip("nbrs", "old")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.old").alias("old"))
    told = each.select(F.col("nbr").alias("hub"), F.col("node").alias("member"), "old").unionAll(each.select(F.col("node").alias("hub"), F.col("nbr").alias("member"), "old"))
    heard = told.groupBy("hub", "member").agg(F.min("old").alias("old"))
    hubs = heard.groupBy("hub").agg(F.count("*").alias("n"), F.min("old").alias("done")).filter("n > 1 AND NOT done")
    block = F.pmod(F.xxhash64("member", F.lit(turn)), F.ceil(F.col("n") / MEET)).cast("int")
    around = spread_join(heard, hubs, ["hub"], "n", 2 * entries, ["member"]).select("hub", block.alias("block"), "member", "old")
    # What betters a list: any neighbour of a short one, a link of a saturated one, else more than its last.
    worst = F.when(F.size("sims") < LIST, F.lit(-2.0)).when(links_in() >= LIST, F.lit(THRESHOLD - 1e-9)).otherwise(F.element_at("sims", LIST))
    known = state.select("node", worst.alias("worst")).join(table.select("node", "vec"), "node")
    gathered = around.join(known, around["member"] == known["node"]).select("hub", "block", "member", "old", "worst", "vec")

    def work(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        member, worst = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
        old, vec = batch.column(3).to_numpy(zero_copy_only=False).astype(bool), _Packed(batch.column(5), kind)
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if hi - lo > 1 and not old[lo:hi].all():
                unit, who, was = vec.rows(lo, hi), member[lo:hi], old[lo:hi]
                sim = unit @ unit.T
                better = (sim > worst[lo:hi, None]) & ~(was[:, None] & was[None, :]) & (who[:, None] != who[None, :])
                i, j = np.nonzero(better)
                found.append((who[i], who[j], sim[i, j]))
        if found:
            a, b, s = (np.concatenate([f[k] for f in found]) for k in range(3))
            yield _lists(a, b, s, np.zeros(len(a), bool))

    return gathered.repartition("hub", "block").sortWithinPartitions("hub", "block").mapInArrow(lambda batches: _runs(batches, [0, 1], work), NEIGHBOURS)


def true_links(table: DataFrame, sample: dict[str, tuple[np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """``part, a, b``: all links of the sampled nodes a, by a scan of all nodes."""
    asked = table.sparkSession.sparkContext.broadcast(sample)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array(batch.column(1).to_pylist(), dtype=object)
            for p in set(parts.tolist()) & asked.value.keys():
                ids, unit = asked.value[p]
                took = batch.take(pa.array(np.flatnonzero(parts == p)))
                node = took.column(0).to_numpy(zero_copy_only=False)
                i, j = np.nonzero((unit @ _Packed(took.column(2), kind).rows(0, took.num_rows).T >= THRESHOLD) & (ids[:, None] != node[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(i), pa.string()), pa.array(ids[i], pa.int64()), pa.array(node[j], pa.int64())], names=["part", "a", "b"])

    return table.select("node", "part", "vec").mapInArrow(look, "part string, a bigint, b bigint")


def links_of(lists: DataFrame) -> DataFrame:
    """``a, b`` of every link in a list."""
    each = lists.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e"))
    return each.filter(F.col("e.sims") >= THRESHOLD).select("a", F.col("e.nbrs").alias("b"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def audit(truth: DataFrame, links: DataFrame, settled: DataFrame, sample: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """Recall by part: the least of the mean share of a sampled node's links that
    are found, the mean over nodes with one link, and the share of probes found.
    Links of a settled node count as found: it is going to be compared with all."""
    spark = truth.sparkSession
    hit = links.select("a", "b", F.lit(1).alias("hit"))
    done = lambda x: settled.select(F.col("node").alias(x), F.lit(1).alias(f"done_{x}"))
    seen = truth.join(hit, ["a", "b"], "left").join(done("a"), "a", "left").join(done("b"), "b", "left")
    by_node = seen.groupBy("part", "a").agg(F.count("*").alias("n"), F.count(F.coalesce("hit", "done_a", "done_b")).alias("hits"))
    share = F.col("hits") / F.col("n")
    found = {r.part: min(r.of_all, 1.0 if r.of_lone is None else r.of_lone) for r in by_node.groupBy("part").agg(F.avg(share).alias("of_all"), F.avg(F.when(F.col("n") == 1, share)).alias("of_lone")).collect()}
    ids = [(p, int(n)) for p, (nodes, unit) in sample.items() if unit.shape[1] > 1 for n in nodes]
    asked = F.broadcast(spark.createDataFrame(ids, "part string, node bigint"))
    own = F.when(F.col("node") < 0, -1 - F.col("node")).otherwise(F.col("node")).alias("node")
    caught = links.filter("a < 0 AND b = -1 - a").select(F.col("b").alias("node")).unionAll(settled.select(own)).distinct()
    for r in asked.join(caught, "node").groupBy("part").agg(F.count("*").alias("n")).collect():
        sample_size = len(sample[r.part][0])
        found[r.part] = min(found.get(r.part, 1.0), r.n / sample_size)
    met = {r for r in found}
    return found | {p: 0.0 for p, (nodes, unit) in sample.items() if unit.shape[1] > 1 and p not in met}


def search(table: DataFrame, parts: DataFrame, n_nodes: int, kind: str) -> tuple[DataFrame, dict[str, float]]:
    """Lists found for all nodes, by the rounds described above, and the recall
    of each audited part."""
    spark = table.sparkSession
    audited = stage(parts.filter(F.col("n") > 2 * AHEAD).select("part", "n").orderBy(F.desc("n"), "part").limit(AUDITED_PARTS), "audited")
    sizes = {r.part: r.n for r in audited.collect()}
    sample = sampled(table, audited, kind) if sizes else {}
    planted = spark.createDataFrame(probes(sample, kind), "node bigint, part string, vec binary")
    sown = stage(table.select("node", "part", "vec").unionAll(planted), "sown")
    cur, seen = stage_lists(first_lists(sown, parts, n_nodes, kind, range(ORDERS)))
    made, turn, truth = dict.fromkeys(sizes, ORDERS), 0, None
    while True:
        for _ in range(ROUNDS):
            if not seen["fresh"]:
                break
            known, links = cur.withColumn("old", F.transform("old", lambda x: F.lit(True))), seen["links"]
            nxt, seen = stage_lists(known.unionAll(descend(cur, seen["entries"], sown, kind, turn)))
            unstage(cur)
            cur, turn = nxt, turn + 1
            if seen["links"] - links <= 0.001 * links:
                break
        if not sample:
            return cur, {}
        settled = cur.filter(links_in() >= LARGEST).select("node")
        truth = truth or stage(true_links(table, sample, kind).join(settled.withColumnRenamed("node", "a"), "a", "left_anti"), "true-links")
        recall = audit(truth, stage(both_ways(links_of(cur)), "links"), settled, sample)
        # A scan copies a row once for each block of its part, an order once.
        most = {p: max(MOST_ORDERS, sizes[p] // block_rows(sizes[p])) for p, share in recall.items() if share < RECALL}
        more = {p: min(2 * made[p], m) for p, m in most.items() if made[p] < m}
        if not more:
            return cur, recall
        again = cur
        for stop in sorted(set(more.values())):
            some = [p for p, x in more.items() if x == stop]
            again = again.unionAll(first_lists(sown.filter(F.col("part").isin(some)), parts, n_nodes, kind, range(min(made[p] for p in some), stop)))
            made |= dict.fromkeys(some, stop)
        nxt, seen = stage_lists(again)
        unstage(cur)
        cur = nxt


def block_rows(n: int) -> int:
    """Nodes in a block of the scan of a part of n: each is copied about sqrt(n) / 16 times."""
    return int(min(4096, max(256, 16 * n**0.5)))


def _reach(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links, the row that stands for
    what each reaches; -1 for one without a link."""
    across, down = near, np.ascontiguousarray(near.T)
    rows, cols = (np.full(n, -1) for n in near.shape)
    for first in np.flatnonzero(near.any(axis=1)):
        if rows[first] < 0:
            rows[first] = first
            front = np.array([first])
            while len(front):
                met = np.flatnonzero(across[front].any(axis=0) & (cols < 0))
                cols[met] = first
                front = np.flatnonzero(down[met].any(axis=0) & (rows < 0)) if len(met) else met
                rows[front] = first
    return rows, cols


def scan(table: DataFrame, asked: DataFrame, parts: DataFrame, n_nodes: int, kind: str) -> DataFrame:
    """``node, n, to``: all links of the nodes of ``asked``, counted exactly against
    all nodes of their parts; to be summed by node. Of another node, those with
    asked ones are counted. ``to`` is a node that links of the same block reach.

    Both sides are cut into blocks by hash. Each pair of blocks gives one row a
    node at most; no pairs are made.
    """
    flagged = table.join(asked.select("node", F.lit(True).alias("asked")), "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    wanted = flagged.filter("asked").groupBy("part").agg(F.count("*").alias("n_asked"))
    size = F.least(F.lit(4096), F.greatest(F.lit(256), F.floor(16 * F.sqrt("n"))))
    shape = stage(parts.select("part", "n").join(wanted, "part").select("part", "n", F.ceil(F.col("n_asked") / size).alias("ks"), F.ceil(F.col("n") / size).alias("kn")), "scan-shape")
    placed = spread_join(flagged, shape, ["part"], "n", n_nodes, ["node"])
    zero, own = F.lit(0).cast("long"), ["part", "node", "asked", "copies", "vec"]
    every = placed.select(F.explode(F.sequence(zero, F.col("ks") - 1)).alias("s"), F.pmod(F.xxhash64("node"), F.col("kn")).alias("b"), F.lit(False).alias("asks"), *own)
    asking = placed.filter("asked").select(F.pmod(F.xxhash64("node", F.lit(1)), F.col("ks")).alias("s"), F.explode(F.sequence(zero, F.col("kn") - 1)).alias("b"), F.lit(True).alias("asks"), *own)

    def work(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        asks, was = (np.array(batch.column(k).to_pylist(), bool) for k in (2, 5))
        node, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 6))
        vec = _Packed(batch.column(7), kind)
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            unit, q = vec.rows(lo, hi), asks[lo:hi]
            u, v, a, b = unit[q], unit[~q], node[lo:hi][q], node[lo:hi][~q]
            if not len(u) or not len(v):
                continue
            w_u, w_v = (copies[lo:hi][x].astype(float) for x in (q, ~q))
            near, n_u, n_v = np.empty((len(u), len(v)), bool), np.zeros(len(u)), np.zeros(len(v))
            for x in range(0, len(u), 512):
                some = near[x : x + 512]
                np.logical_and(u[x : x + 512] @ v.T >= THRESHOLD, a[x : x + 512, None] != b[None, :], out=some)
                n_u[x : x + 512] = some @ w_v
                n_v += w_u[x : x + 512] @ some
            n_v[was[lo:hi][~q]] = 0  # these ask themselves
            rows, cols = _reach(near)
            ids, n, to = np.concatenate([a, b]), np.concatenate([n_u, n_v]), np.concatenate([rows, cols])
            linked = to >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(n[linked].astype(np.int64), pa.int64()), pa.array(a[to[linked]], pa.int64())], names=["node", "n", "to"])

    keys = ["part", "s", "b"]
    dealt = every.unionByName(asking).select("part", "s", "asks", "b", "node", "asked", "copies", "vec").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _runs(batches, [0, 1, 3], work), "node bigint, n bigint, to bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", measured: dict[str, float] | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; ``measured`` is given
    the recall of the search in each audited part (those below RECALL were scanned)."""
    loose, kind = packed(vectors, id_col, vector_col, label_col)
    rows, all_rows = stage_measured(loose, "vectors", n=F.count("*"))
    table, distinct = stage_measured(rows.filter("vec IS NOT NULL").groupBy("part", "vec").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "nodes", n=F.count("*"))
    parts = stage(parts_of(table, kind), "parts")
    found, recall = search(table, parts, distinct["n"], kind)
    if measured is not None:
        measured |= recall
    links = stage(both_ways(links_of(found).filter("a >= 0 AND b >= 0")), "links")
    short = sorted(p for p, share in recall.items() if share < RECALL)
    settled = found.filter((links_in() >= LARGEST) & (F.col("node") >= 0)).select("node")
    asked, n_asked = stage_measured(settled.unionAll(table.filter(F.col("part").isin(short)).select("node")).distinct() if short else settled, "asked", n=F.count("*"))
    scanned = stage(scan(table, asked, parts, distinct["n"], kind), "scanned") if n_asked["n"] else table.sparkSession.createDataFrame([], "node bigint, n bigint, to bigint")
    ends = links.unionAll(scanned.select(F.col("node").alias("a"), F.col("to").alias("b")))
    components = stage(connected_components(ends), "vec-components")
    flagged = table.join(asked.select("node", F.lit(True).alias("asked")), "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    # Links with an asked node are counted by the scan, the others by the lists.
    unasked = flagged.filter("NOT asked").select(F.col("node").alias("b"), F.col("copies").alias("weight"))
    listed = links.join(unasked, "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("listed"))
    counted = scanned.groupBy("node").agg(F.sum("n").alias("scanned"))
    linked = stage(
        flagged.join(listed, "node", "left")
        .join(counted, "node", "left")
        .join(components, "node", "left")
        .select("part", "vec", "copies", (F.col("copies") - 1 + F.coalesce("scanned", F.lit(0)) + F.when(F.col("asked"), 0).otherwise(F.coalesce("listed", F.lit(0)))).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "linked",
    )
    # Copies take their node's answer; a component's id is its smallest vec_id.
    joined = spread_join(rows, linked, ["part", "vec"], "copies", all_rows["n"], ["row"], "left")
    classes = stage(joined.select("vec_id", "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", -F.col("row") - 1).alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("rows"))
    return spread_join(classes, smallest, ["component"], "rows", all_rows["n"], ["row"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
