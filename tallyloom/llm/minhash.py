"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are collapsed to a class first.  A class's
signature holds ``orders`` x ``depth`` minimum hashes; each order is one sorted
list of all classes by its ``depth`` values (a range-partitioned sort, so that a
dense region spreads over tasks).  In a sorted list the neighbour before a
class is the one with the longest common prefix; where that is at least
``least`` values deep they are candidates.  Candidates are confirmed on whole
shingle sets and confirmed links are contracted to components.

Depth adapts to the region (the classes that share ``least`` values in an
order): where the deepest neighbours already make a region one component,
nothing shallower can add to it and it is done; where a region still holds
several components, every pair across them is a candidate at the shallow depth,
in blocks of at most about ``block`` classes and ``block_bytes`` of their sets,
so a task's memory follows neither the region nor the texts.  So no pair that an order brings together at
``least`` values is lost, and dense regions don't cost their square.

Before an exact comparison across components two bounds leave out pairs: sizes
that can't reach the similarity, and signatures that agree in so few places
(five and a half standard deviations under the expectation at the similarity)
that they can't either.

Defined results: null and empty texts have an empty set, link with nothing and
are their own component; equal texts are one class; rows that repeat an id
follow their own text's class; a null id keeps its row, without giving a
component its name unless no other id is there; texts of any length count whole;
extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_files, local_rows, materialize, narrowed, numbered, slices, tidy, utf8_of, words_of
from .components import connected_components, smallest_ids, sorted_groups, union_find
from .shingles import shingle_sets, similar


def signature(values: np.ndarray, factors: np.ndarray) -> bytes:
    """Minimum of each permuted set, upper 32 bits, big-endian so that bytes sort as numbers."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        np.minimum(least, (factors[:, None] * part[None, :]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", orders: int = 16, depth: int = 6, least: int = 4, block: int = 256, block_bytes: int = 4 << 20, seed: int = 11) -> DataFrame:
    """(id, n_shingles long, component_id long) of every row; a component's id is its smallest."""
    # a row is known by a number of its own: ids may repeat or be null
    rows_of = numbered(narrowed(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")), "id", "text", "node")
    source = rows_of.select("node", "id", "text")
    factors = np.random.default_rng(seed).integers(1, 1 << 63, orders * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 1 << 18):
                sets = shingle_sets(*utf8_of(batch.column(2)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([signature(s, factors) if len(s) else None for s in sets], pa.binary())], names=["node", "id", "n", "key", "signature"])

    rows = source.count()
    signed = materialize(few_files(source.mapInArrow(tidy(sign), "node long, id long, n long, key binary, signature binary"), rows), "minhash-signatures")
    # a class is known by its first row's number
    classes = signed.where("key is not null").groupBy("key").agg(F.min("node").alias("node"), F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(few_files(classes, rows, narrow=True), "minhash-classes")

    width = 4 * depth
    order = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.substring("signature", 1 + t * width, width).alias("order")) for t in range(orders)])).alias("o")
    forest = classes.select("node", "n", order).select("o.t", "o.order", "node", "n")
    prefix = 4 * least

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of neighbours (kind 0), and the first and last row of the task (kinds 1, 2)."""
        first = last = None
        here = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ts, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order, _ = words_of(batch.column(1), np.uint32)
            head = order.reshape(len(ts), depth)[:, :least]
            rows = [(int(ts[k]), batch.column(1)[k].as_py(), int(node[k])) for k in (0, -1)]
            same = (ts[1:] == ts[:-1]) & (head[1:] == head[:-1]).all(axis=1) & (node[1:] != node[:-1])
            x, y = node[:-1][same], node[1:][same]
            if last is None:
                first = rows[0]
            elif last[0] == rows[0][0] and last[1][:prefix] == rows[0][1][:prefix] and last[2] != rows[0][2]:
                x, y = np.append(x, last[2]), np.append(y, rows[0][2])
            last = rows[1]
            if len(x):
                yield _rows([(0, here, min(p, q), max(p, q), None, None) for p, q in zip(x.tolist(), y.tolist())])
        if last is not None:
            yield _rows([(1, here, x, x, t, k) for (t, k, x) in (first,)] + [(2, here, x, x, t, k) for (t, k, x) in (last,)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "task", "a", "b", "t", "order"])

    ranged = forest.drop("n").repartitionByRange("t", "order", "node").sortWithinPartitions("t", "order", "node")
    found = materialize(few_files(ranged.mapInArrow(tidy(neighbours), "kind int, task long, a long, b long, t int, order binary"), rows, narrow=True), "minhash-neighbours")
    # neighbours over a task's edge: two rows a task, in the order of tasks
    edges = sorted(found.where("kind > 0").select("task", "kind", "t", "order", "a").collect())
    across = [(min(x.a, y.a), max(x.a, y.a)) for x, y in zip(edges, edges[1:]) if x.task != y.task and x.t == y.t and bytes(x.order)[:prefix] == bytes(y.order)[:prefix] and x.a != y.a]
    pairs = found.where("kind = 0").select("a", "b").unionByName(local_rows(df.sparkSession, {"a": (pa.int64(), [x for x, _ in across]), "b": (pa.int64(), [y for _, y in across])}))
    pairs = materialize(few_files(pairs.distinct(), rows, narrow=True), "minhash-pairs")
    discard(found)

    # regions of an order with more than one class
    regions = forest.select("t", F.xxhash64(F.substring("order", 1, prefix)).alias("region"), "node", "n")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 18):
                sets = shingle_sets(*utf8_of(batch.column(1)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    # by the same join at every size: a broadcast of few wanted numbers would only do for small tables
    texts = source.select("node", "text").join(wanted.hint("merge"), "node", "left_semi")
    sets = materialize(few_files(texts.mapInArrow(tidy(read_sets), "node long, members binary"), rows), "minhash-sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at), (right, to) = (words_of(batch.column(i), np.uint64) for i in (2, 3))
            good = [similar(left[at[i] : at[i + 1]], right[to[i] : to[i + 1]], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(tidy(confirm), "a long, b long")
    parts = connected_components(links, name="minhash-parts", rows=rows)

    # regions that still hold several components
    placed = regions.join(sets.select("node"), "node", "left_semi").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    placed = materialize(few_files(placed.select("t", "region", "node", "part", "n"), rows, narrow=True), "minhash-regions")
    mixed_regions = placed.groupBy("t", "region").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("size"), F.sum("n").alias("hashes")).where("least <> most")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(8 * F.col("hashes") / block_bytes)).cast("int")
    split = placed.join(mixed_regions.select("t", "region", blocks.alias("blocks")), ["t", "region"])
    split = split.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = sets.join(classes.select("node", "signature"), "node")
    split = split.select(F.col("t").cast("long").alias("t"), "region", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "own", "node", "part").join(members, "node").select("t", "region", "lo", "hi", "own", "node", "part", "members", "signature")
    share = percent / 100
    agree = math.floor(orders * depth * share - 5.5 * math.sqrt(orders * depth * share * (1 - share)))

    def across_parts(group: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi = (group.column(i)[0].as_py() for i in (2, 3))
        own, node, part = (group.column(i).to_numpy() for i in (4, 5, 6))
        hashes, bounds = words_of(group.column(7), np.uint64)
        sizes = np.diff(bounds)
        sign_ = words_of(group.column(8), np.uint32)[0].reshape(len(node), -1)  # only compared, in whichever byte order
        left, right = (np.arange(len(node)),) * 2 if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        parent = {int(p): int(p) for p in part}

        def root(p: int) -> int:
            while parent[p] != p:
                p = parent[p]
            return p

        out = []
        for i in left.tolist():
            j = right[right > i] if lo == hi else right
            j = j[part[j] != part[i]]
            j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
            if not len(j):
                continue
            alike = (sign_[j] == sign_[i]).sum(axis=1)
            j, alike = j[alike >= agree], alike[alike >= agree]
            mine = hashes[bounds[i] : bounds[i + 1]]
            for k in j[np.argsort(-alike, kind="stable")].tolist():
                a, b = root(int(part[i])), root(int(part[k]))
                if a != b and similar(mine, hashes[bounds[k] : bounds[k + 1]], percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[k])))
        if out:
            stars = union_find(np.asarray(out, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])

    more = sorted_groups(split, ["t", "region", "lo", "hi"], across_parts, "a long, b long")
    stars = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected_components(stars.unionByName(more), name="minhash-final", rows=rows)
    known = smallest_ids(classes, final).select("key", F.coalesce("part", F.xxhash64("key")).alias("part"))
    with_words = signed.where("key is not null").select("id", "n", "key").join(known, "key").select("id", "n", "part")
    without = signed.where("key is null").select("id", "n", F.col("id").alias("part"))
    out = with_words.unionByName(without).select("id", F.col("n").alias("n_shingles"), F.col("part").alias("component_id"))
    out = materialize(few_files(out, rows, narrow=True), "minhash-result")
    discard(pairs, placed, sets, classes, signed, parts, final, rows_of)
    return out
