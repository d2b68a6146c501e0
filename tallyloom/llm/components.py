"""Distributed connected components by alternating stars, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_FILES, discard, few_files, materialize, tidy

ROUND_EDGES = 50_000  # edges a file between rounds


def union_find(pairs: np.ndarray) -> np.ndarray:
    """Star edges (node, smallest node of its part) of the graph in ``pairs`` (n x 2), roots left out."""
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    nodes, inverse = np.unique(pairs, return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in inverse.reshape(-1, 2).tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.asarray(parent)
    while (roots != roots[roots]).any():
        roots = roots[roots]
    own = np.arange(len(nodes)) != roots
    return np.stack([nodes[own], nodes[roots[own]]], axis=1)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as the stars of their own components, a bounded number of edges at a time."""
    for batch in batches:
        stars = union_find(np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", rows: int = 0) -> DataFrame:
    """(node long, component long: smallest node reachable) of all nodes with an edge to another node.

    ``rows``: about as many edges there are, if they are many.

    Alternating large-star and small-star rounds over a table in the shared
    folder: each is a minimum per node (combined before the shuffle) and a join
    back, so a hub of any degree is split by the engine's skew join.  Rounds go
    on until every edge is a leaf of a star.  Null ends link nothing.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(few_files(pairs.mapInArrow(tidy(_contract), "a long, b long").distinct(), rows, narrow=True), name)
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small.coalesce(min(MOST_FILES, -(-size // ROUND_EDGES) or 1)), name)
        discard(now)
        now = after
        nodes = now.groupBy("a").agg(F.count("*").alias("n"))
        if nodes.where("n > 1").isEmpty() and now.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    roots = now.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    out = now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._tallyloom_path = now._tallyloom_path  # for discard
    return out


def smallest_ids(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, part long) of every class (key, node, rep): the smallest id in its component, a hash where no class of the component has one; null for an unlinked class without id."""
    placed = classes.select("node", "key", "rep").join(parts, "node", "left")
    names = placed.where("component is not null").groupBy("component").agg(F.coalesce(F.min("rep"), F.min(F.xxhash64("key"))).alias("name"))
    # an unlinked class meets no name, under a node of its own and not under null, which would be one task's
    return placed.withColumn("component", F.coalesce("component", "node")).join(names, "component", "left").select("key", F.coalesce("name", "rep").alias("part"))


def sorted_groups(df: DataFrame, keys: list[str], each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of equal (integer) keys together, as one Arrow table at a time in a task that streams its groups.

    The caller bounds the groups; a task holds one group and one batch.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(n)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if rest and (key[0] != last).any():
                yield from each(pa.Table.from_batches(rest))
                rest = []
            begin = 0
            for cut in cuts.tolist():
                yield from each(pa.Table.from_batches([*rest, batch.slice(begin, cut - begin)]))
                rest, begin = [], cut
            rest.append(batch.slice(begin))
            last = key[-1]
        if rest:
            yield from each(pa.Table.from_batches(rest))

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.select(*keys, *[c for c in df.columns if c not in keys]).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)
