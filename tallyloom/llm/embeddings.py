"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, components.

Equal vectors are collapsed first (count and smallest id), so thousands of
copies are one row.  The others are signed by ``tables`` x ``bits`` random
hyperplanes (fixed seed); rows that share a table's signature meet in a bucket
and their cosines are computed in double precision, as blocks of a matrix
product.  No pairs are written: a bucket gives each vector its number of links
and the root of its part of the bucket's link graph.  A pair that meets in
several tables is counted in the first of them: a bucket signs the vectors of
its links once more, so no vector travels with the keys of other tables.

``bits`` follows the number of distinct vectors so that a bucket holds about
``target`` of them; ``tables`` follows from ``miss``, the chance that a pair at
exactly the threshold meets in none.  A bucket over ``block`` rows is dealt as
all pairs of its blocks: whole, but never in one task.

Defined results: a vector that is null, empty, zero or has null or non-finite
components links with nothing and is its own component; so is a row without
copies or near ones.  Rows that repeat an id are rows of their own; a null id
keeps its row, counts as a link of others, and gets the component of its class.
Vectors of different lengths never link; an array<double> column keeps its
precision and range (vectors are scaled by a power of two first).  Extra columns
are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_files, materialize, narrowed, numbered, tidy
from .components import connected_components, smallest_ids, sorted_groups


def plan_tables(n: int, threshold: float, target: int = 256, miss: float = 1e-3) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 2) / target))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def _vectors(kind: str):
    """(node, id, key of the vector or null where it can't link, its bytes as numpy type ``kind``) of batches (node, id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blobs = [], []
            for row in batch.column(2):
                values = row.values
                raw = None
                if values is not None and len(values) and not values.null_count:
                    v = values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # -0.0 becomes 0.0
                    if np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                blobs.append(raw)
                keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["node", "id", "key", "vector"])

    return run


def unit_vectors(blobs: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in double precision; a power of two is taken out first, so that no square leaves the range."""
    v = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def link_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", target: int = 256, miss: float = 1e-3, block: int = 2000, block_bytes: int = 8 << 20, seed: int = 17) -> DataFrame:
    """(id, n_links long, component_id long) of every row."""
    source = narrowed(df, id=id_col, vector=vector_col).withColumn("id", F.col("id").cast("long"))
    # 32-bit floats are compared as they are, all other numbers as doubles
    kind = "<f4" if source.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        source = source.withColumn("vector", F.col("vector").cast("array<double>"))
    # a row is known by a number of its own: ids may repeat or be null
    rows_of = numbered(source, "id", "vector", "node")
    n_rows = rows_of.count()
    rows = rows_of.select("node", "id", "vector").mapInArrow(tidy(_vectors(kind)), "node long, id long, key binary, vector binary")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("node").alias("name"), F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = materialize(few_files(classes, n_rows), "vector-classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.length("vector")).alias("widest")).first()
    bits, tables = plan_tables(size["n"], threshold, target, miss)
    block = max(16, min(block, block_bytes // (size["widest"] or 1)))

    def signing():
        """A function from vectors' bytes (of one width) to their keys, vectors x tables."""
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)

        def keys(blobs: list[bytes]) -> np.ndarray:
            width = len(blobs[0])
            if width not in planes:
                planes[width] = np.random.default_rng([seed, width]).standard_normal((width // np.dtype(kind).itemsize, tables * bits))
            signs = unit_vectors(blobs, kind) @ planes[width] > 0
            return signs.reshape(len(blobs), tables, bits) @ weights + (width << bits)

        return keys

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table a vector is in: (t, key, name)."""
        keys_of = signing()
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            for width in sorted({len(b) for b in blobs}):
                at = [i for i, b in enumerate(blobs) if len(b) == width]
                keys = keys_of([blobs[i] for i in at])
                names = np.repeat(batch.column(0).to_numpy()[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), len(at))), pa.array(keys.reshape(-1)), pa.array(names)], names=["t", "key", "name"])

    # buckets are planned on keys alone; vectors come to them once a table, in one shuffle
    met = materialize(few_files(classes.select("name", "vector").mapInArrow(tidy(sign), "t long, key long, name long"), n_rows), "vector-signs")
    sizes = met.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    split = met.join(sizes.select("t", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), ["t", "key"])
    split = split.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("t", "key", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "own", "name")
    split = split.join(classes.select("name", "n", "vector"), "name").select("t", "key", "lo", "hi", "own", "name", "n", "vector")

    keys_of = signing()

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        t, lo, hi = (group.column(i)[0].as_py() for i in (0, 2, 3))
        names, n, own = (group.column(i).to_numpy() for i in (5, 6, 4))
        if len(names) < 2:
            return
        blobs = group.column(7).to_pylist()
        unit = unit_vectors(blobs, kind)
        if lo == hi:
            left = right = np.arange(len(names))
        else:
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, found = np.zeros(len(names), np.int64), []
        for at in range(0, len(left), 512):
            rows_ = left[at : at + 512]
            close = unit[rows_] @ unit[right].T >= threshold
            if lo == hi:
                close[np.arange(len(rows_)), rows_] = False
            i, j = np.nonzero(close)
            if not len(i):
                continue
            i, j = rows_[i], right[j]
            found.append(_forest(i, j, names))
            linked_, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = keys_of([blobs[k] for k in linked_.tolist()])[:, :t]
            first = (keys[place[: len(i)]] != keys[place[len(i) :]]).all(axis=1)
            i, j = i[first], j[first]
            np.add.at(links, i, n[j])
            if lo != hi:
                np.add.at(links, j, n[i])
        if found:
            stars = union_find_all(found)
            root = dict(stars.tolist())
            some = sorted(set(np.flatnonzero(links).tolist()) | {k for k, x in enumerate(names.tolist()) if x in root})
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array([root.get(x, x) for x in names[some].tolist()], pa.int64())], names=["name", "links", "root"])

    linked = materialize(few_files(sorted_groups(split, ["t", "key", "lo", "hi"], compare, "name long, links long, root long"), n_rows), "vector-links")
    discard(met)
    parts = connected_components(linked, "name", "root", "vector-components", rows=n_rows)
    degree = linked.groupBy("name").agg(F.sum("links").alias("links"))
    known = classes.select("key", "name", "n").join(degree, "name", "left").join(smallest_ids(classes.withColumnRenamed("name", "node"), parts), "key")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "part")
    out = rows.where("key is not null").select("id", "key").join(known, "key").select("id", "n_links", F.coalesce("part", "id").alias("component_id"))
    out = out.unionByName(rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    out = materialize(few_files(out, n_rows, narrow=True), "vector-result")
    discard(linked, parts, classes, rows_of)
    return out


def _forest(i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Star edges of the links between rows i and j, by vectorised label minima (no loop over links)."""
    label = names.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (label == before).all():
            own = np.unique(np.concatenate([i, j]))
            return np.stack([names[own], label[own]], axis=1)


def union_find_all(found: list[np.ndarray]) -> np.ndarray:
    from .components import union_find

    return union_find(np.concatenate(found))
