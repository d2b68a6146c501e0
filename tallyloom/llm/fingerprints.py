"""Threshold-scaled document sketches.

A text's shingles are its runs of ``width`` code points (a shorter text is one
shingle).  Each shingle gets a hash (the upper 32 bits of a 64-bit one), and every
hash below a fixed fraction 1/``scale`` of the range is kept, and the ``floor``
smallest ones in any case: a text of fewer than ``floor`` hashes keeps them all,
and only the empty text keeps none.  A sketch is the sorted set of kept hashes.
The bound doesn't depend on the text and the smallest hashes of a union are among
the smallest ones of its parts, so the sketch of a union is the union of sketches,
cut by the same rule.

Each sketch tells up to where it holds every hash (its reach), and two sketches
are compared below the smaller reach of the two.  The likeness is the share of
their union there that is in both: exact for two texts of fewer than ``floor``
hashes, else an estimate from ``floor`` hashes of the union at least; 1 for equal
strings, 0 where only one is empty or nothing meets.  Containment is the share of
one sketch there that lies in the other, however unequal the two texts are.

The string form is ``c<width>/<scale>+<floor>:`` and eight hex digits a kept hash.
Equal texts have equal sketches.

The next document is found without a global sort in one task: rows are dealt to
ranges of ids (by an approximate quantile of the id column alone; a range begins
at the least id in it, which is taken exactly), and the document that opens a range is copied to the range before, the first of all
to the last.

Defined results: null text is the empty text; rows that repeat an id follow in
the order of their texts; rows without id come first; texts of any
length count whole; an empty table gives an empty table; a single row is its own
next one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, tidy

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


KEPT_POWERS = 1 << 19


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; a worker keeps ``KEPT_POWERS`` of them, longer ones are a call's own."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, min(KEPT_POWERS, 1 << max(16, (n - 1).bit_length())))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    if size <= KEPT_POWERS:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(values: np.ndarray, scale: int, floor: int) -> np.ndarray:
    """The hashes of a set that its sketch keeps, sorted."""
    kept = np.unique(values[values < (1 << 32) // scale])
    return kept if len(kept) >= floor else np.unique(values)[:floor]


def _reach(kept: np.ndarray, scale: int, floor: int) -> int:
    """The bound below which a sketch holds every hash of its text."""
    return max((1 << 32) // scale, int(kept[-1]) + 1) if len(kept) >= floor else 1 << 32


def _below(a: np.ndarray, b: np.ndarray, scale: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of two sketches that can be compared."""
    bound = min(_reach(a, scale, floor), _reach(b, scale, floor))
    return a[: np.searchsorted(a, bound)], b[: np.searchsorted(b, bound)]


def sketch(text: str, width: int = 12, scale: int = 16, floor: int = 256) -> np.ndarray:
    """Sorted kept hashes of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32)
    power, inverse = _table(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(points + np.uint64(1)) * power, out=sums[1:])
    size = min(width, n)
    hashes = mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1] + np.uint64(size))
    return _cut(hashes >> np.uint64(32), scale, floor).astype(np.uint32)


def to_string(kept: np.ndarray, width: int = 12, scale: int = 16, floor: int = 256) -> str:
    return f"c{width}/{scale}+{floor}:{kept.astype('>u4').tobytes().hex()}"


def from_string(sketch_string: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(sketch_string.partition(":")[2]), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray, scale: int = 16, floor: int = 256) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return _cut(np.union1d(a, b), scale, floor)


def containment(a: np.ndarray, b: np.ndarray, scale: int = 16, floor: int = 256) -> float:
    """Estimated share of the shingles of a that b has (0 where a has none to compare)."""
    a, b = _below(a, b, scale, floor)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, scale: int = 16, floor: int = 256) -> float:
    """Estimated share of the shingles of both texts that are in each; only two empty texts are alike without one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _below(a, b, scale, floor)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 12, scale: int = 16, floor: int = 256) -> DataFrame:
    """(id, fingerprint string) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [to_string(sketch(x or "", width, scale, floor), width, scale, floor) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    source = narrowed(df, id=id_col, text=text_col)
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (range, copied, id, text) dealt so that each range is one partition in order of ids, ending in a copy of the next range's first row."""
    spark = df.sparkSession
    source = narrowed(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = source.select("id")
    bounds = ids.where("id is not null").approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    edge = ids.agg(F.min("id").alias("least"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    most = np.iinfo(np.int64).max

    def ranges_from(cuts: np.ndarray) -> Column:
        """The range of an id; a row without id is in the first.  The function never sees null: pandas would turn the ids into doubles."""

        @F.pandas_udf("int")
        def found(i: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, i.to_numpy(dtype=np.int64), side="right").astype(np.int32))

        return F.when(F.col("id").isNull(), 0).otherwise(found(F.coalesce("id", F.lit(0).cast("long"))))

    # a quantile is a double, which beyond 2^53 needn't be an id: it only deals, and the ids that open ranges are looked up
    rough = np.unique(np.asarray([min(int(b), most) for b in bounds or []], np.int64))
    opening = ids.where("id is not null").groupBy(ranges_from(rough).alias("range")).agg(F.min("id").alias("least")) if len(rough) else None
    cuts = np.asarray(sorted(x["least"] for x in opening.collect())[1:] if opening is not None else [], np.int64)
    last = len(cuts)

    @F.pandas_udf("boolean")
    def opens(i: pd.Series) -> pd.Series:
        return pd.Series(np.isin(i.to_numpy(dtype=np.int64), cuts))

    first = F.col("id").isNull() if edge["nulls"] else F.col("id") == F.lit(edge["least"])
    dealt = source.withColumn("range", ranges_from(cuts)).withColumn("opens", F.col("id").isNotNull() & opens(F.coalesce("id", F.lit(0).cast("long"))))
    copies = F.array(F.struct(F.col("range"), F.lit(0).alias("copied")), F.when(F.col("opens"), F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("copied"))), F.when(first, F.struct(F.lit(last).alias("range"), F.lit(2).alias("copied"))))
    dealt = dealt.select(F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("to"), "id", "text").select("to.range", "to.copied", "id", "text")
    return dealt.repartitionById(last + 1, "range").sortWithinPartitions("range", "copied", F.asc_nulls_first("id"), "text")


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 12, scale: int = 16, edit: int = 4, floor: int = 256) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next); edited: the last 1/``edit`` of the text replaced by the next text's opening."""
    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None  # (range, id, text, sketch) whose next one hasn't come
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                for part, copied, i, text in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns)):
                    text = text or ""
                    if waits is None and copied:
                        continue  # further rows that share the next id
                    kept = sketch(text, width, scale, floor)
                    if waits is not None:
                        _, doc, said, own = waits
                        tail = len(said) // edit
                        edited = said[: len(said) - tail] + text[:tail]
                        changed = sketch(edited, width, scale, floor)
                        out.append((doc, len(said), edited, to_string(own, width, scale, floor), to_string(changed, width, scale, floor), likeness(own, changed, scale, floor), likeness(own, kept, scale, floor)))
                    waits = None if copied else (part, i, text, kept)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return with_next(df, id_col, text_col).mapInArrow(tidy(run), "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
