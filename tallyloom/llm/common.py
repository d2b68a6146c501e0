"""Helpers that the operators share: shared-folder tables and Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_path, fresh_path


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 8 MB: whole documents are large rows, and each task holds a few batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back at the end of the task: workers outlive tasks, and several share an executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_scratch: list[list[DataFrame]] = []  # tables written inside each open :func:`scratch`


@contextmanager
def scratch(keep: Callable[[], list[DataFrame]]) -> Iterator[None]:
    """Delete the tables that :func:`materialize` wrote inside, but for ``keep()``, once the block ends well."""
    _scratch.append([])
    try:
        yield
    finally:
        made = _scratch.pop()
    kept = {id(df) for df in keep()}
    discard(*[df for df in made if id(df) not in kept])


FILE_ROWS, NARROW_ROWS, MOST_FILES = 5_000, 25_000, 200_000


def few_files(df: DataFrame, rows: int, narrow: bool = False) -> DataFrame:
    """``df``, made of ``rows`` documents, in a partition for each ``FILE_ROWS`` of them: not one small file for each shuffle partition.

    ``narrow`` is for tables of a few numbers a document, cheaply made: one for
    ``NARROW_ROWS``.  A partition a core at least, and ``MOST_FILES`` at most,
    beyond which each holds more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    least, size = (cores, NARROW_ROWS) if narrow else (2 * cores, FILE_ROWS)
    return df.coalesce(max(least, min(MOST_FILES, -(-rows // size))))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    for made in _scratch:
        made.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_tallyloom_path", None):
            delete_path(df.sparkSession, path)


def local_rows(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A few rows of the driver's as a DataFrame, through Arrow: no Python worker starts for them."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()}))


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names; extra or clashing columns never reach it."""
    modest_batches(df.sparkSession)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def numbered(df: DataFrame, id_col: str, text_col: str, into: str = "doc") -> DataFrame:
    """``df`` with a unique key ``into``: the id itself, or where ids are null or repeat, a number in the order of (id, text), null first."""
    modest_batches(df.sparkSession)
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if ids.where("id is null").isEmpty() and ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return df.withColumn(into, F.col(f"`{id_col}`").cast("long"))
    ordered = df.sort(F.col(f"`{id_col}`").asc_nulls_first(), F.col(f"`{text_col}`").asc_nulls_first())
    return materialize(ordered.withColumn(into, F.monotonically_increasing_id()), "numbered")


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` (string) holds about ``limit`` bytes a slice, one row at least."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array | pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds of the rows) of a binary column without nulls that holds packed words, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = utf8_of(column)
    size = np.dtype(dtype).itemsize
    return data.view(dtype) if len(data) else np.zeros(0, dtype), offsets // size


def int_lists(blobs: list[bytes], dtype=np.int32) -> pa.ListArray:
    """An Arrow list<int> column from packed little-endian rows, without Python ints."""
    width = np.dtype(dtype).itemsize
    sizes = np.fromiter((len(b) // width for b in blobs), dtype=np.int64, count=len(blobs))
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype=dtype)))


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on this machine (every node has the package of vocabularies)."""
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)
