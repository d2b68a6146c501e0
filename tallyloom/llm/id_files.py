"""Token-id files: documents' ids in ascending id order, as range-coded blocks.

A dataset is a folder of Parquet files (the container that any store Spark
writes to can hold) with one row a block: (file, block, ids before it in the
file, number of ids, the documents' pieces in it, payload).  ``file`` is the
rank of the range of document ids, so (file, block) is the order of the data.
A payload is a block of :mod:`range_coder`: its models start afresh and it has
its own checksums, so blocks are read independently and a damaged one is found.

Blocks close behind the document that fills them; a document of more than
``4 * block_ids`` ids is spread over several, and its checksum is put together
from its pieces', so memory follows the block and not the document.

Documents are dealt to ranges of ids, each sorted by id and text; nothing but one total a file goes to the driver.

Defined results: null and empty texts are documents of the end id alone; rows
that repeat an id stand in order of their texts; rows without id come first;
extra columns are dropped; an empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import local_rows, materialize, narrowed, slices, texts_of, tidy, tokenizer_path
from .range_coder import decode_block, encode_block
from .token_ids import id_table

PIECES = "docs array<long>, sizes array<int>, ends array<boolean>"
BLOCK = f"file int, block int, before long, first_doc long, first_offset long, n_ids long, {PIECES}, payload binary"


def write_ids(df: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 21) -> None:
    """Encode every whole text, append ``end_id`` and write the dataset at ``path``."""
    source = narrowed(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_table(tokenizer_path(vocabulary))
        size_of = table.library.get_vocab_size(with_added_tokens=True)
        end = np.asarray([end_id], table.dtype).tobytes()
        file = TaskContext.get().partitionId()
        held: list[bytes] = []
        docs: list = []
        sizes: list[int] = []
        ends: list[bool] = []
        n = before = block = doc_rank = first_doc = first_offset = 0

        def close(offset_after: int):
            nonlocal held, docs, sizes, ends, n, before, block, first_doc, first_offset
            payload = encode_block(np.frombuffer(b"".join(held), table.dtype), size_of)
            row = [[file], [block], [before], [first_doc], [first_offset], [n], [docs], [sizes], [ends], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
            names = ["file", "block", "before", "first_doc", "first_offset", "n_ids", "docs", "sizes", "ends", "payload"]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)
            before, block = before + n, block + 1
            held, docs, sizes, ends, n = [], [], [], [], 0
            first_doc, first_offset = doc_rank, offset_after
            return out

        width = table.dtype.itemsize
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                for doc, ids in zip(batch.column(0).to_pylist(), table.encode(texts_of(batch.column(1)), end)):
                    at = 0
                    while True:
                        part = ids[at * width : (at + 4 * block_ids) * width]
                        held.append(part)
                        docs.append(doc)
                        sizes.append(len(part) // width)
                        n += sizes[-1]
                        at += sizes[-1]
                        ends.append(at * width == len(ids))
                        if ends[-1]:
                            break
                        yield close(at)
                    doc_rank += 1
                    if n >= block_ids:
                        yield close(0)
        if n:
            yield close(0)

    ordered = source.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("text"))
    ordered.mapInArrow(tidy(run), BLOCK).write.option("compression", "none").parquet(path)


def combine_crc32(first: int, second: int, size: int) -> int:
    """crc32 of the concatenation, from both parts' checksums and the second's size in bytes.

    The first's register is advanced over ``size`` zero bytes, which is linear
    over GF(2): the advance of one byte is squared along the bits of ``size``.
    """

    def apply(columns: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= columns[i]
        return out

    advance = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        advance = [apply(advance, c) for c in advance]  # one zero byte
    while size:
        if size & 1:
            first = apply(advance, first)
        size >>= 1
        if size:
            advance = [apply(advance, c) for c in advance]
    return first ^ second


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_rank, id, start, offset, n, ids binary, whole): the documents' pieces, decoded from the dataset.

    start counts all ids before the document's piece; ids are little-endian uint32.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    at, rows = 0, []
    for file in sorted(totals):
        rows.append((file, at))
        at += totals[file]
    offsets = local_rows(spark, {"file": (pa.int32(), [f for f, _ in rows]), "file_start": (pa.int64(), [x for _, x in rows])})
    names = ["file", "doc_rank", "id", "start", "offset", "n", "ids", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, _, before, first_doc, first_offset, _, docs, sizes, ends, payload, file_start = (c[i].as_py() for c in batch.columns)
                ids = decode_block(payload)
                sizes_ = np.asarray(sizes, np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes_)])
                offset = np.zeros(len(docs), np.int64)
                offset[0] = first_offset
                whole = np.asarray(ends) & (offset == 0)
                data = ids.astype("<u4").tobytes()
                blobs = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(docs), pa.int32()), pa.array(first_doc + np.arange(len(docs))), pa.array(docs, pa.int64()), pa.array(file_start + before + bounds[:-1]), pa.array(offset), pa.array(sizes_), blobs, pa.array(whole)], names=names)

    placed = blocks.join(F.broadcast(offsets), "file").select("file", "block", "before", "first_doc", "first_offset", "n_ids", "docs", "sizes", "ends", "payload", "file_start")
    return placed.mapInArrow(tidy(run), "file int, doc_rank long, id long, start long, offset long, n long, ids binary, whole boolean")


def document_checksums(pieces: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document; those spread over blocks are put together from their pieces."""

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = combine_crc32(crc, p["crc"], 4 * p["n"])
                out.append((doc, parts[0]["start"], sum(p["n"] for p in parts), crc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "start", "n_tokens", "ids_crc32"])

    # two ways lead on from here; a small table spares decoding for each
    marked = materialize(pieces.select("file", "doc_rank", "id", "start", "n", F.crc32("ids").alias("crc"), "whole"), "id-checksums")
    single = marked.where("whole").select("id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    spread = marked.where("not whole").groupBy("file", "doc_rank").agg(F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))
    return single.unionByName(spread.select("id", "parts").mapInArrow(tidy(join_pieces), "id long, start long, n_tokens long, ids_crc32 long"))


def new_path(spark: SparkSession) -> str:
    """A fresh folder for a dataset in the shared folder."""
    return fresh_path(spark, "ids")
