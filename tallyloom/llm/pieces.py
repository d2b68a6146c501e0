"""SentencePiece encoding and decoding with a distinct-chunk table.

Pieces of the model never run from a word into the marker of the next word, so
a text is a row of *marked words* (markers, then other characters) that are
segmented independently.  Each task keeps a table of the distinct marked words
it met: the library segments each once, and a text's ids are the table's
entries joined back in order of position.  The table is bounded
(``table_size`` entries and 16 million characters, in two generations, of which
the older one goes when the younger one is full: words still in use stay), needs
no shuffle, and a hot source or a repeated passage only makes it hit more often.

Models with a piece that crosses a marker are encoded whole by the library.

Defined results: a null text counts as the empty text (no ids, empty decoded
text); repeated rows are encoded each; texts of any length are encoded whole; extra columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import int_lists, narrowed, slices, texts_of, tidy, tokenizer_path

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_loaded: dict[tuple[str, int], "ChunkTable"] = {}


class ChunkTable:
    """Distinct marked words and their ids, packed as int32; bounded in entries and in characters."""

    def __init__(self, path: str, table_size: int = 400_000, table_chars: int = 16 << 20):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.np, self.size, self.chars = np, table_size, table_chars
        self.known, self.older, self.held = {}, {}, 0  # two generations of the table, characters held by the younger one
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # a dummy marker stands before every text; without that or with other whitespace rules, texts go whole
        probe = self.model.encode(["a", " a", "a ", "a  b"], out_type=str)
        self.splits = self.splits and ["".join(p) for p in probe] == [f"{MARK}a", f"{MARK}{MARK}a", f"{MARK}a{MARK}", f"{MARK}a{MARK}{MARK}b"]
        self.alone = self.model.piece_to_id(MARK)

    def _learn(self, chunks: list[str]) -> None:
        """Enter chunks that ``known`` lacks; a full generation becomes the older one, from which words still in use are taken back."""
        chars = sum(map(len, chunks))
        if 2 * (len(self.known) + len(chunks)) > self.size or 2 * (self.held + chars) > self.chars:
            fits = len(self.known) <= self.size and self.held <= self.chars
            self.older, self.known, self.held = self.known if fits else {}, {}, 0
        self.held += chars
        fresh = []
        for chunk in chunks:
            if (ids := self.older.get(chunk)) is None:
                fresh.append(chunk)
            else:
                self.known[chunk] = ids
        # the library puts the marker before a text itself, so it gets the marked word without its first marker
        found = [ids if len(chunk) > 1 else [self.alone] for chunk, ids in zip(fresh, self.model.encode([c[1:] for c in fresh], num_threads=1))]
        packed = self.np.fromiter(chain.from_iterable(found), self.np.int32).tobytes()
        at = 0
        for chunk, ids in zip(fresh, found):
            self.known[chunk] = packed[at : (at := at + 4 * len(ids))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [self.np.asarray(x, dtype=self.np.int32).tobytes() for x in self.model.encode(texts, num_threads=1)]
        rows = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        out = []
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            found = [list(map(self.known.get, row)) for row in part]
            if fresh := {c for row, ids in zip(part, found) if None in ids for c, x in zip(row, ids) if x is None}:
                self._learn(list(fresh))
                found = [ids if None not in ids else [self.known[c] if x is None else x for c, x in zip(row, ids)] for row, ids in zip(part, found)]
            out += map(b"".join, found)
        return out


def table_for(path: str, size: int = 400_000) -> ChunkTable:
    if (path, size) not in _loaded:
        _loaded[path, size] = ChunkTable(path, size)
    return _loaded[path, size]


def encode_pieces(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", table_size: int = 400_000) -> DataFrame:
    """(id, ids array<int>): the library's ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(tokenizer_path(model), table_size)
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                ids = int_lists(table.encode(texts_of(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    source = narrowed(df, id=id_col, text=text_col)
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


def _rows(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a list<int> column, a null one as the empty one: one conversion for all values, not a scalar each."""
    flat, at = column.flatten().to_numpy().tolist(), 0
    for n in pc.list_value_length(column).fill_null(0).to_pylist():
        yield flat[at : at + n]
        at += n


def decode_pieces(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string): the library's decode(ids) of every row; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = table_for(tokenizer_path(model)).model.decode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [decode(x) if x else "" for x in _rows(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    source = narrowed(df, id=id_col, ids=ids_col)
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
