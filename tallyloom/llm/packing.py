"""Order-preserving packing by dynamic programming.

The documents of a task are one stream of ids.  Candidate cuts are document
ends (no penalty), sentence ends (``sentence_penalty``) and, inside stretches
without either, every ``STRIDE`` ids (``split_penalty``).  With p the place of
a candidate, the best cost is

    f(j) = penalty(j) + min over i with p_j - p_i <= L of f(i) + padding(p_j - p_i)

where padding is L - length, or nothing when the length is a power of two.  The
first case is L - p_j + min(f(i) + p_i) over a sliding window, kept in a
monotone queue, so a transition costs amortised constant time; the power-of-two
lengths are at most log2(L) extra transitions.  Penalties are in ids: a cut
inside a sentence is taken where it saves more padding than it costs.

The stream is packed in stretches of about ``horizon`` ids; the last window of a
stretch is carried on, so memory stays bounded and no padding is added between
stretches.  Tasks pack independently: there is no shuffle, thus no hot key, and
a retried task repeats its own sequences (their ids carry the partition).

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed each; extra columns are dropped; an empty table packs
into no sequences.  Every id lies in exactly one piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrowed, slices, texts_of, tidy, tokenizer_path
from .token_ids import forget_table, id_table

STRIDE = 256


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Cut places (the last is ends[-1]) minimising padding plus penalties; ``ends`` ascending, gaps of at most ``length``."""
    places = np.concatenate([[0], ends])
    powers = [1 << k for k in range(5, length.bit_length()) if 1 << k < length]
    jumps: dict[int, list[int]] = {}
    for size in powers:
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero((places >= size) & (places[np.minimum(at, len(places) - 1)] == places - size)).tolist():
            jumps.setdefault(j, []).append(int(at[j]))
    p, pen = places.tolist(), [0.0, *penalties.tolist()]
    cost, came = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0][1]] < here - length:
            queue.popleft()
        least, i = queue[0]
        best = length - here + least
        if j in jumps:
            for k in jumps[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += pen[j]
        cost[j], came[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


class Packer:
    """Feeds documents' ids in order; yields batches of pieces."""

    def __init__(self, sentence_ids: np.ndarray, first_sequence: int, length: int = 4096, sentence_penalty: float = 2.0, split_penalty: float = 32.0, horizon: int = 1 << 20, vocabulary: int = 1 << 17):
        self.length, self.horizon, self.sentence_penalty, self.split_penalty = length, horizon, sentence_penalty, split_penalty
        self.stride = min(STRIDE, length)
        self.closes = np.zeros(vocabulary, bool)
        self.closes[sentence_ids] = True
        self.next_sequence = first_sequence
        self.docs: list = []  # (id, start of what is held, whole size)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, 0, len(ids)))
        self.held.append(ids)
        self.n += len(ids)

    def full(self) -> bool:
        return self.n >= self.horizon

    def pack(self, last: bool):
        """Arrays (docs, start, length, doc_tokens, sequence, offset, ids, ends of pieces) of the sequences that are settled."""
        if not self.n:
            return None
        ids = np.concatenate(self.held)
        doc_ends = np.cumsum([len(h) for h in self.held])
        inner = np.flatnonzero(self.closes[ids]) + 1
        penalty = np.full(self.n + 1, -1, np.float32)
        penalty[inner] = self.sentence_penalty
        penalty[doc_ends] = 0
        ends = np.flatnonzero(penalty >= 0)
        gaps = np.flatnonzero(np.diff(np.concatenate([[0], ends])) > self.stride)
        for g in gaps.tolist():
            a, b = (int(ends[g - 1]) if g else 0), int(ends[g])
            penalty[a + self.stride : b : self.stride] = self.split_penalty
        ends = np.flatnonzero(penalty >= 0)
        cuts = choose_cuts(ends, penalty[ends], self.length)
        if not last:
            cuts = cuts[:-1]
        settled = cuts[-1] if cuts else 0
        cuts = np.asarray(cuts, np.int64)
        out = None
        doc_starts = doc_ends - [len(h) for h in self.held]
        if settled:
            bounds = np.union1d(cuts, np.append(doc_ends[doc_ends < settled], settled))
            begins = np.concatenate([[0], bounds[:-1]])
            of_doc = np.searchsorted(doc_ends, begins, side="right")
            window = np.searchsorted(cuts, begins, side="right")
            window_start = np.concatenate([[0], cuts])[window]
            held_from = np.asarray([d[1] for d in self.docs], np.int64)
            out = ([self.docs[i][0] for i in of_doc.tolist()], held_from[of_doc] + begins - doc_starts[of_doc], bounds - begins, np.asarray([d[2] for d in self.docs], np.int64)[of_doc], self.next_sequence + window, begins - window_start, ids[:settled], bounds)
            self.next_sequence += len(cuts)
        first = int(np.searchsorted(doc_ends, settled, side="right"))
        rest, held = self.docs[first:], self.held[first:]
        if rest and doc_starts[first] < settled:
            skip = int(settled - doc_starts[first])
            rest[0], held[0] = (rest[0][0], rest[0][1] + skip, rest[0][2]), held[0][skip:]
        self.docs, self.held, self.n = rest, held, self.n - settled
        return out


def pack_documents(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", sentence_penalty: float = 2.0, split_penalty: float = 32.0, table_size: int = 500_000, keep_table: bool = True) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids binary: little-endian uint32), in order inside each sequence.

    A worker's vocabulary and table of known words outlive its tasks unless
    ``keep_table`` is false, which frees their memory for what else a session does.
    """
    source = narrowed(df, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(vocabulary)
        table = id_table(path, size=table_size)
        vocab = json.load(open(path))["model"]["vocab"]
        closing = np.asarray([i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in {".", "!", "?"}], np.int64)
        packer = Packer(closing, TaskContext.get().partitionId() << 36, length, sentence_penalty, split_penalty, vocabulary=1 + max(end_id, *vocab.values(), *table.library.get_vocab().values()))
        end = np.asarray([end_id], table.dtype).tobytes()
        id_type = None

        def emit(last: bool):
            packed = packer.pack(last)
            if packed is None:
                return
            docs, start, size, whole, sequence, offset, ids, bounds = packed
            offsets = np.concatenate([[0], bounds]).astype(np.int64) * 4
            for at in range(0, len(docs), 20_000):
                part = slice(at, at + 20_000)
                cut = offsets[at : min(at + 20_000, len(docs)) + 1]
                data = ids[cut[0] // 4 : cut[-1] // 4].tobytes()
                blobs = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(docs[part], id_type), *(pa.array(x[part].astype(np.int64)) for x in (start, size, whole, sequence, offset)), blobs], names=names)

        for whole in batches:
            id_type = whole.column(0).type
            for batch in slices(whole, 1, 4 << 20):
                for doc, ids in zip(batch.column(0).to_pylist(), table.encode(texts_of(batch.column(1)), end)):
                    packer.add(doc, np.frombuffer(ids, table.dtype))
                    if packer.full():
                        yield from emit(False)
        yield from emit(True)
        if not keep_table:
            forget_table(path)

    return source.mapInArrow(tidy(run), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
