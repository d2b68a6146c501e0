"""A table of distinct units and their ids in columns, kept by a worker over its batches.

Units are numbered in Arrow, each distinct one of a batch is looked up once, and
the ids of all units are gathered in numpy.  The table is bounded in entries and
bytes; when it would grow beyond, what the batch at hand holds stays, which
includes the frequent units.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[begin:begin + n] of every row, end to end."""
    at = np.repeat(begin - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat.take(at)


class UnitColumns:
    """``learn`` gets an Arrow column of new units, calls :meth:`add` for all of them, in any order, and returns their places in that order."""

    def __init__(self, dtype: np.dtype, size: int, learn: Callable[[pa.Array], np.ndarray], held_bytes: int = 64 << 20):
        self.dtype, self.size, self.learn, self.held_bytes = np.dtype(dtype), size, learn, held_bytes
        self.forget()

    def forget(self) -> None:
        self.units = pa.array([], pa.string())
        self.flat, self.begin, self.n_ids = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flags = np.zeros(0, np.int8)

    def add(self, units: pa.Array, flat: np.ndarray, n_ids: np.ndarray, flags: np.ndarray | None = None) -> None:
        self.units = pa.concat_arrays([self.units, units])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n_ids) - n_ids])
        self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
        self.n_ids = np.concatenate([self.n_ids, n_ids])
        self.flags = np.concatenate([self.flags, np.zeros(len(units), np.int8) if flags is None else flags])

    def add_packed(self, units: pa.Array, ids: list[bytes], flags: np.ndarray | None = None) -> None:
        """Units whose ids are packed already."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        self.add(units, np.frombuffer(b"".join(ids), self.dtype), sizes, flags)

    def rows(self, units: pa.Array) -> np.ndarray:
        """The rows of distinct units, of which the table then holds all."""
        found = pc.index_in(units, value_set=self.units)
        if not found.null_count:
            return found.to_numpy()
        missing = found.is_null()
        fresh = units.filter(missing)
        out = found.fill_null(0).to_numpy().astype(np.int64)
        if len(self.units) + len(fresh) > self.size or self.units.nbytes > self.held_bytes:
            rows = found.drop_null()
            kept, rows = self.units.take(rows), rows.to_numpy()
            flat, n_ids, flags = gather(self.flat, self.begin[rows], self.n_ids[rows]), self.n_ids[rows], self.flags[rows]
            self.forget()
            self.add(kept, flat, n_ids, flags)
            out[found.is_valid().to_numpy(zero_copy_only=False)] = np.arange(len(kept))
        held = len(self.units)
        places, added = self.learn(fresh), np.empty(len(fresh), np.int64)
        added[places] = np.arange(held, len(self.units))
        out[missing.to_numpy(zero_copy_only=False)] = added
        return out

    def items(self, units: pa.Array) -> np.ndarray:
        """The row of every unit of a column with repeats."""
        numbered = units.dictionary_encode()
        return self.rows(numbered.dictionary)[numbered.indices.to_numpy()]

    def texts(self, item: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Packed ids of texts: text k has the units from first[k] to first[k + 1]; an item of one more than the last row has no ids."""
        if not len(item):
            return [b""] * (len(first) - 1)
        bounds = np.append(self.begin, [len(self.flat)] * 2) * self.dtype.itemsize
        rows = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(self.flat)])
        _, ends, data = rows.take(pa.array(item)).buffers()
        data = data.to_pybytes() if data is not None else b""
        at = np.frombuffer(ends, np.int64)[first].tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]
