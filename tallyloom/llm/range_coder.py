"""Adaptive context-mixing range coder for token ids, many lanes at a time.

A block is coded on its own: models start afresh, its header carries checksums.
Its ids are cut into lanes that advance in lock-step, one id a lane and step;
all lanes share one model, so it learns as if it had read the ids of all lanes
so far: candidates after each step, probabilities and weights every few.

An id is predicted by order 2 (what followed the last two ids, a hashed table of
candidates with confidences), order 1 (what followed the last id) and order 0
(frequencies).  Whether the order-2 and then the order-1 candidate is right is
predicted by mixing the three orders: what order 2's confidence says, what order
1's says, and how often ids as frequent as the candidate (order 0, in four
classes) came when proposed.  Each probability is stretched, weighted, summed and
squashed, and the weights follow the coding error.  The interval of an id is
[order-2 hit | order-1 hit | order-0 share].  All model arithmetic is on
integers, so every machine decodes alike.

The coder is a carry-less range coder on 64-bit state with 32-bit words: a lane
whose span falls below one word's worth gives out the top word of its interval,
cut to that word first where it straddles two.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLR3"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, steps, vocabulary, crc of the ids, crc of the header so far and of what follows
TOTAL_BITS, ZERO_BITS, SLOT_BITS = 26, 18, 18
_ZERO = 1 << ZERO_BITS
_U = np.uint64
_WORD, _LOW_WORD, _FULL = _U(32), _U((1 << 32) - 1), _U(1 << 32)
#: Steps between updates of probabilities and weights, and of the frequencies.
MIX_STEPS, ZERO_STEPS = 4, 16
#: A context of the mixer: order-0 class of the order-2 candidate (four) and of the order-1 candidate (two), both confidences, whether they are the same.
CONTEXTS = 1 << 10
#: Shares of 2^18 that part the order-0 classes.
CLASSES = (2, 16, 128)


class CorruptBlock(ValueError):
    pass


def _stretch(p: np.ndarray) -> np.ndarray:
    y = 2 * p - 65536
    return (y << 12) // (65536 - np.abs(y))


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(32768 + (x << 15) // (4096 + np.abs(x)), 64, 60000)


class _Mixer:
    """Weighted sum of stretched predictions; weights in 1/65536."""

    def __init__(self, n: int):
        self.w = np.full(n, 65536 // n + 8192, np.int64)

    def mix(self, inputs: np.ndarray) -> np.ndarray:
        self.inputs = inputs
        self.out = _squash((self.w @ inputs) >> 16)
        return self.out

    def update(self, hits: np.ndarray, seen: np.ndarray) -> None:
        error = (hits << 16) - seen * self.out
        total = int(seen.sum())
        if total:
            self.w += np.clip((self.inputs @ error) // (total << 15), -4096, 4096)


#: A context's parts (see CONTEXTS): class bits of both candidates, both confidences, whether they are the same.
_C = np.arange(CONTEXTS)
_F2, _F1, _C2, _C1, _SAME = _C >> 8, (_C >> 7) & 1, (_C >> 4) & 7, (_C >> 1) & 7, _C & 1
#: Adaptive probabilities stand in one row: by order 2's confidence, order 1's, the class and all of it; then those of the order-1 candidate.
_INPUTS2 = np.stack([_C2, 8 + (_C & 15), 24 + _F2 * 2 + _SAME, 32 + (_C & 127)])
_INPUTS1 = np.stack([160 + _C1, 168 + _F1, 170 + (_C & 127)])
_PROBABILITIES = 298


def _by_parts(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of counts a context, summed by what the adaptive probabilities go by: order 2's confidence, order 1's with and without sameness, class with sameness, second class, all but the classes."""
    rows = len(counts)
    sure = counts.reshape(rows, 8, 128).sum(1)
    second = sure.reshape(rows, 8, 16).sum(1)
    first_class = counts.reshape(rows, 4, 16, 16).sum(2).reshape(rows, 4, 8, 2).sum(2).reshape(rows, 8)
    return sure.reshape(rows, 8, 16).sum(2), second, second.reshape(rows, 8, 2).sum(2), first_class, counts.reshape(rows, 4, 2, 128).sum((1, 3)), sure


class Model:
    """Predictions for a step of all lanes, and their update.

    A candidate and its confidence (0 to 7) stand in one entry: candidate * 8 + confidence.
    """

    def __init__(self, vocabulary: int, lanes: int):
        self.v = vocabulary
        self.count = np.zeros(vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.after1 = np.full(vocabulary, -8, np.int32)
        self.after2 = np.full(1 << SLOT_BITS, -8, np.int32)
        self.last1 = self.last2 = np.zeros(lanes, np.int64)
        self.hits, self.seen = np.full(_PROBABILITIES, 1, np.int64), np.full(_PROBABILITIES, 8, np.int64)
        self.m2, self.m1 = _Mixer(4), _Mixer(3)
        self.keys: list[np.ndarray] = []
        self.step = 0
        self._zero()
        self._mix()

    def _zero(self) -> None:
        """Frequencies of the ids so far as shares of a fixed total, at least one each."""
        if self.recent:
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.v)
            self.recent = []
        room, total = _ZERO - self.v, int(self.count.sum())
        share = np.ones(self.v, np.int64)
        if total:
            share += self.count * room // total
        else:
            share += room // self.v
        share[-1] += _ZERO - share.sum()
        self.cdf = np.zeros(self.v + 1, np.int32)
        np.cumsum(share, out=self.cdf[1:])
        self.classes = sum((share >= least).view(np.uint8) for least in CLASSES)
        self.inverse = None

    def symbol(self, y: np.ndarray) -> np.ndarray:
        if self.inverse is None:
            first = np.zeros(_ZERO, np.uint16 if self.v <= 1 << 16 else np.int32)
            first[self.cdf[1:-1]] = 1  # every id has a share
            self.inverse = np.cumsum(first, dtype=first.dtype)
        return self.inverse.take(y)

    def _mix(self) -> None:
        """Masses of both candidates by context (confidences, and whether they are the same), and intervals by outcome and context."""
        stretched = _stretch(np.clip((self.hits << 16) // self.seen, 64, 65472))
        p2, p1 = self.m2.mix(stretched[_INPUTS2]), self.m1.mix(stretched[_INPUTS1])
        self.mass2 = p2 << (TOTAL_BITS - 16)
        mass1 = np.where(_SAME == 1, 0, (((1 << TOTAL_BITS) - self.mass2) * p1) >> 16)
        self.both = self.mass2 + mass1
        self.starts = np.concatenate([np.zeros(CONTEXTS, np.int64), self.mass2, self.both])
        self.sizes = np.concatenate([self.mass2, mass1, (1 << TOTAL_BITS) - self.both])

    def _learn(self) -> None:
        got2, got1, missed = np.bincount(np.concatenate(self.keys), minlength=3 * CONTEXTS).reshape(3, CONTEXTS)
        self.keys = []
        seen = got2 + got1 + missed
        open1 = np.where(_SAME == 1, 0, seen - got2)
        self.m2.update(got2, seen)
        self.m1.update(got1, open1)
        sure2, both1, sure1, class2, class1, sure = _by_parts(np.stack([got2, seen, got1, open1]))
        self.hits += np.concatenate([sure2[0], both1[0], class2[0], sure[0], sure1[2], class1[2], sure[2]])
        self.seen += np.concatenate([sure2[1], both1[1], class2[1], sure[1], sure1[3], class1[3], sure[3]])
        old = self.seen > 1 << 16
        self.hits >>= old
        self.seen >>= old
        self._mix()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(order-2 candidate, order-1 candidate) of every lane; the lanes' contexts are left in ``context``."""
        slot = self.last2 * 0x9E3779B1
        slot += self.last1 * 0x85EBCA77
        slot >>= 7
        slot &= (1 << SLOT_BITS) - 1
        self.slot = slot
        self.entry2, self.entry1 = self.after2.take(slot), self.after1.take(self.last1)
        self.sure2, self.sure1 = self.entry2.astype(np.uint8) & 7, self.entry1.astype(np.uint8) & 7
        a, b = self.entry2 >> 3, self.entry1 >> 3
        low = self.sure2 << 4
        low |= self.sure1 << 1
        low |= a == b
        high = self.classes.take(a) << 1  # no candidate: -1, the last id's class, the same to both sides
        high |= self.classes.take(b) >> 1
        self.context = high.astype(np.int64)
        self.context <<= 7
        self.context |= low
        return a, b

    def interval(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of every lane's ``outcome`` (int8): 0 for the order-2 candidate, 1 for the order-1 candidate, 2 for neither, all of whose share it then is."""
        key = outcome.astype(np.int64)
        key <<= 10
        key += self.context
        self.keys.append(key)
        return self.starts.take(key), self.sizes.take(key)

    def part(self, x: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids in order 0's share ``room``."""
        left = self.cdf.take(x) * room
        left >>= ZERO_BITS
        size = self.cdf.take(x + 1) * room
        size >>= ZERO_BITS
        size -= left
        return left, size

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``x`` (int32) came, after :meth:`interval` got the outcome."""
        fresh = x << 3
        for table, at, entry, sure, hit in ((self.after2, self.slot, self.entry2, self.sure2, hit2), (self.after1, self.last1, self.entry1, self.sure1, hit1)):
            known = entry + (hit & (sure < 7))
            known -= ~hit
            table[at] = np.where(hit | (sure > 0), known, fresh)
        self.last2, self.last1 = self.last1, x.astype(np.int64)
        self.recent.append(self.last1)
        self.step += 1
        if self.step % MIX_STEPS == 0 or self.step < MIX_STEPS:
            self._learn()
        if self.step % ZERO_STEPS == 0 or self.step in (1, 2, 4, 8):
            self._zero()


def _lanes(n: int) -> tuple[int, int]:
    lanes = min(8192, max(1, n // 256 if n >= 1 << 19 else n // 128))
    return lanes, -(-n // lanes)


def _narrow(low: np.ndarray, span: np.ndarray, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Take the share [start, start + size) of each lane's interval; the lanes that are to shift by a word, spans cut so that they can."""
    low += start.view(_U) * unit
    np.multiply(size.view(_U), unit, out=span)
    at = np.flatnonzero(span < _FULL)
    if len(at):
        some = low.take(at)
        # up to the end of the word's range; a straddling span is larger than what is left there
        span[at] = np.minimum(span.take(at), (~some & _LOW_WORD) + _U(1)) << _WORD
    return at


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The block of these ids (any number, below ``vocabulary``)."""
    n = len(ids)
    lanes, steps = _lanes(n) if n else (0, 0)
    body = b""
    if n:
        grid = np.zeros(lanes * steps, np.int32)
        grid[:n] = ids
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        model = Model(vocabulary, lanes)
        low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
        words, of = [], []
        for t in range(steps):
            x = grid[t]
            a, b = model.predict()
            hit2, hit1 = a == x, b == x
            missed = ~(hit2 | hit1)
            start, size = model.interval((~hit2).view(np.int8) + missed.view(np.int8))
            at = np.flatnonzero(missed)
            if len(at):
                left, size[at] = model.part(x.take(at), size.take(at))
                start[at] += left
            at = _narrow(low, span, start, size, span >> _U(TOTAL_BITS))
            if len(at):
                some = low.take(at)
                words.append((some >> _WORD).astype("<u4"))
                of.append(at.astype(np.uint16))
                low[at] = some << _WORD
            model.update(x, hit2, hit1)
        words.append(((low + _LOW_WORD) >> _WORD).astype("<u4"))
        of.append(np.arange(lanes, dtype=np.uint16))
        lane = np.concatenate(of)
        body = np.bincount(lane).astype("<u4").tobytes() + np.concatenate(words).take(np.argsort(lane, kind="stable")).tobytes()
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    head = _HEAD.pack(MAGIC, n, lanes, steps, vocabulary, zlib.crc32(raw), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids (uint32) of a block; :class:`CorruptBlock` where a checksum doesn't hold."""
    if len(block) < _HEAD.size:
        raise CorruptBlock("short header")
    magic, n, lanes, steps, vocabulary, crc_ids, crc_body = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: _HEAD.size - 4])) != crc_body:
        raise CorruptBlock("checksum of the block")
    if not n:
        return np.zeros(0, np.uint32)
    used = np.frombuffer(body[: 4 * lanes], "<u4").astype(np.int64)
    words = np.concatenate([np.frombuffer(body[4 * lanes :], "<u4"), np.zeros(2, np.uint32)]).astype(_U)
    ends = np.cumsum(used)
    place = ends - used

    def take(lane_at: np.ndarray, lane_ends: np.ndarray) -> np.ndarray:
        return np.where(lane_at < lane_ends, words.take(np.minimum(lane_at, len(words) - 1)), _U(0))

    code = take(place, ends) << _WORD | take(place + 1, ends)
    place += 2
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    grid = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        a, b = model.predict()
        mass2, both = model.mass2.take(model.context), model.both.take(model.context)
        unit = span >> _U(TOTAL_BITS)
        v = ((code - low) // unit).view(np.int64)
        np.minimum(v, (1 << TOTAL_BITS) - 1, out=v)
        in2, missed = v < mass2, v >= both
        start, size = model.interval((~in2).view(np.int8) + missed.view(np.int8))
        x = np.where(in2, a, b)
        miss = np.flatnonzero(missed)
        if len(miss):
            base, room = start.take(miss), size.take(miss)
            got = model.symbol((((v.take(miss) - base + 1) << ZERO_BITS) - 1).view(_U) // room.view(_U))
            left, size[miss] = model.part(got.astype(np.int32), room)
            x[miss], start[miss] = got, base + left
        at = _narrow(low, span, start, size, unit)
        if len(at):
            low[at] <<= _WORD
            some = place.take(at)
            code[at] = code.take(at) << _WORD | take(some, ends.take(at))
            place[at] = some + 1
        model.update(x, a == x, b == x)
        grid[t] = x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise CorruptBlock("checksum of the ids")
    return ids
