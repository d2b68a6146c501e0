"""Token counts by a compiled finite-state transducer.

The byte-level BPE vocabulary is compiled, lazily, into a deterministic byte
transducer whose transitions are annotated with emitted-token counts.

*Why it is finite.*  For a BPE vocabulary the encoding of a prefix p[:i] ends in
exactly one token t such that the pair (last token of p[:i-len(t)], t) is one
that BPE leaves alone.  So the count of p[:i] is the count of p[:i-len(t)] plus
one, and all that later bytes can ask for is, for each place inside the current
run where a longer token may have begun: its node in the vocabulary's trie, the
token that ended there, and its count relative to now.  That tuple is the state;
a transition's annotation is the change of the count (negative where a merge
takes back tokens that were counted).  A pre-token boundary resets to the start
state, which is the other component of the transducer: boundaries depend on at
most three characters around them, so they come from array comparisons.

*Parallel run.*  Texts are cut into chunks of ``CHUNK`` bytes anywhere, inside
words as well.  All chunks of a batch run in lock-step through the dense
transition table, each from the start state at its first boundary, which fixes
its exit state.  The head before a first boundary is a map (entry state -> exit
state, count).  A chunk without a boundary is all head, so its map is only
tabulated at the states that can enter it: the exits of the chunk before, from
the states that can enter that one, and from the start state as a first guess;
text forgets its entry after a few bytes, so this closes after two rounds, and
after as many as the period has states where a long run repeats.  The maps of
neighbouring chunks are then composed by doubling, as in a prefix scan, which
gives each chunk the entry it really has in logarithmically many steps.  Runs
whose maps don't close within ``MAP_STATES`` states a chunk are walked chunk by
chunk.  A document's count is the segmented sum.

The dense table is bounded: beyond ``max_states`` it is flushed and grows anew,
as lazy automata do.  No shuffle, so no key can be hot; one very long text is
many chunks.

Defined results: null and empty texts have 0 bytes and 0 tokens; each repeated
row is counted; extra columns are dropped; the vocabulary's special strings in
a text count as one token, which is the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed, slices, tidy, tokenizer_path, utf8_of

CHUNK = 512
MAP_STATES = 64
PAIRS = 2_000_000  # remembered answers of CountTransducer.stays
LETTER, NUMBER, SPACE, WHITE, OTHER = 1, 2, 3, 4, 5
_compiled: dict[str, "CountTransducer"] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    def __init__(self, path: str, max_states: int = 240_000):
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        symbol = byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.bytes_of = {i: t for t, i in vocab.items()}
        of = lambda s: vocab[bytes(symbol[c] for c in s)]
        self.merge = {(of(a), of(b)): (rank, of(a + b)) for rank, (a, b) in enumerate(merges)}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in vocab.items():
            node = 0
            for b in token:
                node = self._child(node, b)
            self.token_at[node] = i
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.classes = np.zeros(0x110000, np.uint8)
        self._reset()

    def _child(self, node: int, byte: int) -> int:
        found = self.children[node].get(byte)
        if found is None:
            found = self.children[node][byte] = len(self.children)
            self.children.append({})
            self.token_at.append(-1)
        return found

    # ---- the automaton -------------------------------------------------
    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.column = np.full(256, -1, np.int64)  # bytes that occurred, dealt columns as they come
        self.seen: list[int] = []
        self.table = np.full((1024, 64), -1, np.int32)  # next state * 256 + count + 128

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = len(self.seen)
                self.seen.append(int(b))
        while len(self.seen) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
        return self.column[data]

    def merged(self, symbols: list[int]) -> list[int]:
        """BPE of a few symbols: the lowest-ranked pair first, from the left."""
        while len(symbols) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            symbols = symbols[:i] + [self.merge[symbols[i], symbols[i + 1]][1]] + symbols[i + 2 :]
        return symbols

    def stays(self, last: int, token: int) -> bool:
        """Whether BPE leaves ``token`` whole after ``last`` (-1: at the start of a pre-token)."""
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            raw = (self.bytes_of[last] if last >= 0 else b"") + self.bytes_of[token]
            known = self.pairs[last, token] = self.merged([self.single[b] for b in raw]) == ([last, token] if last >= 0 else [token])
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        kept, ended, change = [], -1, 0
        for node, last, count in state:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and ended < 0 and self.stays(last, token):
                ended, change = token, count + 1
            if self.children[child]:
                kept.append((child, last, count))
        return (*((n, t, c - change) for n, t, c in kept), (0, ended, 0)), change

    def _fill(self, missing: np.ndarray) -> None:
        for key in missing.tolist():
            row, col = divmod(key, self.table.shape[1])
            state, change = self.step(self.states[row], self.seen[col])
            at = self.number.get(state)
            if at is None:
                at = self.number[state] = len(self.states)
                self.states.append(state)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.full((max(1024, len(self.table) // 4), self.table.shape[1]), -1, np.int32)])
            self.table[row, col] = at * 256 + change + 128

    def run(self, data: np.ndarray, resets: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of the lanes data[starts:ends], all in lock-step from their entry states."""
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than t
        columns, wide = self._columns(data), self.table.shape[1]
        flat = self.table.reshape(-1)
        for t in range(longest):
            a = int(active[t])
            at = starts[:a] + t
            key = np.where(resets[at], 0, state[:a]) * wide + columns[at]
            move = flat[key]
            if a and move.min() < 0:
                self._fill(np.unique(key[move < 0]))
                flat = self.table.reshape(-1)
                move = flat[key]
            state[:a] = move >> 8
            count[:a] += (move & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    # ---- pre-token boundaries -----------------------------------------
    def _classify(self, points: np.ndarray) -> np.ndarray:
        classes = self.classes[points]
        if not classes.all():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[classes == 0]).tolist():
                c = chr(p)  # the library itself says which run a character joins
                if c == " ":
                    kind = SPACE
                elif len(split(f"a{c}b")) == 1:
                    kind = LETTER
                elif len(split(f"1{c}2")) == 1:
                    kind = NUMBER
                elif len(split(f"!{c}?")) == 1:
                    kind = OTHER
                else:
                    kind = WHITE
                self.classes[p] = kind
            classes = self.classes[points]
        return classes

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte, whether a pre-token starts there."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        width = np.diff(np.append(at, len(data)))
        first = data[at].astype(np.int32)
        points = np.where(width == 1, first, np.where(width == 2, first & 0x1F, np.where(width == 3, first & 0x0F, first & 0x07)))
        for k in (1, 2, 3):
            more = np.flatnonzero(width > k)
            points[more] = (points[more] << 6) | (data[at[more] + k] & 0x3F)
        kind = self._classify(points)
        n = len(at)
        first_of = np.zeros(n + 1, bool)  # characters that open a document
        first_of[np.searchsorted(at, offsets)] = True
        last_of = np.append(first_of[1:n], True) if n else first_of[:0]
        first_of = first_of[:n]
        before = np.empty_like(kind)
        before[1:], before[:1] = kind[:-1], 0
        before[first_of] = 0
        after = np.empty_like(kind)
        after[:-1], after[-1:] = kind[1:], 0
        after[last_of] = 0
        white, white_before = (kind == SPACE) | (kind == WHITE), (before == SPACE) | (before == WHITE)
        white_after = (after == SPACE) | (after == WHITE)
        start = np.where(white, ~white_before | ((after != 0) & ~white_after), np.where(white_before, before != SPACE, kind != before))
        # a contraction opens where an apostrophe opens a pre-token and no space went before it
        quote = np.flatnonzero((points == 0x27) & (before != OTHER) & (before != SPACE))
        if len(quote):
            padded = np.append(points, [0, 0, 0])
            edge = np.append(first_of, [True, True, True])
            one, two = padded[quote + 1], padded[quote + 2]
            has_one, has_two = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
            short = has_one & np.isin(one, [ord(c) for c in "stmd"])
            long = has_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            start[quote[short] + 1] = False
            start[quote[long] + 1] = False
            then = np.concatenate([quote[short] + 2, quote[long] + 3])
            start[then[then < n]] = True
        start[first_of] = True
        out = np.zeros(len(data), bool)
        out[at[start]] = True
        return out

    # ---- heads of chunks -----------------------------------------------
    def _heads(self, data: np.ndarray, resets: np.ndarray, starts: np.ndarray, opens: np.ndarray, ends: np.ndarray, exits: np.ndarray, counts: np.ndarray) -> None:
        """Add the tokens of what stands before chunks' first boundaries to ``counts``."""
        head = opens > starts
        waiting = np.flatnonzero(head)
        if not len(waiting):
            return
        through = head & (opens == ends)
        after_through = through[waiting - 1]  # the entry is what a chunk without boundary makes of its own
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = through[:-1] & head[1:]
        first = waiting[~after_through]
        entries = (first << 32) | exits[first - 1]
        guesses = np.flatnonzero(goes_on) << 32  # from the start state
        known, out, extra = (np.zeros(0, np.int64) for _ in range(3))
        fresh = np.union1d(entries, guesses)
        while len(fresh):
            if len(known) + len(fresh) > MAP_STATES * len(waiting) + 1024:
                self._walk_heads(data, resets, starts, opens, waiting, through, exits, counts)
                return
            chunk = fresh >> 32
            to, n = self.run(data, resets, starts[chunk], opens[chunk], fresh & 0xFFFFFFFF)
            known, out, extra = np.concatenate([known, fresh]), np.concatenate([out, to]), np.concatenate([extra, n])
            more = goes_on[chunk]
            fresh = np.setdiff1d((chunk[more] + 1) << 32 | to[more], known)
        order = np.argsort(known)
        known, out, extra = known[order], out[order], extra[order]
        chunk, end = known >> 32, len(known)
        # each map's entry leads to an entry of the next chunk's map, or to the end; doubled until all lead to the end
        jump = np.append(np.where(goes_on[chunk], np.searchsorted(known, (chunk + 1) << 32 | out), end), end)
        real = np.zeros(end + 1, bool)
        real[np.searchsorted(known, entries)] = True
        while (jump[real] != end).any():
            real[jump[real]] = True
            jump = jump[jump]
        np.add.at(counts, chunk[real[:-1]], extra[real[:-1]])

    def _walk_heads(self, data: np.ndarray, resets: np.ndarray, starts: np.ndarray, opens: np.ndarray, waiting: np.ndarray, through: np.ndarray, exits: np.ndarray, counts: np.ndarray) -> None:
        """The same, from the exit state of the chunk before, one after the other in each run."""
        ready = ~through
        while len(waiting):
            go = waiting[ready[waiting - 1]]
            out, extra = self.run(data, resets, starts[go], opens[go], exits[go - 1])
            counts[go] += extra
            exits[go] = np.where(through[go], out, exits[go])
            ready[go] = True
            waiting = waiting[~np.isin(waiting, go)]

    # ---- documents -----------------------------------------------------
    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document data[offsets[i]:offsets[i+1]]."""
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(len(sizes), np.int64)
        if len(self.states) > self.max_states:
            self._reset()
        resets = self.boundaries(data, offsets)
        parts = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), parts)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offsets[owner] + rank * CHUNK
        ends = np.minimum(starts + CHUNK, offsets[owner + 1])
        marks = np.append(np.flatnonzero(resets), len(data))
        opens = np.minimum(marks[np.searchsorted(marks, starts)], ends)  # first boundary in the chunk, or its end
        exits, counts = self.run(data, resets, opens, ends, np.zeros(len(owner), np.int64))
        self._heads(data, resets, starts, opens, ends, exits, counts)
        total = np.zeros(len(sizes), np.int64)
        np.add.at(total, owner, counts)
        return total


def transducer_for(path: str) -> CountTransducer:
    if path not in _compiled:
        _compiled[path] = CountTransducer(path)
    return _compiled[path]


def count_batch(machine: CountTransducer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text; special strings are cut out first, one token each."""
    import pyarrow.compute as pc

    data, offsets = utf8_of(texts)
    sizes = np.diff(offsets)
    special = np.zeros(len(sizes), bool)
    for s in machine.special:
        special |= pc.match_substring(texts.fill_null(""), s).to_numpy(zero_copy_only=False)
    if not special.any():
        return sizes, machine.count(data, offsets)
    import re

    cut = re.compile("|".join(map(re.escape, machine.special)))
    parts, owner, extra = [], [], np.zeros(len(sizes), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        pieces = cut.split(text or "") if special[i] else [text or ""]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    counts = machine.count(*utf8_of(pa.array(parts, pa.string())))
    np.add.at(extra, np.asarray(owner), counts)
    return sizes, extra


def count_tokens(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_for(tokenizer_path(vocabulary))
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                size, n = count_batch(machine, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = narrowed(df, id=id_col, text=text_col)
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
