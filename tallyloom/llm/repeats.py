"""Removal of repeated passages by merging shard Burrows-Wheeler transforms.

Every byte that lies in a ``width``-byte string which also starts earlier (in a
smaller document, or earlier in the same one) is removed.

*Which strings meet.*  Each window of ``width`` bytes has an anchor: the least of
the hashes of its ``anchor``-byte substrings, the leftmost at a tie.  Equal
windows have equal anchors in equal places, so only runs of windows with one
anchor ("stretches", about 30 windows and 130 bytes) need to meet.  Stretches
are compared first by hash: in the task that reads them and then per anchor,
equal stretches are collapsed to their first occurrence and all others are
repeated as a whole - the pre-aggregation that keeps a passage which a third of
all documents share from ever being gathered.  What stays are anchors under
which *different* stretches stand, that is the rims of shared passages; only
their bytes are fetched.

*Which windows repeat.*  In a task the stretches of many anchors are halved into
two shards; each shard's suffix array and transform are built, and the two
transforms are merged by iterative interleave refinement: starting from "all of
the first, then all of the second", each pass reads the transforms in the
current interleave, deals it stably by symbol (two symbols a pass), and splits
the blocks of suffixes that agree so far.  At ``width`` symbols a block is exactly an interval of
suffixes with a common prefix of ``width`` bytes or more - the repeated
intervals - and no suffix was sorted again.  In each interval all but the first
occurrence repeat.

An anchor with more than ``block`` different stretches - a common line in many
surroundings - is split by its contexts: a window with ``room`` bytes beside the
anchor holds half of them on its right or on its left, so each stretch goes on
under the anchor lengthened by that many bytes to the right, and again to the
left, cut to the windows concerned; all places of a window take the same way.
Equal cuts (with the anchor in the same place) are collapsed to the first, and groups that are still too large are
split again, until after seven rounds a group is one string.  The work is linear
in the anchor's stretches, and no group in a task is larger than ``block``.

Not everything goes through transforms: at 1.5 to 2 microseconds a byte in numpy
the whole text would cost several thousand CPU seconds a GB; see the README.

Defined results: null and empty texts have nothing to remove; rows that repeat
an id, or have none, are ordered by id (null first) and text; equal rows stay
in that order; texts of any length are read whole; extra columns are dropped; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_files, give_back, materialize, numbered, slices, tidy, utf8_of
from .fingerprints import _table, mixed

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int):
    """(text index, start, windows, anchor's place behind the start, anchor hash, content hash) of each run of windows with one anchor."""
    n = len(data) - width + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n <= 0:
        return empty
    power, inverse = _table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    grams = len(data) - anchor + 1
    hashes = mixed((sums[anchor:] - sums[:grams]) * inverse[:grams])
    place = np.uint64((1 << 30) - 1)
    least = (hashes & ~place) | np.arange(grams, dtype=np.uint64)  # leftmost at a tie of the upper bits
    span, reach = width - anchor + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[span - reach : span - reach + n])
    spots = (least & place).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.arange(n) + width <= ends[:n]
    opens = valid.copy()
    opens[1:] &= (spots[1:] != spots[:-1]) | ~valid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    opens[inner] = valid[inner]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return empty
    stops = np.union1d(np.append(starts, n), np.flatnonzero(~valid))
    last = stops[np.searchsorted(stops, starts, side="right")]
    windows = last - starts
    tail = last + width - 1
    content = mixed((sums[tail] - sums[starts]) * inverse[starts] + windows.astype(np.uint64))
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], windows, spots[starts] - starts, hashes[spots[starts]].view(np.int64), content.view(np.int64)


# ---- transforms ---------------------------------------------------------
def shard_transform(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform over symbol pairs) of strings of symbols 1..255, each closed by a 0 at ``ends``; strings of under 250 symbols.

    Suffixes are sorted whole: by their first seven symbols, then by rank
    doubling; those that are a closing 0 alone follow the order of the strings
    that come after them cyclically, so that stepping back over a string's start
    stays in order.  The transform holds the two symbols before each suffix.
    """
    n = len(data)
    size = np.diff(np.concatenate([[-1], ends]))
    close = np.repeat(ends, size)  # the closing 0 of each position's string
    at = np.arange(n)
    wide = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.int64)
    rank = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(7):
        rank = rank << 8 | np.where(alive, wide[k : k + n], 0)
        alive &= wide[k : k + n] != 0
    order = np.argsort(rank)
    reach = 7
    while True:
        fresh = np.empty(n, bool)
        fresh[0] = False
        ranked = rank[order]
        np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
        number = np.cumsum(fresh)
        rank = np.empty(n, np.int64)
        rank[order] = number
        if reach >= 250:
            break
        after = at + reach
        rank = rank * (n + 1) + np.where(after <= close, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(rank)
        reach *= 2
    heads = np.concatenate([[0], ends[:-1] + 1])
    order = np.argsort(rank * n + at)
    place = np.empty(n, np.int64)
    place[order] = at
    order[: len(ends)] = ends[np.argsort(place[heads], kind="stable")]
    back = at - 1
    back[heads] = ends
    one = back[order]
    return order, data[back[one]].astype(np.uint16) << 8 | data[one]


def merge_transforms(first: np.ndarray, second: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged suffix, number of its block of suffixes that agree in ``depth`` symbols, an even number), by interleave refinement."""
    shard = np.concatenate([np.zeros(len(first), bool), np.ones(len(second), bool)])
    block = np.zeros(len(shard), np.int32)
    both, symbols = np.concatenate([first, second]), np.empty(len(shard), np.uint16)
    split = np.zeros(len(shard), bool)
    for _ in range(depth // 2):
        symbols[np.concatenate([np.flatnonzero(~shard), np.flatnonzero(shard)])] = both
        order = np.argsort(symbols, kind="stable")  # a radix sort
        shard = shard[order]
        dealt, agreed = symbols[order], block[order]
        np.not_equal(dealt[1:], dealt[:-1], out=split[1:])
        split[1:] |= agreed[1:] != agreed[:-1]
        block = np.cumsum(split, dtype=np.int32)
    return shard, block


def repeated_windows(raw: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(doc, start, bytes) of the runs of windows in these stretches that also start earlier in one of them."""
    half = max(1, len(raw) // 2)
    parts, places = [], []
    for a, b in ((0, half), (half, len(raw))):
        if a >= b:
            parts.append((np.zeros(0, np.int64), np.zeros(0, np.uint16)))
            places.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        sizes = np.asarray([len(x) for x in raw[a:b]])
        ends = np.cumsum(sizes + 1) - 1
        data = np.zeros(int(ends[-1]) + 1, np.uint8)
        inside = np.ones(len(data), bool)
        inside[ends] = False
        data[inside] = np.frombuffer(b"".join(raw[a:b]), np.uint8) + np.uint8(1)  # no byte of UTF-8 is above 0xF4
        parts.append(shard_transform(data, ends))
        string = np.repeat(np.arange(a, b), sizes + 1)
        offset = np.arange(len(data)) - np.repeat(ends - sizes, sizes + 1)
        places.append((string, offset, np.repeat(sizes, sizes + 1) - offset))
    shard, block = merge_transforms(parts[0][1], parts[1][1], width)
    string, offset, left = (np.empty(len(shard), np.int64) for _ in range(3))
    for k in (0, 1):
        here = shard == k
        order = parts[k][0]
        string[here], offset[here], left[here] = places[k][0][order], places[k][1][order], places[k][2][order]
    full = left >= width  # suffixes that hold a window
    string, offset, block = string[full], offset[full], block[full]
    if not len(string):
        return []
    where_doc, where = doc[string], start[string] + offset
    order = np.lexsort((where, where_doc, block))
    opens = np.ones(len(order), bool)
    opens[1:] = block[order][1:] != block[order][:-1]
    head = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    later = order[(where_doc[head] != where_doc[order]) | (where[head] != where[order])]
    if not len(later):
        return []
    spots = np.unique(np.stack([where_doc[later], where[later]], axis=1), axis=0)
    cut = np.flatnonzero((spots[1:, 0] != spots[:-1, 0]) | (spots[1:, 1] != spots[:-1, 1] + 1)) + 1
    heads, tails = np.concatenate([[0], cut]), np.concatenate([cut, [len(spots)]])
    return list(zip(spots[heads, 0].tolist(), spots[heads, 1].tolist(), (tails - heads + width - 1).tolist()))


def _by_context(crowded: DataFrame, core: int, room: int) -> DataFrame:
    """The stretches (key, doc, start, at, raw) of crowded groups under their ``core`` bytes lengthened to the right and to the left, cut to the windows that hold them."""
    more, at, size = (room + 1) // 2, F.col("at").cast("int"), F.length("raw")

    def cut(begin, end, core_at, side: int):
        enough = (core_at >= 0) & (core_at + core + more <= size) & (end - begin >= core + room)
        key = F.xxhash64("key", F.substring("raw", core_at + 1, F.lit(core + more)), F.lit(side))
        return F.when(enough, F.struct(key.alias("key"), "doc", (F.col("start") + begin).alias("start"), (core_at - begin).cast("long").alias("at"), F.substring("raw", begin + 1, end - begin).alias("raw")))

    right = cut(F.greatest(at - (room - more), F.lit(0)), F.least(at + core + room, size), at, 0)
    left = cut(F.greatest(at - room, F.lit(0)), F.least(at - more + core + room, size), at - more, 1)
    return crowded.select(F.explode(F.filter(F.array(right, left), lambda x: x.isNotNull())).alias("w")).select("w.*")


# ---- the distributed steps ----------------------------------------------
def remove_repeats(df: DataFrame, width: int = 100, anchor: int = 36, id_col: str = "doc_id", text_col: str = "text", block: int = 1000, shard_bytes: int = 1 << 17, task_bytes: int = 2 << 20, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans long, kept binary) of every row; with ``carry``, also a struct ``carried`` of the columns named there, but for the text.

    ``decoded``: kept is a string, without the characters that were cut in two.
    """
    if width % 2 or width > 120:
        raise ValueError("width: an even number of bytes up to 120")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry if c != text_col] or [F.lit(0)]).alias("carried"))
    docs = numbered(source, "id", "text")
    texts = docs.select("doc", "text")
    n_docs = docs.count()

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All stretches; those that repeat one of the same task's batch have windows < 0 and are dealt by place."""
        found: list[np.ndarray] = []

        def settle():
            doc, start, windows, key, content = np.concatenate(found, axis=1)
            found.clear()
            order = np.lexsort((start, doc, content, key))
            doc, start, windows, key, content = (x[order] for x in (doc, start, windows, key, content))
            again = np.zeros(len(doc), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            spread = mixed(doc.view(np.uint64) * np.uint64(1 << 20) + start.view(np.uint64)).view(np.int64)
            key, windows = np.where(again, spread, key), np.where(again, -windows, windows)
            for at in range(0, len(doc), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(content[part]), pa.array(doc[part]), pa.array((start[part] << 16) * np.sign(windows[part]) + windows[part])], names=["key", "content", "doc", "place"])

        for whole in batches:
            for batch in slices(whole, 1, 1 << 17):
                text, start, windows, at, key, content = stretches(*utf8_of(batch.column(1)), width, anchor)
                if len(text):
                    found.append(np.stack([batch.column(0).to_numpy()[text], start, at << 8 | windows, key, content]))
                if sum(h.shape[1] for h in found) > 300_000:
                    yield from settle()
        if found:
            yield from settle()

    def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order of (key, content, doc, place): repeated stretches as spans (kind 0), first ones under a shared anchor as wanted (kind 1)."""
        last_key = last_content = None
        pending = None  # the first row of the current key while its stretches are all alike
        for batch in batches:
            if not batch.num_rows:
                continue
            key, content, doc, place = (c.to_numpy() for c in batch.columns)
            local = place < 0
            start, at, windows = np.abs(place) >> 16, np.abs(place) >> 8 & 0xFF, np.abs(place) & 0xFF
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_content = new_key.copy()
            new_content[1:] |= content[1:] != content[:-1]
            if last_key is not None and key[0] == last_key:
                new_key[0] = False
                new_content[0] = content[0] != last_content
            wanted = new_content & ~new_key & ~local
            run = np.cumsum(new_key)
            shared = np.unique(run[wanted])  # runs of keys with another stretch
            heads = np.flatnonzero(new_key)
            wanted[heads[shared[shared > 0] - 1]] = True
            wanted &= ~local
            rows = [np.stack([doc, start, windows, key, at, np.ones_like(doc)])[:, wanted]]
            if 0 in shared and pending is not None:
                rows.append(pending[:, None])
                pending = None
            again = local | ~new_content
            rows.append(np.stack([doc, start, windows + width - 1, key, at, np.zeros_like(doc)])[:, again])
            if len(heads):
                h = heads[-1]
                pending = None if wanted[h] or local[h] else np.asarray([doc[h], start[h], windows[h], key[h], at[h], 1])
            last_key, last_content = key[-1], content[-1]
            out = np.concatenate(rows, axis=1)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc", "start", "size", "key", "at", "kind"])

    looked = texts.mapInArrow(tidy(first_look), "key long, content long, doc long, place long")
    looked = looked.repartition("key").sortWithinPartitions("key", "content", "doc", F.abs("place"))
    found = looked.mapInArrow(tidy(second_look), "doc long, start long, size long, key long, at long, kind long")
    found = materialize(few_files(found, n_docs, narrow=True), "repeats-found")

    wanted = found.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("start", "size", "key", "at")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, want in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                out += [(w["key"], doc, w["start"], w["at"], raw[w["start"] : w["start"] + w["size"] + width - 1]) for w in want]
            for at in range(0, len(out), 20_000):
                columns = zip(*out[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "doc", "start", "at", "raw"])

    rims = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(tidy(fetch), "key long, doc long, start long, at long, raw binary")
    live = materialize(few_files(rims, n_docs, narrow=True), "repeats-rims")
    core, room, made, groups, again = anchor, width - anchor, [live], [], []
    while True:
        # a table, so that the joins below read it through a shuffle of its own and a hot anchor's side can be split
        sizes = materialize(few_files(live.groupBy("key").agg(F.count("*").alias("n")), n_docs, narrow=True), "repeats-sizes")
        made.append(sizes)
        groups.append(live.join(sizes.where(F.col("n").between(2, block)), "key", "left_semi"))
        crowded = sizes.where(F.col("n") > block)
        if crowded.isEmpty():
            break
        wider = materialize(few_files(_by_context(live.join(crowded, "key", "left_semi"), core, room), n_docs, narrow=True), "repeats-contexts")
        firsts = materialize(few_files(wider.groupBy("key", "at", "raw").agg(F.min(F.struct("doc", "start")).alias("f")), n_docs, narrow=True), "repeats-firsts")
        made += [wider, firsts]
        again.append(wider.join(firsts, ["key", "at", "raw"]).where((F.col("doc") != F.col("f.doc")) | (F.col("start") != F.col("f.start"))).select("doc", "start", F.length("raw").cast("long").alias("size")))
        live = firsts.select("key", "f.*", "at", "raw")
        core, room = core + (room + 1) // 2, room // 2

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of a key, as many together as make a shard worth a transform."""
        raw, doc, start, size, last = [], [], [], 0, None

        def settle():
            spans = repeated_windows(raw, np.asarray(doc, np.int64), np.asarray(start, np.int64), width)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], names=["doc", "start", "size"])

        for batch in batches:
            for group, d, s, r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and group != last:
                    yield from settle()
                    raw, doc, start, size = [], [], [], 0
                raw.append(r)
                doc.append(d)
                start.append(s)
                size += len(r)
                last = group
        if raw:
            yield from settle()

    # a byte costs about a microsecond here: as many tasks as there is work, where the engine would go by size
    met = reduce(DataFrame.unionByName, [g.select("key", "doc", "start", "raw") for g in groups])
    work = (met.agg(F.sum(F.length("raw")).alias("n")).first()["n"] or 0) // task_bytes + 1
    merged = met.repartition(work, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(tidy(merge), "doc long, start long, size long")
    spans = reduce(DataFrame.unionByName, [*again, merged], found.where("kind = 0").select("doc", "start", "size")).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = materialize(few_files(spans, n_docs, narrow=True), "repeats-spans")
    discard(found, *made)

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept {'string' if decoded else 'binary'}")
    def cut(texts_: pd.Series, spans_: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts_, spans_):
            raw = (text or "").encode()
            kept, done, removed, runs = [], 0, 0, 0
            for a, b in sorted((g["start"], g["start"] + g["size"]) for g in (gone if gone is not None else ())):
                if a > done or not runs:
                    runs += 1
                    kept.append(raw[done:a])
                    done = a
                removed += max(0, b - done)
                done = max(done, b)
            kept.append(raw[done:])
            rest = b"".join(kept)
            out.append((len(raw), removed, runs, rest.decode("utf-8", "ignore") if decoded else rest))
        give_back()
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    done = docs.join(spans, "doc", "left").withColumn("cut", cut("text", "spans"))
    return done.select("id", "cut.*", *["carried"] * bool(carry))
