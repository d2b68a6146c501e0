r"""Chat formatting in budgeted, turn-aligned windows.

Template: every turn is ``<turn role="R">text</turn>\n``; a turn that an earlier
window already showed is marked ``<turn role="R" again>``.  Inside roles and texts
``\`` becomes ``\\``, ``<`` becomes ``\l`` and ``"`` (roles only) ``\q``, so no text can
hold a marker and :func:`parse_window` gives the turns back exactly.

Windows: with P the prefix sums of the turns' tokens, a window that starts at
turn i runs to the largest j with system + history + P[j] - P[i] <= budget (found
by binary search), one turn at least.  The system turn that opens a conversation
stands in each of its windows; up to ``history`` tokens of the turns before are
repeated, whole turns only.  The loss mask covers assistant texts that are new
in the window: each exactly once over the conversation.

Turns are escaped and counted where they are read; one shuffle brings a
conversation's turns in order, and a task streams them with state bounded by the
budget (not by the conversation), so a conversation of any length is held in
constant memory.

Defined results: null text is the empty text, null role the empty role; a null
conversation id is a conversation of its own; turns that tie are ordered by role
and text; repeated rows are repeated turns; extra columns are dropped; an empty
table has no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, texts_of, tidy, tokenizer_path
from .counts import count_batch, transducer_for

_TURN = re.compile(r'<turn role="([^"<]*)"( again)?>([^<]*)</turn>\n')
_ESCAPED = re.compile(r"\\(.)")
_MEANS = {"\\": "\\", "l": "<", "q": '"'}
WINDOW = "conv long, window long, text string, loss_starts array<int>, loss_ends array<int>, new_turns int, again_turns int, tokens long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace('"', "\\q")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANS[m[1]], text)


def parse_window(text: str) -> list[tuple[str, bool, str]]:
    """(role, shown before, text) of each turn of a formatted window; raises where it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), m[2] is not None, unescape(m[3])))
        at = m.end()
    return out


class WindowBuilder:
    """Streams one conversation's turns (escaped role, escaped text, tokens) into windows."""

    LOOK = 1024  # turns looked at together; a window that reaches their end waits for more

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system = None
        self.past: list = []  # turns that may be repeated
        self.turns: list = []
        self.window = self.seen = 0

    def add(self, turn) -> Iterator[dict]:
        if not self.seen and turn[0] == "system":
            self.system = turn
        else:
            self.turns.append(turn)
        self.seen += 1
        if len(self.turns) >= self.LOOK:
            yield from self._cut(False)

    def end(self) -> Iterator[dict]:
        yield from self._cut(True)
        if self.system and not self.window:
            yield self._format([], [])

    def _cut(self, last: bool) -> Iterator[dict]:
        sums = np.concatenate([[0], np.cumsum([t[2] for t in self.turns])])
        system, i = (self.system[2] if self.system else 0), 0
        while i < len(self.turns):
            room = self.budget - system - int(sums[i + 1] - sums[i])
            again, used = [], 0
            for t in reversed(self.past):
                if used + t[2] > min(self.history, room):
                    break
                again.insert(0, t)
                used += t[2]
            j = int(np.searchsorted(sums, sums[i] + self.budget - system - used, side="right")) - 1
            j = min(max(j, i + 1), len(self.turns))
            if j == len(self.turns) and not last and sums[j] - sums[i] + system + used <= self.budget and j - i < self.LOOK:
                break
            yield self._format(again, self.turns[i:j])
            kept, size = [], 0
            for t in reversed(self.past + self.turns[i:j]):
                if size + t[2] > self.history:
                    break
                kept.insert(0, t)
                size += t[2]
            self.past, i = kept, j
        self.turns = self.turns[i:]

    def _format(self, again: list, new: list) -> dict:
        parts, starts, ends, at, tokens = [], [], [], 0, 0
        first = [(self.system, self.window > 0)] if self.system else []
        for (role, text, n), old in [*first, *((t, True) for t in again), *((t, False) for t in new)]:
            head = f'<turn role="{role}"{" again" if old else ""}>'
            if role == "assistant" and not old:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(text))
            piece = f"{head}{text}</turn>\n"
            parts.append(piece)
            at += len(piece)
            tokens += n
        out = {"window": self.window, "text": "".join(parts), "loss_starts": starts, "loss_ends": ends, "new_turns": len(new) + bool(first and not self.window), "again_turns": len(again) + bool(first and self.window), "tokens": tokens}
        self.window += 1
        return out


def format_conversations(df: DataFrame, budget: int = 2048, history: int = 512, vocabulary: str = "byte_bpe_50k.json", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows (conv, window, text, loss_starts, loss_ends, new_turns, again_turns, tokens); loss spans are code points of ``text``."""
    names = ["conv", "turn", "role", "text", "tokens"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_for(tokenizer_path(vocabulary))
        for batch in batches:
            roles, texts = [escape_role(x) for x in texts_of(batch.column(2))], [escape(x) for x in texts_of(batch.column(3))]
            _, n = count_batch(machine, pa.array([f'<turn role="{r}">{t}</turn>\n' for r, t in zip(roles, texts)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        builder, now = None, object()
        held = 0

        def flush():
            nonlocal rows, held
            columns = {k: [r[k] for r in rows] for k in ("conv", "window", "text", "loss_starts", "loss_ends", "new_turns", "again_turns", "tokens")}
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], names=list(columns))

        def done(found):
            nonlocal held
            for w in found:
                rows.append({"conv": now} | w)
                held += len(w["text"])

        for batch in batches:
            for conv, role, text, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if builder is None or conv != now:
                    if builder is not None:
                        done(builder.end())
                    builder, now = WindowBuilder(budget, history), conv
                done(builder.add((role, text, tokens)))
                if held > 4 << 20:
                    yield flush()
        if builder is not None:
            done(builder.end())
        if rows:
            yield flush()

    source = narrowed(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("conv", F.col("conv").cast("long"))
    turns = source.mapInArrow(tidy(measure), f"conv long, turn {source.schema['turn'].dataType.simpleString()}, role string, text string, tokens long")
    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(tidy(windows), WINDOW)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state = object(), None

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def done():
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != now:
                    if state:
                        done()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, again, said in parse_window(text):
                    if not again:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(rows) >= 10_000:
                yield flush()
        if state:
            done()
        if rows:
            yield flush()

    ordered = windows.repartition("conv").sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(tidy(run), "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
