"""Library token ids by way of a table of distinct units.

Where no vocabulary's pre-token can reach over a cut, the units between cuts are
segmented independently, so each worker keeps a bounded table (unit -> ids, see
:mod:`unit_columns`) and joins a text's ids from it.

* Vocabularies that drop white space: a unit is what stands between white space.
  New units are cut into pre-tokens and segmented all at once with the
  vocabulary's own ranks: a control character, which units sent this way don't
  hold, stands behind each pre-token for the vocabulary's end-of-word suffix, and
  the symbols with the suffix rank before all merges.  A unit with other
  characters than those for which the pattern here is known to cut as the library
  does goes to the library as it is.
* Byte-level vocabularies without the suffix: a unit is a blank
  and what follows it.  New units are segmented all at once, with the
  vocabulary's own ranks, and cut where the tokens' bytes reach a unit's end;
  those of other characters, empty ones and those with white space at an end go
  to the library.  The cut is where the library itself splits, except where a
  blank stands behind white space and before white space or the end; such texts
  go to the library whole.

Texts that hold a special string, and all texts where the vocabulary's ids aren't
its merges' ranks, go to the library whole as well.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .counts import byte_symbols
from .unit_columns import UnitColumns

_tables: dict[tuple[str, str], "IdTable"] = {}
#: Anything but printable ASCII, plain white space and Latin letters up to U+024F (without the dotted I, digit-like signs and the no-break space).
_UNUSUAL = re.compile("[^\t\n\r -~¡-©«-±´-¸»À-įı-ɏ]")
#: Empty units, those with white space at an end, and unusual ones; for Arrow.
_APART = "^$|^[\t\n\r]|[\t\n\r]$|" + _UNUSUAL.pattern
_WORD_LEVEL = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python alone
#: How byte-level patterns end: white space before more of it, then any; and units with such runs inside.
_RUNS, _RUN = r"|\s+(?!\S)|\s+", "[\t\n\r]{2}"
_MARK = "\x01"
_BEHIND_EACH = "\\g<0>" + _MARK
#: White space before and behind a cut, as flags.
_BEFORE, _BEHIND = 1, 2


def _token_bytes(model: dict) -> dict[bytes, int]:
    """A byte-level vocabulary's tokens as bytes, the end-of-word suffix as its mark."""
    bytes_of, suffix = byte_symbols(), model.get("end_of_word_suffix") or ""
    found = {}
    for token, i in model["vocab"].items():
        word = token.removesuffix(suffix)
        if all(c in bytes_of for c in word):
            found[bytes(bytes_of[c] for c in word) + (_MARK.encode() if word != token else b"")] = i
    return found


def _ranked(model: dict, pattern: str):
    """An encoder by the ranks of a byte-level vocabulary, where ids are those of single symbols and then of the merges in order; else None."""
    import tiktoken

    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    singles = 512 if model.get("end_of_word_suffix") else 256
    if any(model["vocab"].get(token) != singles + k for k, token in enumerate(made)):
        return None
    ranks = {token: i for token, i in _token_bytes(model).items() if i < singles + len(made)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _joined(units: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), " ")[0].as_py()


def _places(mask: pa.Array) -> np.ndarray:
    return np.flatnonzero(mask.to_numpy(zero_copy_only=False))


class IdTable:
    def __init__(self, path: str, dtype: str = "<u4", size: int = 500_000):
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.drops_white = spec["normalizer"] is not None and "\\s" in json.dumps(spec["pre_tokenizer"])
        self.dtype, self.size = np.dtype(dtype), size
        import public_tokenizers

        self.ranked = _ranked(spec["model"], f"[^{_MARK} ]+{_MARK}| " if self.drops_white else public_tokenizers.PATTERN)
        # without runs of white space the pattern needs no lookahead, which takes the regex engine twice the time
        ahead = not self.drops_white and public_tokenizers.PATTERN.endswith(_RUNS)
        self.ranked_plain = _ranked(spec["model"], public_tokenizers.PATTERN.removesuffix(_RUNS) + r"|\s") if ahead else self.ranked
        tokens = _token_bytes(spec["model"])
        self.blank = tokens.get(b" ")
        self.n_bytes = np.zeros(len(spec["model"]["vocab"]) + 1, np.int64)
        self.n_bytes[list(tokens.values())] = [len(t) for t in tokens]
        self.columns = UnitColumns(self.dtype, size, self._learn_words if self.drops_white else self._learn_ranked)

    def clear(self) -> None:
        self.columns.forget()

    def _learn_ranked(self, fresh: pa.Array) -> np.ndarray:
        """Units behind a blank, with flags of white space at their ends."""
        apart = pc.match_substring_regex(fresh, _APART)
        runs = pc.and_not(pc.match_substring_regex(fresh, _RUN), apart)
        odd, order = fresh.filter(apart), [_places(apart), _places(runs), _places(pc.invert(pc.or_(apart, runs)))]
        if len(odd):
            texts = odd.to_pylist()
            white = [(not u or u[0].isspace()) * _BEHIND + (not u or u[-1].isspace()) * _BEFORE for u in texts]
            self.columns.add_packed(odd, self._library([" " + u for u in texts]), np.asarray(white, np.int8))
        for ranked, at in ((self.ranked, order[1]), (self.ranked_plain, order[2])):
            if len(at):
                plain = fresh.take(pa.array(at))
                ids = np.asarray(ranked.encode_ordinary(" " + _joined(plain)), np.int64)
                ends = np.cumsum(pc.binary_length(plain).to_numpy() + 1)
                upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
                self.columns.add(plain, ids, np.diff(upto, prepend=0))
        return np.concatenate(order)

    def _learn_words(self, fresh: pa.Array) -> np.ndarray:
        """Units between white space."""
        apart = pc.match_substring_regex(fresh, _APART)
        odd, plain = fresh.filter(apart), fresh.filter(pc.invert(apart))
        if len(odd):
            self.columns.add_packed(odd, self._library(odd.to_pylist()))
        if len(plain):
            ids = np.asarray(self.ranked.encode_ordinary(_WORD_LEVEL.sub(_BEHIND_EACH, _joined(plain).lower() + " ")), np.int64)
            between = ids == self.blank
            upto = np.flatnonzero(between)
            self.columns.add(plain, ids[~between], np.diff(upto - np.arange(len(upto)), prepend=0))
        return np.concatenate([_places(apart), _places(pc.invert(apart))])

    def _ranked_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special strings, by ranks."""
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        item = self.columns.items(cut.values)
        first = cut.offsets.to_numpy().astype(np.int64)
        # a text with a blank that has white space before it, and white space or the end behind it, goes to the library;
        # an empty first unit has nothing before it
        white = self.columns.flags[item]
        before = (white & _BEFORE) != 0
        before[first[:-1]] &= np.fromiter((not t.startswith(" ") for t in texts), bool, len(texts))
        inside = np.flatnonzero(before[:-1] & ((white[1:] & _BEHIND) != 0))
        of = np.searchsorted(first, inside, side="right") - 1
        whole = np.unique(of[inside + 1 < first[of + 1]]).tolist()
        # a text's first unit has no blank before it
        heads = self._library([t.split(" ", 1)[0] for t in texts])
        item[first[:-1]] = len(self.columns.n_ids)
        out = [head + ids for head, ids in zip(heads, self.columns.texts(item, first))]
        for k, ids in zip(whole, self._library([texts[k] for k in whole])):
            out[k] = ids
        return out

    def _word_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special strings and separators, for vocabularies that drop white space."""
        if not texts:
            return []
        # these two letters' lower case depends on more than the character; all others' is as the library's
        lower = [t if "Σ" in t or "İ" in t else t.lower() for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(lower, pa.string()))
        item = self.columns.items(cut.values)
        return self.columns.texts(item, cut.offsets.to_numpy().astype(np.int64))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Packed ids of each text, followed by ``end``."""
        by_units = None if self.ranked is None else self._word_texts if self.drops_white else self._ranked_texts
        whole = [by_units is None or any(s in t for s in self.specials) or (self.drops_white and _SEPARATORS.search(t) is not None) for t in texts]
        by_library = iter(self._library([t for t, w in zip(texts, whole) if w]))
        by_table = iter(by_units([t for t, w in zip(texts, whole) if not w]) if by_units else [])
        return [next(by_library if w else by_table) + end for w in whole]


def id_table(path: str, dtype: str = "<u4", size: int = 500_000) -> IdTable:
    """The worker's table for a vocabulary; it outlives tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, dtype) not in _tables:
        _tables[path, dtype] = IdTable(path, dtype)
    _tables[path, dtype].size = _tables[path, dtype].columns.size = size
    return _tables[path, dtype]


def forget_table(path: str, dtype: str = "<u4") -> None:
    _tables.pop((path, dtype), None)
