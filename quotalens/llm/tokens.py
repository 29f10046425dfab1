"""Token ids of many texts through the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from quotalens.llm.hashing import LOWER, SPACE, slices, stretch_names, text_bytes, unique_names

#: A slice's index arrays take some 25 times its bytes, in each worker of an executor.
SLICE_BYTES = 3 << 18
#: Words that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts unit by unit.

    ``words`` units are runs without white space (for vocabularies that drop white space and fold case).
    Otherwise a unit is such a run with one space before it, and white space is cut as a byte-level
    pattern cuts it.  A text with white space beyond ASCII is one unit, as runs of it may join.

    ``special``: a special token's literal in a text gets the token's id, as the library does unless told
    otherwise; else it is text like any other.  A text with such a literal is one unit and keeps its case,
    as these tokens are matched before the rest is normalised and cut.

    ``slice_bytes`` and ``remembered`` trade a worker's memory for time, never for ids.
    """

    _made: dict[tuple, "Encoder"] = {}

    def __init__(self, path: str, words: bool, special: bool = False, slice_bytes: int = SLICE_BYTES, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else []
        self.literals = [LOWER[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in added]
        #: What each literal begins with in any case.
        self.marks = {re.match(rb"[^a-z]*", literal)[0] for literal in self.literals}
        self.words, self.slice_bytes, self.remembered = words, slice_bytes, remembered
        self.forget()

    @classmethod
    def of(cls, path: str, words: bool, special: bool = False, slice_bytes: int = SLICE_BYTES, remembered: int = REMEMBERED) -> "Encoder":
        key = (path, words, special, slice_bytes, remembered)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def forget(self):
        self.known, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # names in order, and the row of each
        self.size = np.zeros(1 << 16, np.int32)
        self.place = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def units(self, data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        space = SPACE[data]
        first, last = cut[:-1].copy(), cut[1:].copy()
        first[1:] |= space[1:] != space[:-1]  # a run of either kind begins
        last[:-1] |= space[1:] != space[:-1]
        if self.words:
            begin, end = first & ~space, last & ~space
        else:
            joins = np.zeros(n, bool)  # the last space of a run, before a word
            joins[:-1] = space[:-1] & ~space[1:] & ~cut[1:-1]
            begin = first | joins
            spaced = np.zeros(n, bool)
            spaced[1:] = joins[:-1] & (data[:-1] == 0x20)
            begin &= ~spaced
            end = np.zeros(n, bool)
            end[:-1] = begin[1:]
            end |= cut[1:]
        odd = np.union1d(self.odd_texts(data, at), whole)
        if len(odd):
            inside = self.inside(odd, at)
            begin, end = np.where(inside, cut[:-1], begin), np.where(inside, cut[1:], end)
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @staticmethod
    def inside(texts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a byte belongs to one of these texts."""
        hit = np.zeros(len(at) - 1, bool)
        hit[texts] = True
        return np.repeat(hit, np.diff(at))

    def special_texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold a special token's literal in any case."""
        found, raw = [], data.tobytes() if self.literals else b""
        if not any(mark in raw for mark in self.marks):
            return np.zeros(0, np.int64)
        raw = LOWER[data].tobytes()
        for literal in self.literals:
            place = raw.find(literal)
            while place >= 0:
                found.append(place)
                place = raw.find(literal, place + 1)
        return np.unique(np.searchsorted(at, np.array(found, np.int64), "right") - 1)

    @staticmethod
    def odd_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold white space beyond ASCII."""
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = wide[lead], wide[lead + 1], wide[lead + 2]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        return np.unique(np.searchsorted(at, lead[hit], "right") - 1)

    def learn(self, names: np.ndarray, texts: list[str]):
        """Encode units whose names, in order, are not known."""
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum()))
        low = len(self.known)
        while low + len(out) > len(self.size):
            self.size, self.place = np.concatenate([self.size, np.zeros_like(self.size)]), np.concatenate([self.place, np.zeros_like(self.place)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[low : low + len(out)] = sizes
        self.place[low : low + len(out)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        place = np.searchsorted(self.known, names)
        self.known, self.rows = np.insert(self.known, place, names), np.insert(self.rows, place, np.arange(low, low + len(out), dtype=np.int32))

    def encode_slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more at the end)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        whole = self.special_texts(data, at)
        if self.words:
            data = np.where(self.inside(whole, at), data, LOWER[data]) if len(whole) else LOWER[data]
        begin, end = self.units(data, at, whole)
        names, place, _ = unique_names(stretch_names(data, begin, end))
        if len(self.known) + len(names) > self.remembered:
            self.forget()
        some = np.zeros(len(names), np.int64)
        some[place] = np.arange(len(place))
        row = np.full(len(names), -1, np.int64)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
            row = np.where(self.known[near] == names, self.rows[near], row)
        new = np.flatnonzero(row < 0)
        if len(new):
            raw, rows = data.tobytes(), some[new]
            row[new] = len(self.known) + np.arange(len(new))
            self.learn(names[new], [raw[a:b].decode() for a, b in zip(begin[rows].tolist(), end[rows].tolist())])
        row = row[place]
        sizes = self.size[row].astype(np.int64)
        to = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.place[row] - to[:-1], sizes) + np.arange(to[-1])]
        return ids, to[np.searchsorted(begin, at)]

    def encode(self, column):
        """(first row, ids, begins) for slices of an Arrow string column."""
        data, at = text_bytes(column)
        for low, high in slices(at, self.slice_bytes):
            ids, begins = self.encode_slice(data[at[low] : at[high]], at[low : high + 1] - at[low])
            yield low, ids, begins
