"""Repeated byte strings, found by prefix doubling over position ranks.

Sorting a rank pair for every byte would move far more data than the corpus holds.  So the positions
that are ranked are chosen by content (the hash of the next 8 bytes, about one in 16): equal strings
choose equal places.  A rank is the 64-bit name of the string of length h at its position, so the
rank at offset h needs no join.  Each round names the surviving positions at twice the length, Spark
deals the names to sorted ranges, and positions whose name is unique drop out: 40, 80, 160 bytes, the
last beside the full threshold.  What is left is settled for each start byte: whole gaps between two
ranked positions at once where the string over all their windows repeats, single windows elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotalens.llm import chunks
from quotalens.llm.hashing import byte_prefix, mix, text_bytes, unique_names

LENGTH = 200
GRAM, ONE_IN = 8, 16
#: While positions are only pruned, 48 bits of a name do: a false repeat costs work, not a wrong byte.
PRUNING = np.uint64(0xFFFFFFFFFFFF0000)


class _Bytes:
    """The bytes of a chunk, its ranked positions, and names of stretches."""

    def __init__(self, rows: pa.Table):
        self.data, self.at = text_bytes(rows["text"])
        n = len(self.data)
        self.prefix = byte_prefix(self.data)
        sums, down = self.prefix.sums, self.prefix.down
        if n >= GRAM:
            grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
            spots = np.flatnonzero((grams >> np.uint64(40)) % np.uint64(ONE_IN) == 0)
        else:
            spots = np.zeros(0, np.int64)
        doc = np.searchsorted(self.at, spots, "right") - 1
        stop = self.at[doc + 1]
        inside = spots + GRAM <= stop
        self.spots, self.doc, self.stop = spots[inside], doc[inside], stop[inside]
        self.before = np.full(len(self.spots), -1)  # the ranked position before, in the same text
        if len(self.spots) > 1:
            same = self.doc[1:] == self.doc[:-1]
            self.before[1:][same] = self.spots[:-1][same]

    def level_names(self, level: np.ndarray, needed: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that reached a level and have room for h bytes, and their names."""
        who = np.flatnonzero((level >= needed) & (self.spots + h <= self.stop))
        return who, self.prefix.names(self.spots[who], h) & PRUNING

    def hulls(self, level: np.ndarray, needed: int, length: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose whole gap can be settled at once, and the names of the string over all its windows."""
        who = np.flatnonzero((level >= needed) & (self.before >= 0) & (self.spots - self.before <= gap) & (self.spots + length <= self.stop))
        size = self.spots[who] - self.before[who] + length
        return who, mix(self.prefix.names(self.before[who], size) + size.astype(np.uint64))

    def open_windows(self, level: np.ndarray, whole: np.ndarray, steps: tuple[int, ...], length: int) -> np.ndarray:
        """Starts of the windows that may repeat and are not settled by their gap."""
        n = len(self.data)
        sizes = np.diff(self.at)
        start = np.arange(n)
        fits = start + length <= np.repeat(self.at[1:], sizes)
        if not len(self.spots):
            return start[fits]
        k = np.minimum(np.searchsorted(self.spots, start), len(self.spots) - 1)
        d = self.spots[k] - start
        anchored = (d >= 0) & (d + GRAM <= length)
        reach = np.zeros(n, np.int8)  # the level that a window's first ranked position must have reached
        for i, h in enumerate(steps):
            reach[d + h <= length] = i + 1
        return start[fits & (~anchored | ((level[k] >= reach) & ~(whole[k] & (start > self.before[k]))))]


def _steps(length: int) -> tuple[int, int, int]:
    return length // 5, 2 * length // 5, 4 * length // 5


def suffix_dedup(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Cut every byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus.

    ``docs`` needs doc_id and text; other columns are ignored unless named in ``carry``, which returns
    them in the struct ``rest``.  Returns per row doc_id, kept (binary: the remaining bytes of the UTF-8
    text, which may split a character; with ``as_text`` a string without such split characters), n_bytes, n_removed and n_spans (maximal removed runs).  Null and
    empty texts give empty bytes; texts shorter than ``length`` are never cut.  Repeated rows are copies
    of each other.  A null doc_id stays null.  An empty table gives an empty table.
    """
    if length < 40:
        raise ValueError("length must be at least 40 bytes")
    dealt, ranges = chunks.chunked(docs, carry)
    steps = _steps(length)
    gap = length - steps[2]

    def ask(chunk: int, rows: pa.Table) -> pa.Table:
        text = _Bytes(rows)
        _, names = text.level_names(np.zeros(len(text.spots), np.uint8), 0, steps[0])
        names, _, counts = unique_names(names)
        return chunks.asked(chunk, names, counts, ranges, b"")

    def double(i: int):
        """Take in round i's answers and ask for the next length; the last round also asks for whole gaps."""

        def step(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
            text = _Bytes(rows)
            kinds, state = chunks.read_answer(back, ranges)
            level = np.frombuffer(state, np.uint8).copy() if state else np.zeros(len(text.spots), np.uint8)
            who, names = text.level_names(level, i, steps[i])
            level[who] = np.where(kinds[unique_names(names)[1]] > 0, i + 1, level[who])
            who, names = text.level_names(level, i + 1, steps[i + 1])
            if i + 2 == len(steps):
                names = np.concatenate([names, text.hulls(level, i + 1, length, gap)[1]])
            names, _, counts = unique_names(names)
            return chunks.asked(chunk, names, counts, ranges, level.tobytes())

        return step

    def settle(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
        """Take in the last round and ask for the windows that are still open."""
        text = _Bytes(rows)
        kinds, state = chunks.read_answer(back, ranges)
        level = np.frombuffer(state, np.uint8).copy()
        last = len(steps) - 1
        who, names = text.level_names(level, last, steps[last])
        gaps, hulls = text.hulls(level, last, length, gap)
        place = unique_names(np.concatenate([names, hulls]))[1]
        twice = kinds[place] > 0
        level[who] = np.where(twice[: len(who)], last + 1, level[who])
        whole = np.zeros(len(level), bool)
        whole[gaps[twice[len(who) :]]] = True
        of_hull = place[len(who) :]
        one = np.unique(of_hull, return_index=True)[1]
        one = gaps[one[kinds[of_hull[one]] >= chunks.FIRST]]
        # an open window may equal one inside a settled gap: one copy of each settled gap also asks for its windows
        shown = np.zeros(len(text.data) + 1, np.int32)
        np.add.at(shown, text.before[one] + 1, 1)
        np.add.at(shown, text.spots[one] + 1, -1)
        shown = np.cumsum(shown)[:-1] > 0
        shown[text.open_windows(level, whole, steps, length)] = True
        starts = np.flatnonzero(shown)
        names, _, counts = unique_names(text.prefix.names(starts, length))
        full = np.zeros(len(text.data) + 1, np.int32)
        np.add.at(full, text.before[whole] + 1, 1)
        np.add.at(full, text.spots[whole] + 1, -1)
        return chunks.asked(chunk, names, counts, ranges, np.packbits(shown).tobytes() + np.packbits(np.cumsum(full)[:-1] > 0).tobytes())

    fields = f"doc_id long, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"
    if carry:
        fields += ", rest " + dict(dealt.dtypes)["rest"]

    def cut(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
        data, at = text_bytes(rows["text"])
        n = len(data)
        kinds, state = chunks.read_answer(back, ranges)
        half = len(state) // 2
        marks, full = (np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x in (state[:half], state[half:]))
        starts = np.flatnonzero(marks)
        repeated = full.copy()
        if len(starts):
            repeated[starts[kinds[unique_names(byte_prefix(data).names(starts, length))[1]] > 0]] = True
        gone = np.zeros(n + 1, np.int32)
        gone[:n] = repeated
        ends = np.flatnonzero(repeated) + length
        gone[ends] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(covered)])
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        opens[at[:-1][at[:-1] < n]] |= covered[at[:-1][at[:-1] < n]]
        spans = np.concatenate([[0], np.cumsum(opens)])
        keep = data[~covered]
        kept_at = at - lost[at]
        raw = keep.tobytes()
        out = {
            "doc_id": rows["doc_id"],
            "kept": pa.array([raw[a:b].decode(errors="ignore") if as_text else raw[a:b] for a, b in zip(kept_at, kept_at[1:])], pa.string() if as_text else pa.binary()),
            "n_bytes": pa.array(np.diff(at)),
            "n_removed": pa.array(np.diff(lost[at])),
            "n_spans": pa.array(np.diff(spans[at])),
        }
        return pa.table(out | ({"rest": rows["rest"]} if carry else {}))

    answers = chunks.answered(chunks.first_pass(dealt, ask), ranges)
    for i in range(len(steps) - 1):
        answers = chunks.answered(chunks.next_pass(dealt, answers, double(i), chunks.ROWS), ranges)
    answers = chunks.answered(chunks.next_pass(dealt, answers, settle, chunks.ROWS), ranges)
    return chunks.next_pass(dealt, answers, cut, fields)
