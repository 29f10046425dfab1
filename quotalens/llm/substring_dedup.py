"""Repeated word windows, found by difference-cover anchors.

Positions whose number modulo 13 lies in {0, 1, 3, 9} form a difference cover: for any two positions
some shift below 13 moves both onto it.  Two equal windows of 35 words hence share an anchor of 23
words that begins on the cover in both.  Only anchors are hashed and counted over the corpus; each
window that holds a repeated anchor is then extended to its full length and counted itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotalens.llm import chunks
from quotalens.llm.hashing import Prefix, text_bytes, unique_names, word_names, word_spans

WINDOW = 35
#: A perfect difference set.
PERIOD, COVER = 13, (0, 1, 3, 9)


class _Words:
    """The words of a chunk: spans, numbers within the text and hashes of stretches."""

    def __init__(self, rows: pa.Table, window: int):
        self.data, self.at = text_bytes(rows["text"])
        self.begin, self.end, self.first = word_spans(self.data, self.at)
        self.prefix = Prefix(word_names(self.data, self.begin, self.end))
        counts = np.diff(self.first)
        self.number = np.arange(len(self.begin)) - np.repeat(self.first[:-1], counts)
        self.left = np.repeat(counts, counts) - self.number
        anchor = window - PERIOD + 1
        self.anchors = np.flatnonzero(np.isin(self.number % PERIOD, COVER) & (self.left >= anchor))
        self.anchor_names = self.prefix.names(self.anchors, anchor)

    def candidates(self, repeated: np.ndarray, window: int) -> np.ndarray:
        """Starts of windows that hold one of the repeated anchors at a shift below the period."""
        hit = np.zeros(len(self.begin) + PERIOD + 1, np.int32)
        hit[self.anchors[repeated] + 1] = 1
        hits = np.cumsum(hit)
        n = len(self.begin)
        return np.flatnonzero((hits[PERIOD : PERIOD + n] > hits[:n]) & (self.left >= window))


def substring_dedup(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Drop every word covered by a window of words that also starts elsewhere in the corpus.

    ``docs`` needs doc_id and text; other columns are ignored unless named in ``carry``, which returns
    them in the struct ``rest``.  Returns per row doc_id, text (kept words joined by one space), n_words
    and n_removed.  Words are runs without ASCII white space, compared as they are.  A null or empty
    text has no words and gives an empty text.  Texts shorter than the window are never cut.  Repeated
    rows are copies of each other: their windows repeat.  A null doc_id stays null.  An empty table
    gives an empty table.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    dealt, ranges = chunks.chunked(docs, carry)

    def ask(chunk: int, rows: pa.Table) -> pa.Table:
        names, _, counts = unique_names(_Words(rows, window).anchor_names)
        return chunks.asked(chunk, names, counts, ranges, b"")

    def extend(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
        words = _Words(rows, window)
        kinds, _ = chunks.read_answer(back, ranges)
        starts = words.candidates(kinds[unique_names(words.anchor_names)[1]] > 0, window)
        names, _, counts = unique_names(words.prefix.names(starts, window))
        marks = np.zeros(len(words.begin), bool)
        marks[starts] = True
        return chunks.asked(chunk, names, counts, ranges, np.packbits(marks).tobytes())

    fields = "doc_id long, text string, n_words long, n_removed long"
    if carry:
        fields += ", rest " + dict(dealt.dtypes)["rest"]

    def cut(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
        data, at = text_bytes(rows["text"])
        begin, end, first = word_spans(data, at)
        kinds, state = chunks.read_answer(back, ranges)
        gone = np.zeros(len(begin) + 1, np.int64)
        if state:
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(state, np.uint8))[: len(begin)])
            names = Prefix(word_names(data, begin, end)).names(starts, window)
            starts = starts[kinds[unique_names(names)[1]] > 0]
            gone[starts] += 1
            np.add.at(gone, starts + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(covered)])
        n_removed = lost[first[1:]] - lost[first[:-1]]
        raw = data.tobytes()
        texts = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            words = raw[a:b].split()
            if n_removed[i]:
                words = [w for w, out in zip(words, covered[first[i] : first[i + 1]]) if not out]
            texts.append(b" ".join(words))
        out = {"doc_id": rows["doc_id"], "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(n_removed)}
        return pa.table(out | ({"rest": rows["rest"]} if carry else {}))

    anchors = chunks.answered(chunks.first_pass(dealt, ask), ranges)
    windows = chunks.answered(chunks.next_pass(dealt, anchors, extend, chunks.ROWS), ranges)
    return chunks.next_pass(dealt, windows, cut, fields)
