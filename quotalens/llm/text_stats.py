"""Counts per text, vectorised over slices of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotalens.llm.hashing import Prefix, SPACE, byte_prefix, mix, slices, stretch_names, text_bytes, word_spans

SLICE_BYTES = 2 << 20
COUNTS = (
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_same_as_before", "n_upper", "n_digits", "n_marks", "n_stops", "n_pipes",
)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGITS, _MARKS, _STOPS, _PIPES = (_table(c) for c in (bytes(range(65, 91)), b"0123456789", b"!?", b".,;:", b"|"))


def _per_text(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[at[1:]] - total[at[:-1]]


def _first_seen(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for the first of equal names of an owner, in order."""
    keys = mix(names + mix(owner.astype(np.uint64) + np.uint64(1)))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def counts_of(data: np.ndarray, at: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    n_texts = len(at) - 1
    begin, end, first = word_spans(data, at)
    letters = byte_prefix(data)
    words = stretch_names(data, begin, end, letters)
    owner = np.repeat(np.arange(n_texts), np.diff(first))
    out = {"n_bytes": np.diff(at), "n_words": np.diff(first)}
    out["word_chars"] = _per_text(((data & 0xC0) != 0x80) & ~SPACE[data], at)
    out["n_symbols"] = _per_text(SYMBOLS[data], at)

    # lines: cut at \n; a text of no bytes is one empty line
    breaks = np.flatnonzero(data == 10)
    line_begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, at[1:]]))
    line_owner = np.repeat(np.arange(n_texts), _per_text(data == 10, at) + 1)
    with_word = np.searchsorted(begin, line_end) > np.searchsorted(begin, line_begin)
    line_begin, line_end, line_owner = line_begin[with_word], line_end[with_word], line_owner[with_word]
    new = _first_seen(stretch_names(data, line_begin, line_end, letters), line_owner)
    out["n_lines"] = np.bincount(line_owner, minlength=n_texts)
    out["n_dup_lines"] = np.bincount(line_owner[~new], minlength=n_texts)

    number = np.arange(len(begin)) - np.repeat(first[:-1], np.diff(first))
    starts = np.flatnonzero(np.repeat(np.diff(first), np.diff(first)) - number >= window)
    keys = mix(Prefix(words).names(starts, window) + mix(owner[starts].astype(np.uint64) + np.uint64(1)))
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = starts[times[place] > 1] if len(starts) else starts
    cover = np.zeros(len(begin) + 1, np.int64)
    cover[twice] += 1
    np.add.at(cover, twice + window, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, first)

    out["n_distinct_words"] = np.bincount(owner[_first_seen(words, owner)], minlength=n_texts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_as_before"] = np.bincount(owner[same], minlength=n_texts)
    for name, table in (("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_marks", _MARKS), ("n_stops", _STOPS), ("n_pipes", _PIPES)):
        out[name] = _per_text(table[data], at)
    return {k: v.astype(np.int64) for k, v in out.items()}


def text_stats(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` with the COUNTS of column text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for low, high in slices(at, SLICE_BYTES):
                counts = counts_of(data[at[low] : at[high]], at[low : high + 1] - at[low])
                kept = [batch.column(i).slice(low, high - low) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(counts[c]) for c in COUNTS)], names=[*(f"key_{i}" for i in range(len(keys))), *COUNTS])

    # columns by position: a key may be named like a count
    texts = docs.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([f"{name} {kind}" for name, kind in texts.dtypes if name != "text"] + [f"{c} long" for c in COUNTS])
    return texts.mapInArrow(run, schema)
