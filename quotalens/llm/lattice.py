"""Sampled segmentations over the lattice of SentencePiece pieces, and their lossless decoding.

Forward filtering sums the weights of all segmentations up to each byte of a unit; backward sampling then
draws a piece at a time from the end, each with its exact share.  A unit is a run of spaces with the
text up to the next run: no piece holds a space behind another character, so none crosses a cut.  Equal
units of a slice share one lattice, and all their occurrences are drawn together.

The vocabulary is a merge table: its scores are ranks, not probabilities.  A piece of rank r weighs
1 / (r + 1) to the power of ``smoothing``, Zipf's law for a vocabulary in order of frequency.  Characters
without a piece fall back to byte pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotalens.llm.hashing import byte_prefix, mix, slices, stretch_names, text_bytes, unique_names
from quotalens.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
SPACE_MARK = "▁"
BYTE_RANK = 1 << 20
#: Shares are whole numbers of so many bits; the rest of 64 holds a place in a slice.
SHARE_BITS = 36


class Pieces:
    """Pieces of a model as bytes, with a space for the space mark, and prefix tables for matching."""

    _made: dict[str, "Pieces"] = {}

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        n = sp.get_piece_size()
        self.text, self.byte_id = [b""] * n, np.full(256, -1)
        found: dict[bytes, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.replace(SPACE_MARK, " ").encode()
                if b" " in self.text[i].lstrip(b" "):
                    raise ValueError(f"piece {i} holds a space behind another character")
                found[self.text[i]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        first = min(found.values())
        self.log_weight = -np.log(np.maximum(np.arange(n) - first, 0) + 1.0)
        self.log_weight[self.byte_id] = -np.log(float(BYTE_RANK))
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.place = np.cumsum(self.sizes) - self.sizes
        #: For each length: sorted hashes of the prefixes of pieces, the piece that ends there or -1, and where hashes of the same first bits begin.
        by_length: dict[int, dict[bytes, int]] = {}
        for t in found:
            for k in range(1, len(t) + 1):
                by_length.setdefault(k, {}).setdefault(t[:k], found.get(t[:k], -1))
        self.tables = []
        for k in range(1, max(by_length) + 1):
            rows = list(by_length[k])
            raw = np.frombuffer(b"".join(rows), np.uint8)
            names = byte_prefix(raw).names(np.arange(len(rows)) * k, k)
            order = np.argsort(names)
            names, whole = names[order], np.array([by_length[k][r] for r in rows])[order]
            bits = len(names).bit_length() + 2
            heads = np.searchsorted(names >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
            self.tables.append((np.append(names, ~np.uint64(0)), np.append(whole, -1), heads, np.uint64(64 - bits)))

    @classmethod
    def of(cls, model: str) -> "Pieces":
        if model not in cls._made:
            cls._made[model] = cls(model)
        return cls._made[model]

    def edges(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that match inside units end to end: (from, to, piece)."""
        n = len(data)
        stop = np.repeat(end, end - begin)
        prefix, at = byte_prefix(data), np.arange(n)
        froms, tos, pieces = [], [], []
        single = np.zeros(n, bool)  # characters with a piece of their own
        width = np.ones(n, np.int64)
        for low, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            width[data >= low] = size
        for k, (names, piece, heads, shift) in enumerate(self.tables, 1):
            at = at[at + k <= stop[at]]
            if not len(at):
                break
            own = prefix.names(at, k)
            i = heads[own >> shift]
            found = names[i]
            behind = np.flatnonzero(found < own)
            while len(behind):
                i[behind] += 1
                found[behind] = names[i[behind]]
                behind = behind[found[behind] < own[behind]]
            alive = np.flatnonzero(found == own)
            at, i = at[alive], i[alive]
            whole = piece[i] >= 0
            froms.append(at[whole]), tos.append(at[whole] + k), pieces.append(piece[i[whole]])
            single[at[whole & (width[at] == k)]] = True
        lead = (data & 0xC0) != 0x80
        bare = ~single[np.maximum.accumulate(np.where(lead, np.arange(n), 0))]
        at = np.flatnonzero(bare)
        froms.append(at), tos.append(at + 1), pieces.append(self.byte_id[data[at]])
        return np.concatenate(froms), np.concatenate(tos), np.concatenate(pieces)


def _units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin: at a text, and at a space behind something else."""
    begin = np.zeros(len(data), bool)
    begin[at[:-1][at[:-1] < len(data)]] = True
    space = data == 0x20
    begin[1:] |= space[1:] & ~space[:-1]
    return np.flatnonzero(begin)


def _forward(frm: np.ndarray, to: np.ndarray, weight: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges in order of their end, with the share of each among those of its end, cumulated; and where each end's edges begin."""
    order = np.argsort((to << 32) | frm)  # no two pieces share both ends
    frm, to, weight = frm[order], to[order], weight[order]
    n = int(sizes.sum())
    first = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n + 1))])
    total = np.full(n + 1, -np.inf)
    is_begin = np.zeros(n + 1, bool)
    is_begin[begin] = True
    # ends at the same distance from their unit's begin are filtered together, so their edges are laid side by side
    longest = int(sizes.max(initial=0))
    offset = (np.arange(n) - np.repeat(begin, sizes) + 1).astype(np.uint16 if longest < 1 << 16 else np.int64)[to - 1]
    by_offset = np.argsort(offset, kind="stable")
    source, end, value_of = frm[by_offset], to[by_offset], weight[by_offset]
    starts = is_begin[source]
    heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(offset, minlength=longest + 1)[1:])])
    head_cuts = np.searchsorted(heads, cuts)
    laid = np.empty(len(to))
    for a, b, c, d in zip(cuts[:-1], cuts[1:], head_cuts[:-1], head_cuts[1:]):
        if a == b:
            continue
        own = heads[c:d]
        ends, counts = end[own], np.diff(own, append=b)
        value = np.where(starts[a:b], 0.0, total[source[a:b]]) + value_of[a:b]
        top = np.maximum.reduceat(value, own - a)
        reached = np.isfinite(top)
        scaled = np.exp(value - np.repeat(np.where(reached, top, 0.0), counts))
        mass = np.add.reduceat(scaled, own - a)
        # an end that is the next unit's begin keeps its own sum in share alone
        total[ends] = np.where(reached, top + np.log(np.maximum(mass, 1e-300)), -np.inf)
        laid[a:b] = scaled / np.repeat(np.where(mass > 0, mass, 1.0), counts)
    share = np.empty(len(to))
    share[by_offset] = laid
    # whole numbers: what comes before an end cannot change the last bits of its shares
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((share * (1 << SHARE_BITS)).astype(np.uint64))])
    return frm, to, running[1:] - np.repeat(running[first[:-1]], np.diff(first))[: len(to)], first, order


def _draw(rows: np.ndarray, ordinal: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers of SHARE_BITS bits that depend on the row's key, the unit's number in its text and the step alone."""
    x = mix(rows ^ mix(ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)))
    return x >> np.uint64(64 - SHARE_BITS)


class Sampler:
    """Draws segmentations of slices of texts."""

    def __init__(self, model: str, smoothing: float, seed: int):
        self.pieces, self.smoothing, self.seed = Pieces.of(model), smoothing, np.uint64(seed)

    def slice(self, data: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts end to end, and where each text's pieces begin (one more at the end)."""
        texts = np.diff(at)
        # a space before each text that is not empty
        full = texts > 0
        shift = np.cumsum(full)
        spaced = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(shift, texts)] = data
        at = at + np.concatenate([[0], shift])
        begin = _units(spaced, at)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(spaced))
        names, kind, _ = unique_names(stretch_names(spaced, begin, end))
        one = np.zeros(len(names), np.int64)
        one[kind] = np.arange(len(kind))
        sizes = (end - begin)[one]
        heads = np.cumsum(sizes) - sizes
        flat = spaced[np.repeat(begin[one] - heads, sizes) + np.arange(sizes.sum())]
        frm, to, piece = self.pieces.edges(flat, heads, heads + sizes)
        frm, to, share, first, order = _forward(frm, to, self.smoothing * self.pieces.log_weight[piece], heads, sizes)
        piece = piece[order]

        before = np.searchsorted(begin, at)
        owner = np.repeat(np.arange(len(texts)), np.diff(before))
        ordinal = np.arange(len(begin)) - before[owner]
        by_kind = np.argsort(kind)  # equal units side by side, as they look up the same shares
        rows, ordinal = mix(keys[owner].view(np.uint64) ^ self.seed)[by_kind], ordinal[by_kind]
        low = heads[kind[by_kind]]
        stop, active, drawn = low + sizes[kind[by_kind]], np.arange(len(begin)), []
        key = (to.astype(np.uint64) << np.uint64(SHARE_BITS)) + share  # the end's number, and the cumulated share behind it
        last = first[1:][np.diff(first) > 0] - 1
        key[last] = (to[last] + 1).astype(np.uint64) << np.uint64(SHARE_BITS)  # an end's last edge takes what rounding left
        while len(active):
            u = _draw(rows, ordinal, len(drawn))
            e = np.searchsorted(key, (stop.astype(np.uint64) << np.uint64(SHARE_BITS)) + u, "right")
            drawn.append((active, piece[e]))
            stop = frm[e]
            more = np.flatnonzero(stop > low)
            active, stop, low, rows, ordinal = active[more], stop[more], low[more], rows[more], ordinal[more]
        steps = np.zeros(len(begin), np.int64)
        for who, _ in drawn:
            steps[who] += 1
        counts = np.empty_like(steps)
        counts[by_kind] = steps
        ends = np.cumsum(counts)
        out, final = np.empty(int(ends[-1]), np.int32), ends[by_kind] - 1
        for step, (who, ids) in enumerate(drawn):
            out[final[who] - step] = ids
        return out, np.concatenate([[0], ends])[before]


def sampled_pieces(docs: DataFrame, model: str = MODEL, smoothing: float = 1.0, seed: int = 0) -> DataFrame:
    """Draw one segmentation of each text: doc_id, ids (array of piece ids).

    ``docs`` needs doc_id and text; other columns are ignored.  Draws depend on ``seed``, doc_id and the
    text alone, so equal rows get equal segmentations; a null doc_id draws as id 0.  Null and empty
    texts have no pieces.  An empty table gives an empty table.
    """

    def run(batches):
        sampler = Sampler(model, smoothing, seed)
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = text_bytes(batch.column("text"))
            for low, high in slices(at, SLICE_BYTES):
                ids, begins = sampler.slice(data[at[low] : at[high]], at[low : high + 1] - at[low], keys[low:high])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(pieces: DataFrame, model: str = MODEL) -> DataFrame:
    """Texts of piece ids: doc_id, text, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    ``pieces`` needs doc_id and ids; null ids give an empty text.
    """

    def run(batches):
        own = Pieces.of(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts, sizes, crcs = [], [], []
                for ids in part.column("ids"):
                    row = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                    k = own.sizes[row]
                    raw = own.flat[np.repeat(own.place[row] - (np.cumsum(k) - k), k) + np.arange(k.sum())].tobytes()
                    texts.append(raw[1:])
                    sizes.append(len(row))
                    crcs.append(zlib.crc32(row.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "text", "n_pieces", "ids_crc32"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string, n_pieces long, ids_crc32 long")
