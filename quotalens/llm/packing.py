"""Pack documents into sequences of a fixed number of tokens by exact complements, then best fit.

Only the histogram of piece lengths, at most one row per length, reaches the driver.  There the plan is
made: which lengths lie together, and how often.  The pieces of one length are numbered across the
corpus in buckets, and each piece finds its place in the plan by its length and number.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quotalens.llm.store import saved
from quotalens.llm.tokens import Encoder

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
BUCKET_ROWS = 20_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False, special: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each text with its end id: doc_id, piece, start, length, ids_crc32[, ids]."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    shape = pa.schema(fields)

    def run(batches):
        encoder = Encoder.of(vocabulary, words=True, special=special)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for low, ids, begins in encoder.encode(batch.column("text")):
                rows = []
                for i, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((keys[low + i], piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)


class _Stock:
    """Counts of lengths, and which sums of two available lengths exist."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.there = self.count > 0
        self.pairs = np.convolve(self.there.astype(np.int64), self.there.astype(np.int64))[: capacity + 1]

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use up this combination as often as it can be made."""
        need = Counter(lengths)
        times = min(int(self.count[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.count[x] -= k * times
                if not self.count[x]:
                    sums = x + np.flatnonzero(self.there)
                    np.subtract.at(self.pairs, sums[sums < len(self.pairs)], 2)
                    if 2 * x < len(self.pairs):
                        self.pairs[2 * x] += 1
                    self.there[x] = False
        return times

    def fillers(self, gap: int):
        """Singles, pairs and triples of available lengths that fill a gap exactly, the largest first."""
        if self.there[gap]:
            yield (gap,)
        if self.pairs[gap]:
            low = np.arange(1, gap // 2 + 1)
            for b in low[self.there[low] & self.there[gap - low]].tolist():
                yield gap - b, b
        a = np.arange(gap - 2, 0, -1)
        for first in a[self.there[a] & (self.pairs[gap - a] > 0)].tolist():
            rest = gap - first
            low = np.arange(max(1, rest - first), rest // 2 + 1)
            for c in low[self.there[low] & self.there[rest - low]].tolist():
                yield first, rest - c, c


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that lie together, how often).  Each step uses up a length or a kind of sequence, so the plan stays short."""
    stock, plan = _Stock(counts, capacity), []
    if stock.count[capacity]:
        plan.append(((capacity,), int(stock.count[capacity])))
        stock.take((capacity,))
    for length in range(capacity - 1, 0, -1):
        while stock.count[length]:
            for filler in stock.fillers(capacity - length):
                times = stock.take((length, *filler))
                if times:
                    plan.append(((length, *filler), times))
                    break
            else:
                break
    open_by_gap: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        left = int(stock.count[length])
        while left:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                per = capacity // length
                full, rest = divmod(left, per)
                for k, times in ((per, full), (rest, 1)):
                    if k and times:
                        open_by_gap.setdefault(capacity - k * length, []).append([(length,) * k, times])
                left = 0
                continue
            kinds = open_by_gap[gap]
            lengths, times = kinds.pop()
            used = min(left, times)
            if times > used:
                kinds.append([lengths, times - used])
            if not kinds:
                del open_by_gap[gap]
            open_by_gap.setdefault(gap - length, []).append([(*lengths, length), used])
            left -= used
    for kinds in open_by_gap.values():
        plan += [(lengths, times) for lengths, times in kinds]
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length, in order of the first piece number: where the pieces of that number go."""
    following, base, rows = Counter(), 0, []
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, following[length], base, offset))
            following[length] += times
            offset += length
        base += times
    rows.sort()
    return dict(zip(("length", "number", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """Place each piece of each document in a sequence of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored.  A text is encoded, ``end_id`` is
    appended, and only what is longer than a sequence is cut into full pieces and a rest.  Returns per
    piece doc_id, piece, start (in the document), length, ids_crc32, sequence_id and offset (in the
    sequence, without gaps).  Null and empty texts are the end id alone.  Repeated rows and equal
    lengths are separate pieces; which of them takes which place follows doc_id and piece.  ``special``
    gives literals of special tokens their ids.  A null doc_id stays null.  An empty table gives an empty table.
    """
    pieces = saved(token_pieces(docs, capacity, vocabulary, end_id, special=special), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    slots = slots_of(plan_sequences(histogram, capacity))

    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    )
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("local", local - 1).join(before, ["bucket", "length"]).withColumn("number", F.col("local") + F.col("before"))

    def place(batches):
        first = np.searchsorted(slots["length"], np.arange(capacity + 2))
        key = slots["length"] * (1 << 40) + slots["number"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy().astype(np.int64)
            at = np.searchsorted(key, length * (1 << 40) + number, "right") - 1
            assert ((at >= first[length]) & (at < first[length + 1])).all()
            sequence = slots["sequence"][at] + number - slots["number"][at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slots["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array), doc_ids (array, one per piece).  A group is one sequence."""
    ids = token_pieces(docs, capacity, vocabulary, end_id, with_ids=True, special=special).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    parts = placed.join(ids, (placed.doc_id.eqNullSafe(ids.doc_id)) & (placed.piece == ids.piece) & (placed.ids_crc32 == ids.ids_crc32)).select("sequence_id", "offset", placed.doc_id, "ids")
    rows = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))
