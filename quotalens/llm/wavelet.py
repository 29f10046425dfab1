"""Token ids of a corpus as wavelet matrices, one per shard, with access, counting and lookup.

A wavelet matrix holds a sequence as one bit plane per bit of the largest id, the highest first; below
each plane the sequence is split stably by that plane's bit.  Ones before every 512th bit are stored
beside the planes, so that rank needs one block and select a binary search.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quotalens.llm.store import saved
from quotalens.llm.tokens import Encoder

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
SHARD_TOKENS = 1 << 20
# A worker that writes shards has room for larger slices and more words than one beside other stages.
SLICE_BYTES, REMEMBERED = 1 << 21, 1_200_000
_HEAD = struct.Struct("<4sIQ")
_BLOCK = 512


class WaveletMatrix:
    """Planes over n ids."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.planes, self.ones = n, planes, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        row = ids.astype(np.uint32 if len(ids) and ids.max() > 0xFFFF else np.uint16)
        below = np.empty_like(row)
        planes, ones = [], []
        for bit in reversed(range(int(row.max()).bit_length() if len(row) else 0)):
            on = (row & row.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(on, bitorder="little"))
            ones.append(cls._directory(planes[-1]))
            zeros = len(row) - int(ones[-1][-1])
            np.compress(~on, row, out=below[:zeros])
            np.compress(on, row, out=below[zeros:])
            row, below = below, row
        return cls(len(ids), planes, ones)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        blocks = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
        blocks[: len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).reshape(-1, _BLOCK // 8).sum(1))]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(b"WVM1", len(self.planes), self.n)]
        for plane, ones in zip(self.planes, self.ones):
            parts += [plane.tobytes(), ones.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "WaveletMatrix":
        magic, depth, n = _HEAD.unpack_from(raw)
        if magic != b"WVM1":
            raise ValueError("not a wavelet matrix")
        size, blocks = -(-n // 8), -(-(-(-n // 8)) // (_BLOCK // 8)) + 1
        planes, ones, at = [], [], _HEAD.size
        for _ in range(depth):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            ones.append(np.frombuffer(raw, "<u4", blocks, at + size))
            at += size + 4 * blocks
        return cls(n, planes, ones)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before bit i of a plane."""
        block, plane = i // _BLOCK, self.planes[level]
        low, high = block * _BLOCK // 8, i // 8
        count = int(self.ones[level][block]) + int(np.bitwise_count(plane[low:high]).sum())
        return count + (int(plane[high]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else count

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ones[level][-1])

    def access(self, i: int) -> int:
        """The id at a place."""
        value = 0
        for level, plane in enumerate(self.planes):
            bit, rank = int(plane[i // 8]) >> i % 8 & 1, self._rank1(level, i)
            value = value << 1 | bit
            i = self._zeros(level) + rank if bit else i - rank
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (self._zeros(level) + a, self._zeros(level) + b) if token >> len(self.planes) - 1 - level & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often an id occurs before a place."""
        if token >> len(self.planes):
            return 0
        low, high = self._interval(token, i)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        i = self._interval(token, 0)[0] + k
        for level in reversed(range(len(self.planes))):
            if token >> len(self.planes) - 1 - level & 1:
                i = self._select(level, i - self._zeros(level), True)
            else:
                i = self._select(level, i, False)
        return i

    def _select(self, level: int, k: int, on: bool) -> int:
        low, high = 0, self.n - 1
        while low < high:  # the first bit with more than k such bits up to it
            middle = (low + high) // 2
            ones = self._rank1(level, middle + 1)
            if (ones if on else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for bit, plane in enumerate(reversed(self.planes)):
            on = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            above, zeros = np.empty_like(row), self.n - int(np.count_nonzero(on))
            above[~on] = row[:zeros]
            above[on] = row[zeros:] | kind(1 << bit)
            row = above
        return row.astype(np.uint32)


FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, special: bool = False) -> DataFrame:
    """Encode all texts in ascending doc_id order and write them as shards; returns the written table.

    ``docs`` needs doc_id and text.  A row is one shard: part and shard (their order is the order of the
    documents), n_tokens, doc_ids, sizes (ids of each document with its end id) and matrix, a
    WaveletMatrix in bytes.  A null or empty text is the end id alone; null doc_ids come first; repeated
    doc_ids keep a row each; a long text may make a shard larger than ``shard_tokens``; ``special`` gives
    literals of special tokens their ids.
    """

    def run(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(vocabulary, words=False, special=special, slice_bytes=SLICE_BYTES, remembered=REMEMBERED)
        keys, sizes, rows, held = [], [], [], 0

        def flush():
            row = [part, shard, held, keys, np.concatenate(sizes), WaveletMatrix.build(np.concatenate(rows)).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, FILES)], schema=FILES)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for low, ids, begins in encoder.encode(batch.column("text")):
                ids, count, done = np.insert(ids, begins[1:], np.uint32(end_id)), np.diff(begins) + 1, 0
                to = np.concatenate([[0], np.cumsum(count)])
                while done < len(count):  # up to the document that fills the shard
                    upto = min(len(count), int(np.searchsorted(to, to[done] + shard_tokens - held)))
                    keys += ids_of[low + done : low + upto]
                    sizes.append(count[done:upto])
                    rows.append(ids[to[done] : to[upto]])
                    held += int(to[upto] - to[done])
                    done = upto
                    if held >= shard_tokens:
                        yield flush()
                        shard += 1
                        keys, sizes, rows, held = [], [], [], 0
        if keys:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one id, null too, are told apart by a hash, so that many of them do not meet in one range
    dealt = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return saved(dealt.mapInArrow(run, "part int, shard int, n_tokens long, doc_ids array<long>, sizes array<long>, matrix binary"), "wavelet", "zstd")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): ids in all shards before.  One task sees one row per part, never one per document."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    own = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("own_before"))
    return own.join(parts, "part").select("part", "shard", (F.col("own_before") + F.col("parts_before")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents decoded from their shards: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["matrix"]).decode().astype("<u4")
                to = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(to[:-1], to[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(to[:-1]), pa.array(np.diff(to)), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "shard", "doc_ids", "sizes", "matrix").mapInArrow(run, "part int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """How often an id occurs in each shard, by rank: part, shard, n."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [WaveletMatrix.from_bytes(r["matrix"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("shard"), pa.array([m.rank(token, m.n) for m in found], pa.int64())], names=["part", "shard", "n"])

    return shards.select("part", "shard", "matrix").mapInArrow(run, "part int, shard int, n long")
