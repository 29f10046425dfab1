"""Which names occur more than once in the corpus?  Asked and answered per chunk of documents.

Documents are dealt by the hash of their id to chunks of a few MB.  A chunk sends its distinct names,
sorted, to the owners of the name ranges; an owner answers with a class for each name.  A name thus
travels once per chunk whatever its count, answers need no keys, and the text is shuffled once: each
pass reads the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 2 << 20
RANGE_BYTES = 16 << 20
FIRST = 128
ROWS = "r long, chunk long, names binary, counts binary"
ANSWERS = "chunk long, r long, answer binary"
_ROWS = pa.schema([("r", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int64()), ("r", pa.int64()), ("answer", pa.binary())])


def chunked(docs: DataFrame, carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text[, rest]) with null text as empty, and the number of name ranges.

    ``carry`` names columns that travel along in the struct ``rest``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    size = base.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks, ranges = max(1, -(-size // chunk_bytes)), max(1, -(-size // range_bytes))
    return base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks).cast("long"))), int(ranges)


def ordered(table: pa.Table) -> pa.Table:
    """The chunk's rows in an order that no shuffle changes."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))


def edges(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def pack(names: np.ndarray) -> bytes:
    """Bytes of sorted names plane by plane; the upper planes compress to almost nothing."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def asked(chunk: int, names: np.ndarray, counts: np.ndarray, ranges: int, state: bytes | None = None) -> pa.Table:
    """A chunk's question: its distinct sorted names with their counts, cut by range; ``state`` comes back as it is."""
    cuts = [0, *np.searchsorted(names, edges(ranges)).tolist(), len(names)]
    few = np.minimum(counts, 255).astype(np.uint8)
    rows = [(r, chunk, pack(names[a:b]), few[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    if state is not None:
        rows.append((ranges + chunk, chunk, state, None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS) if rows else _ROWS.empty_table()


def answered(questions: DataFrame, ranges: int) -> DataFrame:
    """Class 0 for a name that occurs once in all chunks, else 1 + 4 log2 of its count, rounded down.

    The lowest chunk that holds a repeated name gets FIRST added.
    """

    def answer(table: pa.Table) -> pa.Table:
        if table["r"][0].as_py() >= ranges:
            return pa.Table.from_arrays([table["chunk"], table["r"], table["names"]], schema=_ANSWERS)
        table = table.take(pc.sort_indices(table, [("chunk", "ascending")]))
        names = [unpack(x) for x in table["names"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]).astype(np.int64)
        _, place, _ = unique_of(names)
        total = np.bincount(place, weights=counts)
        kind = np.where(total > 1, np.minimum(127, 1 + np.floor(4 * np.log2(np.maximum(total, 1)) + 1e-9)), 0).astype(np.uint8)[place]
        first = np.full(len(total), len(place))
        np.minimum.at(first, place, np.arange(len(place)))
        first = first[total > 1]
        kind[first] += FIRST
        cuts = np.cumsum([0, *map(len, names)])
        return pa.Table.from_arrays([table["chunk"], table["r"], pa.array([kind[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], schema=_ANSWERS)

    return questions.groupBy("r").applyInArrow(answer, ANSWERS)


def unique_of(names: list[np.ndarray]):
    from quotalens.llm.hashing import unique_names

    return unique_names(np.concatenate(names))


def read_answer(table: pa.Table, ranges: int) -> tuple[np.ndarray, bytes | None]:
    """The classes in the order of the chunk's sorted names, and its state."""
    order = sorted(zip(table["r"].to_pylist(), table["answer"].to_pylist()))
    kinds = [np.frombuffer(x, np.uint8) for r, x in order if r < ranges]
    state = [x for r, x in order if r >= ranges]
    return np.concatenate(kinds) if kinds else np.zeros(0, np.uint8), state[0] if state else None


def first_pass(docs: DataFrame, ask: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Apply ``ask(chunk, rows)`` to each chunk."""
    return docs.groupBy("chunk").applyInArrow(lambda t: ask(t["chunk"][0].as_py(), ordered(t)), ROWS)


def next_pass(docs: DataFrame, answers: DataFrame, step: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``step(chunk, rows, answers)`` to each chunk and what came back for it."""

    def run(key, rows: pa.Table, back: pa.Table) -> pa.Table:
        return step(key[0].as_py(), ordered(rows), back)

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
