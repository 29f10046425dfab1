"""Vector codes from one codebook per part, fitted with norm-of-sum bounds.

Each part of each vector keeps its entry, an upper bound of its distance to that entry and a lower bound of
its distance to all others, each with the round in which it was measured.  Earlier codebooks are kept, so
a bound is corrected by how far an entry is now from where it was in that round.  This net displacement is
never more than the sum of the moves between, and needs no update of a row whose bounds still part.  Only rows
whose bounds overlap are measured anew, in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotalens.llm.store import released, saved

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Distances are square roots in doubles; bounds must part by more than this share of them to count.
SLACK = 1e-9
_STATE = (("codes", "byte"), ("upper", "double"), ("lower", "double"), ("upper_round", "byte"), ("lower_round", "byte"))
_KINDS = {"byte": pa.int8(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): components as floor(scale * x); rows without a vector of finite components go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale))).alias("q"))


def _checked(rows: DataFrame, parts: int) -> int:
    """The common length of the vectors (0 without rows)."""
    peak = F.array_max(F.transform("q", lambda x: F.abs(x)))
    least, most, peak = rows.agg(F.min(F.size("q")), F.max(F.size("q")), F.max(peak)).first()
    if least is None:
        return 0
    if least != most or most % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}; found {least} to {most}")
    if most and most * (2 * peak) ** 2 >= 1 << 62 or peak and peak >= 1 << 31:
        raise ValueError("components are too large for distances in 64 bits")
    return most


class Bounds:
    """Entries and bounds of the parts of some rows, as arrays of rows by parts."""

    def __init__(self, n: int, parts: int):
        self.codes = np.full((n, parts), -1, np.int8)
        self.upper, self.lower = np.full((n, parts), np.inf), np.zeros((n, parts))
        self.upper_round, self.lower_round = np.zeros((n, parts), np.int8), np.zeros((n, parts), np.int8)

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> "Bounds":
        out = cls(0, parts)
        for name, _ in _STATE:
            setattr(out, name, batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts).copy())
        return out


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(-1)


def assign(x: np.ndarray, books: np.ndarray, bounds: Bounds) -> int:
    """Move the bounds to the last of ``books`` (rounds × parts × entries × width); ``x`` is rows × parts × width.

    Returns how many parts were measured against all entries.
    """
    now, scans = len(books) - 1, 0
    rounds, parts, entries, _ = books.shape
    moved = np.sqrt(((books[-1][None] - books) ** 2).sum(-1).astype(float))  # rounds × parts × entries
    # the largest move of any other entry, from the two largest moves of all
    order = np.argsort(moved, -1)
    largest = np.take_along_axis(moved, order[..., -1:], -1)[..., 0]
    second = np.take_along_axis(moved, order[..., -2:-1], -1)[..., 0] if entries > 1 else np.zeros((rounds, parts))
    for p in range(parts):
        codes, u, l = bounds.codes[:, p], bounds.upper[:, p], bounds.lower[:, p]
        since, other_since = bounds.upper_round[:, p], bounds.lower_round[:, p]
        known = codes >= 0
        away = moved[since, p, codes]
        others = np.where(order[other_since, p, -1] == codes, second[other_since, p], largest[other_since, p])
        with np.errstate(invalid="ignore"):
            parted = lambda a, b: a + SLACK * (1 + a + others + np.where(np.isinf(l), 0, l)) < b - others
            open_rows = np.flatnonzero(~(known & parted(u + away, l)))
        if not len(open_rows):
            continue
        # first the distance to the own entry alone
        own = open_rows[known[open_rows]]
        if len(own):
            u[own], since[own] = np.sqrt(_squares(x[own, p], books[-1, p][codes[own]]).astype(float)), now
            with np.errstate(invalid="ignore"):
                open_rows = open_rows[~(known & parted(u, l))[open_rows]]
        if not len(open_rows):
            continue
        scans += len(open_rows)
        far = np.stack([_squares(x[open_rows, p], e) for e in books[-1, p]], 1)
        best = far.argmin(1)  # of equal distances the lower index
        rows = np.arange(len(best))
        codes[open_rows], u[open_rows] = best, np.sqrt(far[rows, best].astype(float))
        far[rows, best] = np.iinfo(np.int64).max
        l[open_rows] = np.sqrt(far.min(1).astype(float)) if entries > 1 else np.inf
        since[open_rows] = other_since[open_rows] = now
    return scans


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray, kind) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _round(state: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """One round: rows with new bounds, and per task one row with the change of the sums, the counts and the work."""
    n_rounds, parts, entries, part_width = books.shape
    started = n_rounds > 1
    names = ["vec_id", "label", "q", *(n for n, _ in _STATE), "change"]
    schema = ", ".join([*(f"{n} {t}" for n, t in state.select("vec_id", "label", "q").dtypes), *(f"{n} array<{t}>" for n, t in _STATE), "change array<long>"])

    def run(batches):
        change = np.zeros((parts, entries, part_width + 1), np.int64)
        work, kinds = np.zeros(2, np.int64), None
        for batch in batches:
            kinds = kinds or [batch.column(i).type for i in range(3)]
            x = _matrix(batch.column("q"), width).reshape(-1, parts, part_width)
            bounds = Bounds.read(batch, parts) if started else Bounds(len(x), parts)
            before = bounds.codes.copy()
            work += (x.shape[0] * parts, assign(x, books, bounds))
            for p in range(parts):
                rows = np.flatnonzero(before[:, p] != bounds.codes[:, p])
                one = np.concatenate([x[rows, p], np.ones((len(rows), 1), np.int64)], 1)
                np.add.at(change[p], bounds.codes[rows, p], one)
                left = before[rows, p] >= 0
                np.subtract.at(change[p], before[rows, p][left], one[left])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *(_lists(getattr(bounds, n), _KINDS[t]) for n, t in _STATE), pa.nulls(len(x), pa.list_(pa.int64()))], names=names)
        if kinds:
            last = [pa.nulls(1, k) for k in kinds] + [pa.nulls(1, pa.list_(_KINDS[t])) for _, t in _STATE]
            yield pa.RecordBatch.from_arrays([*last, pa.array([[*change.ravel().tolist(), *work.tolist()]], pa.list_(pa.int64()))], names=names)

    columns = ["vec_id", "label", "q", *((n for n, _ in _STATE) if started else ())]
    return state.where("q IS NOT NULL").select(*columns).mapInArrow(run, schema)


class CodeBooks:
    """Fitted codebooks: ``history`` is rounds × parts × entries × width, ``work`` (parts seen, parts measured) per round."""

    def __init__(self, history: np.ndarray, work: list[tuple[int, int]]):
        self.history, self.work = history, work

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        """Digest of all components by part, entry and place, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.last.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, CodeBooks | None]:
    """Fit codebooks to all vectors and encode them: (vec_id, label, codes, error), and the codebooks (None without rows).

    ``vectors`` needs vec_id, embedding and label; other columns are ignored.  Rows whose vector is null or holds null or
    non-finite components go.  The first codebook is the parts of the ``entries`` smallest vec_ids (null last,
    then by vector), so repeated ids and rows count one by one and may give equal entries; fewer rows give
    fewer entries.  Equal distances go to the lower index, unused entries stay.  Vectors of several lengths,
    or of a length that ``parts`` does not divide, and components whose distances need more than 64 bits
    raise ValueError before any round.  The driver holds codebooks only; sums are added in Spark.
    """
    rows = whole_vectors(vectors, scale)
    width = _checked(rows, parts)
    empty = vectors.sparkSession.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, label {dict(vectors.dtypes)['label']}, codes array<tinyint>, error long")
    first = [r["q"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    if not first:
        return empty, None
    part_width = width // parts
    history = np.array(first, np.int64).reshape(1, len(first), parts, part_width).transpose(0, 2, 1, 3)
    state = saved(rows.withColumn("q", F.col("q").cast("array<int>")), "vectors")
    totals, work = np.zeros((parts, len(first), part_width + 1), object), []
    for _ in range(rounds):
        after = saved(_round(state, history, width), "codes")
        released(state)
        state = after
        changes = state.where("change IS NOT NULL").select(F.posexplode("change").alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        flat = np.zeros(totals.size + 2, object)
        for r in changes.collect():  # one row per component of the codebooks
            flat[r["place"]] = int(r["x"])
        totals = totals + flat[:-2].reshape(totals.shape)
        work.append((flat[-2], flat[-1]))
        book = history[-1].copy()
        used = totals[..., -1] > 0
        book[used] = (totals[used][:, :-1] // totals[used][:, -1:]).astype(np.int64)
        history = np.concatenate([history, book[None]])
    books = CodeBooks(history, work)

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column("q"), width).reshape(-1, parts, part_width)
            bounds = Bounds.read(batch, parts) if rounds else Bounds(len(x), parts)
            assign(x, history, bounds)
            error = sum((_squares(x[:, p], history[-1, p][bounds.codes[:, p]]) for p in range(parts)), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _lists(bounds.codes, pa.int8()), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    kinds = dict(state.dtypes)
    last = state.where("q IS NOT NULL").select("vec_id", "label", "q", *((n for n, _ in _STATE) if rounds else ()))
    codes = saved(last.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<byte>, error long"), "encoded")
    released(state)
    return codes, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: the errors added over equal labels, nulls together."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")


def code_text(codes) -> "F.Column":
    """Codes as two hex digits each."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
