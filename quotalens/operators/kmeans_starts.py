"""K-Means from several starts and for several k in the same passes over the rows.

A run is one (k, start).  Every pass measures the rows of a task against the centres of all live runs and returns
one partial row per centre; Spark adds those up.  The driver holds centres only: starts × the sum of all k, times
the width of a vector, and while seeding some ten candidates per largest k and start.  No row travels but the drawn
candidates, and a run that has settled takes no part in later passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from quotalens.operators.clustering import KMeansModel
from quotalens.operators.metric_tree import distances
from quotalens.session import checkpointed

#: Distances that a task holds at a time.
CELLS = 1 << 22
#: Rounds of drawing; more follow only where a start has fewer candidates than its largest k.
DRAWS = 5
#: Relative difference below which two inertias are the same: sums of doubles depend on how rows are split.
SAME = 1e-9


@dataclass
class Run:
    k: int
    start: int
    centers: np.ndarray
    inertia: float = float("nan")
    rounds: int = 0
    settled: bool = False


def _blocks(batches: Iterator[pd.DataFrame], vector: str, centers: np.ndarray):
    """Pieces of the batches with their vectors and squared distances to all centres."""
    rows = max(1, CELLS // max(len(centers), 1))
    for batch in batches:
        for at in range(0, len(batch), rows):
            piece = batch.iloc[at:at + rows]
            x = np.stack(piece[vector].to_numpy()).astype(float)
            yield piece, x, np.square(distances(x, centers))


def measured(data: DataFrame, sets: Sequence[np.ndarray], vector: str = "vector") -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of centres: rows, squared distances and vector sums of every centre's nearest rows (ties to the first)."""
    edges = np.cumsum([0, *[len(s) for s in sets]])
    centers = np.concatenate(sets)
    total, width = centers.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, sums = np.zeros(total, dtype=np.int64), np.zeros(total), np.zeros((total, width))
        for _, x, gaps in _blocks(batches, vector, centers):
            for low, high in zip(edges[:-1], edges[1:]):
                near = low + gaps[:, low:high].argmin(1)
                own = np.square(x - centers[near]).sum(1)
                n += np.bincount(near, minlength=total)
                cost += np.bincount(near, own, total)
                for slot in np.unique(near):
                    sums[slot] += x[near == slot].sum(0)
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"slot": held, "n": n[held], "cost": cost[held], "sums": list(sums[held])})

    parts = data.select(vector).mapInPandas(partial, "slot long, n long, cost double, sums array<double>")
    added = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    n, cost, sums = np.zeros(total, dtype=np.int64), np.zeros(total), np.zeros((total, width))
    for r in added.select("slot", "n", "cost", vector_to_array("sums").alias("sums")).collect():  # one row per centre
        n[r["slot"]], cost[r["slot"]], sums[r["slot"]] = r["n"], r["cost"], r["sums"]
    return [(n[a:b], cost[a:b], sums[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def lloyd(data: DataFrame, runs: Sequence[Run], iterations: int = 100, tolerance: float = 1e-4, vector: str = "vector") -> list[Run]:
    """Move the centres of all runs until each run's centres move by no more than ``tolerance``.

    A centre without rows stays where it is.  The inertia is that of the centres returned.
    """
    for _ in range(iterations):
        live = [r for r in runs if not r.settled]
        if not live:
            break
        for run, (n, _cost, sums) in zip(live, measured(data, [r.centers for r in live], vector)):
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], run.centers)
            run.settled = bool(np.sqrt(np.square(moved - run.centers).sum(1)).max() <= tolerance)
            run.centers, run.rounds = moved, run.rounds + 1
    for run, (_n, cost, _sums) in zip(runs, measured(data, [r.centers for r in runs], vector)):
        run.inertia = float(cost.sum())
    return list(runs)


def _uniform(keys: np.ndarray, start: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes and the number of a start, the same wherever a row is read."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(start + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _drawn(data: DataFrame, sets: Sequence[np.ndarray], costs: Sequence[float], draw: float, vector: str) -> list[np.ndarray]:
    """New candidates of every start: rows drawn with probability ``draw`` × squared distance / total."""
    edges = np.cumsum([0, *[len(s) for s in sets]])
    centers = np.concatenate(sets)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, x, gaps in _blocks(batches, vector, centers):
            keys = piece["_key"].to_numpy(dtype=np.int64).view(np.uint64)
            for s, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                if costs[s] > 0:
                    hit = _uniform(keys, s) * costs[s] < draw * gaps[:, low:high].min(1)
                    if hit.any():
                        yield pd.DataFrame({"start": s, "_key": keys[hit].view(np.int64), "vector": list(x[hit])})

    rows = data.select("_key", vector).mapInPandas(pick, "start int, _key long, vector array<double>").collect()  # about ``draw`` rows per start
    out: list[list] = [[] for _ in sets]
    for r in sorted(rows, key=lambda r: (r["start"], r["_key"], r["vector"])):
        out[r["start"]].append(r["vector"])
    return [np.unique(np.concatenate([s, np.array(more, float).reshape(-1, s.shape[1])]), axis=0) for s, more in zip(sets, out)]


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, each new one drawn by weight × squared distance to those already taken."""
    if len(candidates) <= k:
        return candidates
    taken = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    gap = np.square(candidates - candidates[taken[0]]).sum(1)
    while len(taken) < k:
        mass = weights * gap
        if mass.sum() <= 0:
            mass = np.where(gap > 0, 1.0, 0.0)
        taken.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
        gap = np.minimum(gap, np.square(candidates - candidates[taken[-1]]).sum(1))
    return candidates[taken]


def seeded_runs(data: DataFrame, row_id: str, ks: Sequence[int], starts: int, seed: int = 42, vector: str = "vector") -> list[Run]:
    """First centres of all runs: candidates are drawn for all starts at once, weighed by their nearest rows, then
    reduced to every k.  With fewer distinct vectors than k a run has one centre per distinct vector."""
    least = max(ks)
    order = lambda s: F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(row_id)), F.col(row_id))
    first = data.agg(*[F.min_by(vector, order(s)).alias(f"s{s}") for s in range(starts)]).first()
    if first["s0"] is None:
        raise ValueError("no rows to fit")
    sets = [np.array([first[f"s{s}"]], float) for s in range(starts)]
    turn = 0
    while turn < DRAWS or min(len(s) for s in sets) < least:
        costs = [float(cost.sum()) for _, cost, _ in measured(data, sets, vector)]
        if turn >= DRAWS:
            costs = [c if len(s) < least else 0.0 for c, s in zip(costs, sets)]
        if max(costs) <= 0:
            break
        keyed = data.withColumn("_key", F.xxhash64(F.lit(seed), F.lit(turn), F.col(row_id)))
        sets = _drawn(keyed, sets, costs, 2.0 * least, vector)
        turn += 1
    runs = []
    for start, (candidates, (n, _cost, _sums)) in enumerate(zip(sets, measured(data, sets, vector))):
        for k in ks:
            runs.append(Run(k, start, _reduced(candidates, n.astype(float), k, np.random.default_rng([seed, start, k]))))
    return runs


def fit_kmeans_starts(df: DataFrame, row_id: str, ks: Sequence[int], starts: int = 20, seed: int = 42, iterations: int = 100,
                      tolerance: float = 1e-4, vector: str = "vector") -> tuple[dict[int, KMeansModel], DataFrame]:
    """The best model of every k, and all trials (k, start, inertia, rounds, settled, chosen).

    Rows without a vector are left out; of starts that reach the same inertia (but for the order of additions) the first wins.  An empty table raises ValueError.
    """
    data = checkpointed(df.filter(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("vector")))
    runs = lloyd(data, seeded_runs(data, row_id, ks, starts, seed), iterations, tolerance)
    least = {k: min(r.inertia for r in runs if r.k == k) for k in ks}
    best = {k: min((r for r in runs if r.k == k and r.inertia <= least[k] * (1 + SAME)), key=lambda r: r.start) for k in ks}
    rows = [(r.k, r.start, r.inertia, r.rounds, r.settled, best[r.k] is r) for r in runs]
    trials = df.sparkSession.createDataFrame(rows, "k int, start int, inertia double, rounds int, settled boolean, chosen boolean")
    return {k: KMeansModel(r.centers.tolist(), r.inertia) for k, r in best.items()}, trials
