"""Isolation forest: one bounded subsample per tree, trees broadcast to the scoring tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quotalens.operators.ranking import top_n_per_group


def _average_path(n: np.ndarray | float):
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, features: np.ndarray, nodes: list) -> int:
    """Append nodes [feature, cut, left, right, size] and return the index of this one."""
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, len(x)])
    spread = [f for f in features if x[:, f].max() > x[:, f].min()] if len(x) > 1 and depth > 0 else []
    if spread:
        f = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        side = x[:, f] < cut
        if side.any() and not side.all():
            left = _grow(x[side], rng, depth - 1, features, nodes)
            nodes[me] = [f, cut, left, _grow(x[~side], rng, depth - 1, features, nodes), len(x)]
    return me


@dataclass
class IsolationForest:
    trees: list[np.ndarray]
    samples: int

    def score(self, df: DataFrame, vector: str = "vector", out: str = "raw_score") -> DataFrame:
        """2^(−mean path / expected path): higher is more unusual."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = float(max(_average_path(self.samples), 1e-9))

        @F.pandas_udf("double")
        def path(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            x = np.stack(v.to_numpy()).astype(float)
            total = np.zeros(len(x))
            for tree in shared.value:
                at, steps = np.zeros(len(x), dtype=int), np.zeros(len(x))
                live = tree[at, 0] >= 0
                while live.any():
                    rows = np.flatnonzero(live)
                    node = tree[at[rows]]
                    go = x[rows, node[:, 0].astype(int)] < node[:, 1]
                    at[rows] = np.where(go, node[:, 2], node[:, 3]).astype(int)
                    steps[rows] += 1
                    live = tree[at, 0] >= 0
                total += steps + _average_path(tree[at, 4])
            return pd.Series(np.exp2(-total / len(shared.value) / norm))

        return df.withColumn(out, path(vector))

    def ablation(self, df: DataFrame, row_id: str, features: Sequence[str], center: Sequence[float], vector: str = "vector") -> DataFrame:
        """(row_id, feature, score_reduction): how much the score drops with one feature at its training median."""
        base = self.score(df.select(row_id, vector), vector, "_base")
        middle = F.array(*[F.lit(float(c)) for c in center])
        names = F.array(*[F.lit(f) for f in features])
        each = base.select(row_id, vector, "_base", F.posexplode(names).alias("_i", "feature"))
        swapped = each.withColumn(vector, F.transform(vector, lambda x, i: F.when(i == F.col("_i"), F.element_at(middle, F.col("_i") + 1)).otherwise(x)))
        return self.score(swapped, vector, "_without").select(row_id, "feature", F.greatest(F.col("_base") - F.col("_without"), F.lit(0.0)).alias("score_reduction"))


def fit_isolation_forest(df: DataFrame, row_id: str, trees: int = 100, samples: int = 256, feature_share: float = 1.0, seed: int = 42, vector: str = "vector") -> IsolationForest:
    """Each tree draws exactly ``samples`` rows (all rows if there are fewer), the first in its own hash order, and grows in one small task.

    A row enters a tree's draw only if its hash there is low: about four times the rows wanted, so the draw never runs short.
    """
    n = df.count()
    samples = min(samples, n)
    share = min(1.0, (4.0 * samples + 64) / max(n, 1))
    highest = min(2**63 - 1, int(-(2**63) + share * 2**64))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(row_id)).alias("_h")))
    placed = df.select(row_id, vector, F.inline(F.filter(draws, lambda d: d["_h"] <= F.lit(highest))))
    picked = top_n_per_group(placed, ["tree"], [F.col("_h"), F.col(row_id)], samples).select("tree", vector)
    depth = math.ceil(math.log2(max(samples, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
        width = max(1, int(round(feature_share * x.shape[1])))
        nodes: list = []
        _grow(x, rng, depth, rng.permutation(x.shape[1])[:width], nodes)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "nodes": [np.array(nodes, dtype=float).ravel()]})

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()  # trees × at most 2·samples nodes
    return IsolationForest([np.array(r["nodes"]).reshape(-1, 5) for r in grown], samples)
