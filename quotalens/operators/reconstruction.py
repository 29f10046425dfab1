"""PCA on the covariance of a vector column: reconstruction errors and coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass
class PcaModel:
    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def errors(self, df: DataFrame, vector: str = "vector", out: str = "errors") -> DataFrame:
        """Squared reconstruction error per feature."""
        mean, comp = self.mean, self.components

        @F.pandas_udf("array<double>")
        def squared(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()) - mean
            return pd.Series(list(np.square(x - (x @ comp.T) @ comp)))

        return df.withColumn(out, squared(vector))

    def score(self, df: DataFrame, vector: str = "vector", out: str = "raw_score") -> DataFrame:
        """Mean squared reconstruction error."""
        scored = self.errors(df, vector, "_errors")
        total = F.aggregate("_errors", F.lit(0.0), lambda a, b: a + b)
        return scored.withColumn(out, total / F.size("_errors")).drop("_errors")

    def coordinates(self, df: DataFrame, k: int = 2, vector: str = "vector") -> DataFrame:
        """Centred coordinates on the first k components."""
        center = F.array(*[F.lit(float(m)) for m in self.mean])
        shifted = F.zip_with(F.col(vector), center, lambda a, b: a - b)
        dot = lambda row: F.aggregate(F.zip_with(shifted, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return df.withColumns({f"component_{i + 1}": dot(self.components[i]) for i in range(k)})

    def variance_table(self, spark) -> DataFrame:
        cumulative = np.cumsum(self.explained)
        rows = [(i + 1, float(e), float(c)) for i, (e, c) in enumerate(zip(self.explained, cumulative))]
        return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative_explained_variance double")


def fit_pca(df: DataFrame, vector: str = "vector", variance: float | None = 0.9, k: int | None = None) -> PcaModel:
    """Mean and covariance by one distributed pass of partial sums; the small eigen problem on the driver.

    The data meets as d × d sums, never as rows.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[vector].to_numpy())
            total = x.sum(0) if total is None else total + x.sum(0)
            gram = x.T @ x if gram is None else gram + x.T @ x
            n += len(x)
        if n:
            d = len(total)
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"i": np.concatenate([[-1], np.full(d, -1), i]), "j": np.concatenate([[-1], np.arange(d), j]),
                                "v": np.concatenate([[float(n)], total, gram[i, j]])})

    sums = df.select(vector).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    n = float(sums[(sums.i == -1) & (sums.j == -1)].v.iloc[0])
    first = sums[(sums.i == -1) & (sums.j >= 0)].sort_values("j")
    mean = first.v.to_numpy() / n
    d = len(mean)
    cov = np.zeros((d, d))
    rest = sums[sums.i >= 0]
    cov[rest.i, rest.j] = rest.v
    cov = (cov + np.triu(cov, 1).T - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    ratio = values / values.sum() if values.sum() > 0 else values
    if k is None:
        k = d if variance is None else min(d, int(np.searchsorted(np.cumsum(ratio), variance, side="right")) + 1)
    signs = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])
    return PcaModel(mean, (vectors * signs[:, None])[:k], ratio[:k])


def long_contributions(df: DataFrame, row_id: str, features: list[str], errors: str = "errors") -> DataFrame:
    """(row_id, feature, contribution): every feature's error as rows."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.arrays_zip(names.alias("feature"), F.col(errors).alias("contribution"))
    return df.select(row_id, F.explode(pairs).alias("p")).select(row_id, F.col("p.feature").alias("feature"), F.col("p.contribution").alias("contribution"))
