"""K-Means segmentation, exact neighbours, DBSCAN and clustering quality.

Neighbour work never pairs rows in a table: it descends a metric tree, and the pairs of leaves that the bounds
leave are measured by numpy in bounded groups, which return a short result per row.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from quotalens.operators.metric_tree import LEAF_ROWS, SLACK, MetricTree, Queries, build_tree, distances as _distances, kth_distances, near_leaves, own_queries, route, visit
from quotalens.operators.metrics import adjusted_rand, ecdf_score, minmax
from quotalens.operators.ranking import best_row, quantiles
from quotalens.session import checkpointed

# --- K-Means --------------------------------------------------------------------------------


@dataclass
class KMeansModel:
    centers: list[list[float]]
    inertia: float = float("nan")

    def _gaps(self, vector: str) -> Column:
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centers])
        return F.transform(rows, lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))

    def assign(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """Cluster of the nearest centre and the Euclidean distance to it."""
        out = df.withColumn("_g", self._gaps(vector))
        out = out.withColumn("distance", F.sqrt(F.array_min("_g"))).withColumn("cluster", F.array_position("_g", F.array_min("_g")).cast("int") - 1)
        return out.drop("_g")

    def contributions(self, df: DataFrame, features: Sequence[str], row_id: str, vector: str = "vector") -> DataFrame:
        """(row_id, cluster, feature, share, residual): shares of the squared distance to the assigned centre."""
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centers])
        a = self.assign(df, vector).withColumn("_r", F.zip_with(F.col(vector), F.element_at(rows, F.col("cluster") + 1), lambda x, y: x - y))
        total = F.aggregate("_r", F.lit(0.0), lambda s, x: s + x * x)
        a = a.withColumn("_t", total).withColumn("_s", F.transform("_r", lambda x: F.when(F.col("_t") > 0, x * x / F.col("_t")).otherwise(0.0)))
        z = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("_s").alias("share"), F.col("_r").alias("residual"))).alias("z")
        return a.select(row_id, "cluster", z).select(row_id, "cluster", "z.*")

    def checks(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """One row: whether every assigned centre is the nearest, and the total squared distance."""
        a = self.assign(df.withColumn("_g", self._gaps(vector)), vector)
        nearest = F.element_at(self._gaps(vector), F.col("cluster") + 1) <= F.array_min(self._gaps(vector)) + 1e-12
        return a.agg(F.min(nearest).alias("all_nearest"), F.sum(F.col("distance") * F.col("distance")).alias("inertia"), F.count(F.lit(1)).alias("rows"))


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, iterations: int = 100, vector: str = "vector") -> KMeansModel:
    data = df.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features").fit(data)
    return KMeansModel([list(map(float, c)) for c in model.clusterCenters()], float(model.summary.trainingCost))


def distance_score(df: DataFrame, train: DataFrame, distance: str = "distance", out: str = "anomaly_score") -> DataFrame:
    """Share of training distances at or below each distance."""
    return ecdf_score(df, train, [], distance, out)


# --- neighbours -----------------------------------------------------------------------------


def _types(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def kth_neighbor_distance(df: DataFrame, row_id: str, k: int, vector: str = "vector", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(row_id, distance): Euclidean distance to the k-th nearest row, counting the row itself as the first."""
    tree = build_tree(df, row_id, vector, leaf_rows)
    return tree.per_row(kth_distances(tree, own_queries(tree), k, _types(df, row_id))[0]).select(row_id, "distance")


def neighbor_work(df: DataFrame, row_id: str, k: int, vector: str = "vector", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """What :func:`kth_neighbor_distance` measures (one row): leaves, leaf pairs, vector pairs and their share of all pairs."""
    tree = build_tree(df, row_id, vector, leaf_rows)
    return kth_distances(tree, own_queries(tree), k, _types(df, row_id))[1]


def k_distance_quantiles(df: DataFrame, row_id: str, k: int, probabilities: Sequence[float], vector: str = "vector") -> DataFrame:
    """Candidate eps values: quantiles of the k-distance curve (one row)."""
    d = kth_neighbor_distance(df, row_id, k, vector)
    return quantiles(d, [], "distance", {f"q{round(p * 100)}": p for p in probabilities})


# --- DBSCAN ---------------------------------------------------------------------------------


def min_label_components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component, from undirected (a, b) edges.

    Labels travel over edges and jump to their label's label until none changes; each round is checkpointed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    both = checkpointed(both)
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_offer"))
        step = labels.join(offered, ["node"], "left").withColumn("_new", F.least("label", F.coalesce("_offer", "label")))
        jump = step.join(labels.select(F.col("node").alias("_new"), F.col("label").alias("_far")), ["_new"], "left")
        fresh = checkpointed(jump.select("node", F.col("label").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("label")))
        if fresh.filter(F.col("label") != F.col("_old")).isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")


def _above(node: str) -> Column:
    """A node and all nodes above it, from the root."""
    parts = F.split(node, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), ".").alias("node")))


def _linked(ids, others, _, d, __, ___, eps: float) -> dict:
    """Each core row with the smallest core row it can reach inside the two blocks, one hop at a time; those that reach none smaller are left out."""
    i, j = np.nonzero(d <= eps)
    la, lb = ids.copy(), others.copy()
    while True:
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, i, lb[j])
        np.minimum.at(nb, j, na[i])
        if (na == la).all() and (nb == lb).all():
            a, b = np.concatenate([ids, others]), np.concatenate([la, lb])
            return {"a": a[a != b], "b": b[a != b]}
        la, lb = na, nb


def _nearest_core(tree: MetricTree, queries: Queries, pairs: DataFrame, cores: DataFrame, kind: str, eps: float) -> DataFrame:
    """(id, label) of the nearest core row (node, id, vector, weight, label) within eps; of equal distances the smallest id."""
    def nearest(ids, others, _, d, right, measure):
        least = d.min(1)
        i, j = np.nonzero((d <= (least * (1 + SLACK) + SLACK * SLACK)[:, None]) & (least <= eps)[:, None])
        best = measure(i, j)
        order = np.lexsort((j, best, i))  # of a row's nearest rows the smallest id, as leaf rows come in their order
        order = order[np.unique(i[order], return_index=True)[1]]
        return {"id": ids[i[order]], "label": right["label"].to_numpy()[j[order]], "distance": best[order], "other": others[j[order]]}

    own = _types(cores, "id")
    found = visit(tree, queries, pairs, nearest, f"id {kind}, label {own}, distance double, other {own}", cores, eps)
    return best_row(found, ["id"], [F.col("distance"), F.col("other")]).select("id", "label")


@dataclass
class DbscanModel:
    """A fitted DBSCAN: ``labels`` (row_id, label, core; label is the smallest core id of the cluster, null for noise), the tree of
    the fitted rows and that of the core rows alone (None without one)."""

    eps: float
    min_samples: int
    row_id: str
    labels: DataFrame
    tree: MetricTree
    cores: DataFrame
    core_labels: DataFrame
    leaf_rows: int = LEAF_ROWS

    @cached_property
    def core_tree(self) -> MetricTree | None:
        """Built when new rows are labelled, not for the fit."""
        return None if self.cores.isEmpty() else build_tree(self.cores, "id", "vector", self.leaf_rows)

    def predict(self, df: DataFrame, row_id: str, vector: str = "vector") -> DataFrame:
        """(row_id, label): the cluster of the nearest core row within eps, null for noise."""
        own = _types(self.core_labels, "id")
        if self.core_tree is None:
            return df.select(row_id, F.lit(None).cast(own).alias("label"))
        tree = self.core_tree
        queries = route(tree, df, row_id, vector, self.leaf_rows)
        pairs, _ = near_leaves(tree, queries.blocks.withColumn("bound", F.lit(float(self.eps))))
        cores = tree.rows.join(self.core_labels, ["id"])
        found = _nearest_core(tree, queries, pairs, cores, _types(df, row_id), self.eps)
        return df.select(row_id).join(found.withColumnRenamed("id", row_id), [row_id], "left")

    def neighbor_count(self) -> int:
        """Which neighbour's distance is scored: the min_samples-th, the second at least."""
        return max(2, self.min_samples)

    def curve(self) -> DataFrame:
        """(row_id, distance) of the fitted rows, the reference of all scores."""
        return self.tree.per_row(kth_distances(self.tree, own_queries(self.tree), self.neighbor_count(), _types(self.labels, self.row_id))[0]).select(self.row_id, "distance")

    def distances(self, df: DataFrame, row_id: str, vector: str = "vector") -> DataFrame:
        """(row_id, distance) from new rows to their k-th nearest fitted row."""
        queries = route(self.tree, df, row_id, vector, self.leaf_rows)
        return kth_distances(self.tree, queries, self.neighbor_count(), _types(df, row_id))[0].select(F.col("id").alias(row_id), "distance")

    def score(self, df: DataFrame, curve: DataFrame, row_id: str, vector: str = "vector") -> DataFrame:
        """(row_id, label, anomaly_score, raw_score) of new rows against the stored curve."""
        labels = self.predict(df, row_id, vector)
        return dbscan_scores(labels, self.distances(df, row_id, vector), row_id, curve).join(labels, [row_id]).select(row_id, "label", "anomaly_score", "raw_score")


def fit_dbscan(df: DataFrame, row_id: str, eps: float, min_samples: int, vector: str = "vector", leaf_rows: int = LEAF_ROWS) -> DbscanModel:
    """DBSCAN of all rows with a vector.  Border rows take the cluster of their nearest core row within eps.

    Blocks and nodes that lie within eps of each other altogether are counted and linked without measuring rows.
    """
    eps = float(eps)
    tree = build_tree(df, row_id, vector, leaf_rows)
    own, kind = own_queries(tree), _types(df, row_id)
    pairs, inside = near_leaves(tree, own.blocks.withColumn("bound", F.lit(eps)), F.lit(eps))

    measured = visit(tree, own, pairs, lambda ids, _, weights, d, *__: {"id": ids, "n": (d <= eps) @ weights}, f"id {kind}, n long", eps=eps)
    whole = inside.join(tree.nodes.select("node", "weight"), ["node"]).groupBy("block").agg(F.sum("weight").alias("n"))
    counts = measured.unionByName(own.rows.join(whole, ["block"]).select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    cores = checkpointed(tree.rows.join(counts.filter(F.col("n") >= min_samples), ["id"], "left_semi"))

    # blocks with a core row beside a node with one, all within eps: everything in both is one cluster
    above = cores.select("id", F.inline(_above("node")))
    least = checkpointed(above.groupBy("node").agg(F.min("id").alias("least")))
    touching = inside.join(least, ["node"]).join(least.select(F.col("node").alias("block"), F.col("least").alias("_own")), ["block"])
    one = checkpointed(touching.select("node").unionByName(touching.select(F.col("block").alias("node"))).distinct())
    top = above.join(one, ["node"]).groupBy("id").agg(F.min_by("node", "level").alias("node")).join(least, ["node"])
    edges = touching.select(F.col("_own").alias("a"), F.col("least").alias("b")).unionByName(top.select(F.col("id").alias("a"), F.col("least").alias("b")))
    core_queries = Queries(own.blocks, cores.select(F.col("node").alias("block"), "id", "vector"))
    edges = edges.unionByName(visit(tree, core_queries, pairs, lambda *x: _linked(*x, eps), f"a {kind}, b {kind}", cores, eps)).unionByName(cores.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    core_labels = checkpointed(min_label_components(edges).select(F.col("node").alias("id"), "label"))

    # a row that is no core has few rows within eps, so few nodes lie inside its reach altogether
    rest = own.rows.join(core_labels, ["id"], "left_anti")
    leaves = cores.select(F.col("node").alias("_leaf")).distinct().select("_leaf", F.inline(_above("_leaf"))).drop("level")
    inside_leaves = inside.join(rest.select("block").distinct(), ["block"], "left_semi").join(leaves, ["node"]).select("block", F.col("_leaf").alias("node"))
    border = _nearest_core(tree, Queries(own.blocks, rest), pairs.unionByName(inside_leaves).distinct(), cores.join(core_labels, ["id"]), kind, eps)
    known = core_labels.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    labels = df.select(row_id).join(tree.per_row(known), [row_id], "left").select(row_id, "label", F.coalesce("core", F.lit(False)).alias("core"))
    return DbscanModel(eps, min_samples, row_id, checkpointed(labels), tree, cores.select("id", "vector"), core_labels, leaf_rows)


def dbscan(df: DataFrame, row_id: str, eps: float, min_samples: int, vector: str = "vector", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(row_id, label, core) of :func:`fit_dbscan`."""
    return fit_dbscan(df, row_id, eps, min_samples, vector, leaf_rows).labels


def dbscan_scores(labels: DataFrame, distances: DataFrame, row_id: str, reference: DataFrame | None = None) -> DataFrame:
    """Rank score: noise in [0.75, 1], members in [0, 0.75], by the share of the reference's k-distances at or below."""
    ranked = ecdf_score(distances, distances if reference is None else reference, [], "distance", "_base").join(labels, [row_id])
    noise = F.col("label").isNull()
    return ranked.select(row_id, F.when(noise, 0.75 + 0.25 * F.col("_base")).otherwise(0.75 * F.col("_base")).alias("anomaly_score"),
                         (F.when(noise, 0.75).otherwise(0.0) + 0.25 * F.col("distance") / (1 + F.col("distance"))).alias("raw_score"))


# --- quality --------------------------------------------------------------------------------


def centroids(df: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """(label, n, m): size and mean vector of each label, combined before the shuffle."""
    summary = Summarizer.metrics("count", "mean").summary(array_to_vector(vector))
    return df.groupBy(label).agg(summary.alias("_s")).select(label, F.col("_s.count").alias("n"), vector_to_array("_s.mean").alias("m"))


def clustering_quality(df: DataFrame, row_id: str, label: str, vector: str = "vector", sample: int = 2000, max_clusters: int = 1000) -> DataFrame:
    """Counts, balance, Davies–Bouldin, Calinski–Harabasz and the silhouette of squared distances over all members; the silhouette of
    plain distances (silhouette_score) over a hash sample (one row).

    A row's mean squared distance to a cluster follows from the cluster's size, centre and spread.  The sample and the centroids are bounded, so they travel to the tasks; rows do not meet.
    """
    spark = df.sparkSession
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).isNull().cast("long")).alias("noise")).first()
    members = df.filter(F.col(label).isNotNull()).select(row_id, F.col(label).cast("string").alias("c"), vector)
    d = len(df.select(vector).first()[0])
    rows = centroids(members, "c", vector).orderBy("c").limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    names, sizes = [r["c"] for r in rows], np.array([r["n"] for r in rows], float)
    out = {"number_of_clusters": len(rows), "noise_percentage": 100.0 * (facts["noise"] or 0) / max(facts["n"], 1),
           "smallest_cluster_pct": float(100.0 * sizes.min() / facts["n"]) if len(rows) else 0.0, "largest_cluster_pct": float(100.0 * sizes.max() / facts["n"]) if len(rows) else 0.0,
           "cluster_balance": float(sizes.min() / sizes.max()) if len(rows) else 0.0, "silhouette_score": None, "davies_bouldin_score": None, "calinski_harabasz_score": None, "silhouette_squared": None}
    if len(rows) >= 2 and sizes.sum() > len(rows):
        centers = np.array([r["m"] for r in rows])
        index = {c: i for i, c in enumerate(names)}
        place = F.create_map(*[F.lit(x) for c, i in index.items() for x in (c, i)])

        @F.pandas_udf("double")
        def to_center(c: pd.Series, v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, d))
            return pd.Series(np.sqrt(((x - centers[c.to_numpy(dtype=int)]) ** 2).sum(1)))

        dist = members.withColumn("k", F.element_at(place, F.col("c"))).withColumn("dc", to_center("k", vector))
        spread = {r["k"]: (r["m"], r["s"]) for r in dist.groupBy("k").agg(F.avg("dc").alias("m"), F.sum(F.col("dc") * F.col("dc")).alias("s")).collect()}
        s = np.array([spread[i][0] for i in range(len(names))])
        within = sum(v[1] for v in spread.values())
        gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (s[:, None] + s[None]) / gap
        np.fill_diagonal(r, -np.inf)
        out["davies_bouldin_score"] = float(r.max(1).mean())
        total = (sizes[:, None] * centers).sum(0) / sizes.sum()
        between = float((sizes * ((centers - total) ** 2).sum(1)).sum())
        out["calinski_harabasz_score"] = float(between / (len(names) - 1) / (within / (sizes.sum() - len(names)))) if within > 0 else 1.0
        inside = np.array([spread[i][1] for i in range(len(names))]) / sizes  # mean squared distance to the own centre

        @F.pandas_udf("double")
        def width(c: pd.Series, v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            own, n = c.to_numpy(dtype=int), np.arange(len(c))
            mean = np.square(_distances(np.stack(v.to_numpy()).astype(float), centers)) + inside
            a = mean[n, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
            mean[n, own] = np.inf
            b = mean.min(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                return pd.Series(np.where((sizes[own] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0))

        out["silhouette_squared"] = dist.select(width("k", vector).alias("w")).agg(F.avg("w")).first()[0]
        out["silhouette_score"] = _sampled_silhouette(dist, row_id, vector, sample, len(names))
    schema = "number_of_clusters int, noise_percentage double, smallest_cluster_pct double, largest_cluster_pct double, cluster_balance double, silhouette_score double, davies_bouldin_score double, calinski_harabasz_score double, silhouette_squared double"
    return spark.createDataFrame([tuple(out.values())], schema)


def _sampled_silhouette(dist: DataFrame, row_id: str, vector: str, sample: int, clusters: int) -> float | None:
    picked = dist.orderBy(F.xxhash64(F.lit("silhouette"), row_id), row_id).limit(sample).select(row_id, "k", vector)
    rows = picked.collect()  # bounded by ``sample``
    x, k = np.array([r[vector] for r in rows], float), np.array([r["k"] for r in rows])
    if len(set(k)) < 2:
        return None
    sizes = np.bincount(k, minlength=clusters)

    @F.pandas_udf("double")
    def width(c: pd.Series, v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        gaps = _distances(np.stack(v.to_numpy()).astype(float), x)
        sums = np.stack([gaps[:, k == j].sum(1) for j in range(clusters)], 1)
        own, n = c.to_numpy(dtype=int), np.arange(len(c))
        inside = sums[n, own] / np.maximum(sizes[own] - 1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            means = sums / sizes
        means[:, sizes == 0] = np.inf
        means[n, own] = np.inf
        outside = means.min(1)
        s = (outside - inside) / np.maximum(inside, outside)
        return pd.Series(np.where(sizes[own] > 1, s, 0.0))

    return float(picked.repartition(8, row_id).select(width("k", vector).alias("w")).agg(F.avg("w")).first()[0])


def selection_scores(trials: DataFrame) -> DataFrame:
    """Weighted 0–1 score of clustering trials; rejected configurations get −1."""
    t = trials.withColumn("_ch", F.log1p(F.greatest("calinski_harabasz_score", F.lit(0.0))))
    parts = [(0.30, "silhouette_score", True), (0.16, "davies_bouldin_score", False), (0.12, "_ch", True), (0.20, "cluster_balance", True), (0.10, "stability_score", True),
             (0.04, "runtime_seconds", False), (0.08, "interpretability_score", True)]
    score = sum((F.lit(w) * minmax(c, [], up) for w, c, up in parts), F.lit(0.0))
    return t.withColumn("selection_score", F.when(F.col("valid_configuration"), score).otherwise(-1.0)).drop("_ch")


TRIAL = ("configuration_id string, k int, eps double, min_samples int, runtime_seconds double, stability_score double, interpretability_score double, valid_configuration boolean, "
         "number_of_clusters int, noise_percentage double, smallest_cluster_pct double, largest_cluster_pct double, cluster_balance double, silhouette_score double, "
         "davies_bouldin_score double, calinski_harabasz_score double, silhouette_squared double")


def tune_kmeans(df: DataFrame, row_id: str, ks: Sequence[int], seed: int = 42, repeats: int = 2, vector: str = "vector", limits: tuple[float, float] = (1.0, 90.0)) -> tuple[DataFrame, int]:
    """(trials, best k): quality, balance limits and seed stability per k; each trial is a Spark fit."""
    rows = []
    for k in ks:
        start = time.perf_counter()
        base = fit_kmeans(df, k, seed, vector=vector).assign(df, vector).select(row_id, "cluster", vector)
        took = time.perf_counter() - start
        q = clustering_quality(base, row_id, "cluster", vector).first()
        pairs = []
        for r in range(1, repeats):
            other = fit_kmeans(df, k, seed + r, vector=vector).assign(df, vector).select(row_id, F.col("cluster").alias("again"))
            pairs.append(adjusted_rand(base.join(other, [row_id]), "cluster", "again").first()[0])
        ok = q["smallest_cluster_pct"] >= limits[0] and q["largest_cluster_pct"] <= limits[1]
        rows.append((f"kmeans_k_{k}", k, None, None, took, float(np.mean(pairs)) if pairs else 1.0, 1.0 / (1.0 + 0.08 * max(k - 2, 0)), ok, *q))
    trials = checkpointed(selection_scores(df.sparkSession.createDataFrame(rows, TRIAL)))
    return trials, trials.orderBy(F.col("selection_score").desc(), "k").first()["k"]


def tune_dbscan(df: DataFrame, row_id: str, min_samples: Sequence[int], probabilities: Sequence[float], vector: str = "vector", noise_std: float = 0.02, seed: int = 42,
                max_noise: float = 55.0, min_cluster: float = 0.5) -> tuple[DataFrame, dict]:
    """(trials, best): eps from k-distance quantiles; stability under a hash-seeded perturbation."""
    from quotalens.functions import stable_uniform
    rows = []
    token = lambda i: F.concat(F.col(row_id).cast("string"), F.lit("|"), i.cast("string"))
    gauss = lambda i: F.sqrt(-2 * F.log(F.greatest(stable_uniform(token(i), seed, "a"), F.lit(1e-12)))) * F.cos(2 * math.pi * stable_uniform(token(i), seed, "b"))
    shaken = checkpointed(df.withColumn(vector, F.transform(vector, lambda x, i: x + noise_std * gauss(i))))
    for m in min_samples:
        q = k_distance_quantiles(df, row_id, m, probabilities, vector).first()
        for eps in sorted({max(float(v), 1e-6) for v in q}):
            start = time.perf_counter()
            labels = checkpointed(dbscan(df, row_id, eps, m, vector))
            took = time.perf_counter() - start
            quality = clustering_quality(df.select(row_id, vector).join(labels, [row_id]), row_id, "label", vector).first()
            again = checkpointed(dbscan(shaken, row_id, eps, m, vector).select(row_id, F.coalesce("label", F.lit(-1)).alias("again")))
            stable = adjusted_rand(labels.select(row_id, F.coalesce("label", F.lit(-1)).alias("label")).join(again, [row_id]), "label", "again").first()[0]
            ok = quality["number_of_clusters"] >= 2 and quality["noise_percentage"] <= max_noise and quality["smallest_cluster_pct"] >= min_cluster
            plain = 1.0 / (1.0 + 0.08 * max(quality["number_of_clusters"] - 2, 0) + quality["noise_percentage"] / 100.0)
            rows.append((f"dbscan_eps_{eps:.5f}_min_{m}", None, eps, m, took, stable, plain, bool(ok), *quality))
    trials = checkpointed(selection_scores(df.sparkSession.createDataFrame(rows, TRIAL)))
    best = trials.orderBy(F.col("selection_score").desc(), "noise_percentage").first()
    return trials, {"eps": best["eps"], "min_samples": best["min_samples"]}


