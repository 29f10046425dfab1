"""Rep × product × territory × month segmentation benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quotalens.operators import clustering as K, features as X, metrics as M, reconstruction as RC
from quotalens.operators.joins import assign_representatives
from quotalens.operators.preprocess import fit_preprocessor
from quotalens.session import checkpointed

ORG = ("sales_team", "sales_manager", "territory_id")


def run(tx: DataFrame, ks: Sequence[int] = range(2, 13), reps_per_territory: int = 3, seed: int = 42, dbscan: bool = False) -> dict:
    """Assign customers to representatives, build the grain and features, cluster, score and explain."""
    assigned = assign_representatives(tx, list(ORG), "customer", reps_per_territory, seed).withColumnRenamed("assigned_rep", "rep_id")
    grain = checkpointed(X.legacy_grain(checkpointed(assigned)))
    store = checkpointed(X.legacy_features(grain))
    features = [c for c in X.feature_allowlist(store, ["latitude", "longitude"]) if c not in ("transaction_count",)]
    pre = fit_preprocessor(store, X.usable_features(store, features), clip=(0.01, 0.99))
    matrix = checkpointed(pre.transform(store))
    trials, k = K.tune_kmeans(matrix.select("row_id", "vector"), "row_id", list(ks), seed)
    model = K.fit_kmeans(matrix, k, seed)
    scored = K.distance_score(model.assign(matrix), model.assign(matrix))
    out = {"grain": grain, "features": store, "trials": trials, "model": model, "scored": checkpointed(scored), "checks": model.checks(matrix),
           "coordinates": RC.fit_pca(matrix, k=2).coordinates(matrix).select("row_id", "component_1", "component_2"),
           "contributions": model.contributions(matrix, pre.features, "row_id")}
    if dbscan:
        dtrials, best = K.tune_dbscan(matrix.select("row_id", "vector"), "row_id", [5, 8, 12, 16], [0.70, 0.82, 0.90, 0.94])
        labels = K.dbscan(matrix.select("row_id", "vector"), "row_id", best["eps"], best["min_samples"])
        out.update(dbscan_trials=dtrials, dbscan_labels=labels)
    return out


def model_selection(metrics: DataFrame, segmentation_weights: dict, anomaly_weights: dict, lower_is_better: Sequence[str] = ("davies_bouldin_score",), bounded: Sequence[str] = ("runtime_seconds",)) -> DataFrame:
    """Contribution rows of both selections, with the winner marked."""
    out = None
    for name, weights in (("segmentation_score", segmentation_weights), ("anomaly_score", anomaly_weights)):
        c = checkpointed(M.weighted_selection(metrics, "model", weights, lower_is_better, bounded))
        rows = c.join(M.selected_model(c, "model"), ["model"]).withColumn("selection_type", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


