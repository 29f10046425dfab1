"""Rep × month review over the relational layer: capacity, features, fixed PCA, evaluation, review tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from quotalens.functions import split_label
from quotalens.operators import capacity as C, features as X, metrics as M, reconstruction as RC, review as V
from quotalens.operators.aggregates import score_histogram, truth_rollup
from quotalens.operators.preprocess import fit_preprocessor
from quotalens.operators.ranking import budget_threshold, top_fraction, with_scalars
from quotalens.session import checkpointed


def capacity_layer(tx: DataFrame, reps: DataFrame, customers: DataFrame, visits: DataFrame, rules: C.CapacityRules = C.CapacityRules()) -> dict[str, DataFrame]:
    calendar, covered = C.capacity_calendar(tx, reps, customers, visits, rules)
    calendar = checkpointed(calendar)
    allocation = checkpointed(C.territory_allocation(calendar, tx, visits, covered, rules))
    return {"capacity_calendar": calendar, "capacity_customer_drilldown": covered, "capacity_territory_allocation": allocation, "capacity_territory_summary": C.territory_summary(allocation, rules)}


def score_rows(frame: DataFrame, model: RC.PcaModel, calibrator: DataFrame, threshold: DataFrame, vector: str = "vector") -> DataFrame:
    """Raw score, training percentile and the frozen-threshold flag."""
    scored = with_scalars(M.calibrate(model.score(frame, vector), calibrator, [], "raw_score", "anomaly_score"), threshold)
    return scored.withColumns({"anomaly_percentile": F.col("anomaly_score") * 100, "threshold_flag": F.col("raw_score") >= F.col("raw_threshold"), "manager_review_flag": F.col("raw_score") >= F.col("raw_threshold")})


def fixed_pca(clean: DataFrame, injected: DataFrame, truth: DataFrame, features: Sequence[str], train_end: str, validation_end: str, review_fraction: float = 0.05,
              variance: float = 0.90, keys: Sequence[str] = ("rep_id", "period")) -> dict:
    """Fit on clean training rows, freeze the threshold on unlabelled validation rows, then join labels.

    Labels are first touched after the threshold exists.
    """
    keys = list(keys)
    split = lambda df: df.withColumn("split", split_label("period", train_end, validation_end))
    clean, injected = checkpointed(split(clean)), checkpointed(split(injected))
    train = clean.filter("split = 'train'")
    pre = fit_preprocessor(train, features)
    prepared = {"clean": checkpointed(pre.transform(clean)), "injected": checkpointed(pre.transform(injected))}
    model = RC.fit_pca(prepared["clean"].filter("split = 'train'"), variance=variance)
    calibrator = checkpointed(M.fit_calibrator(model.score(prepared["clean"].filter("split = 'train'")).select("raw_score"), [], "raw_score"))
    unlabelled = model.score(prepared["injected"].filter("split = 'validation'")).select("observation_id", "raw_score")
    threshold = checkpointed(budget_threshold(unlabelled, "raw_score", review_fraction).select(F.col("threshold").alias("raw_threshold"), F.col("review_count").alias("validation_review_count")))
    scores = {n: checkpointed(score_rows(p, model, calibrator, threshold)) for n, p in prepared.items()}
    labels = truth_rollup(truth, keys, "ground_truth_label", [c for c in ("anomaly_type", "anomaly_category", "severity") if c in truth.columns])
    labelled = scores["injected"].join(labels, keys, "left").withColumn("ground_truth_label", F.coalesce("ground_truth_label", F.lit(False)))
    labelled = checkpointed(labelled.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("anomaly_type", "anomaly_category", "severity") if c in labels.columns}))
    test = checkpointed(top_fraction(labelled.filter("split = 'test'"), "raw_score", "observation_id", 0.05, "top5_flag"))
    errors = model.errors(scores["injected"])
    contributions = RC.long_contributions(errors, "observation_id", list(features))
    drivers = V.top_drivers(contributions, "observation_id", "feature", "contribution", 3)
    peers = {f: p for f in features for p in (f"{f}_peer_median",) if p in injected.columns}
    steps = M.score_steps(test, [], "ground_truth_label", "raw_score")
    lists = [c for c in ("anomaly_type", "anomaly_category", "severity") if c in test.columns]
    organisation = [c for c in ("manager_id", "team_id", "territory_id") if c in test.columns]
    both = scores["clean"].withColumns({"population": F.lit("clean"), "ground_truth_label": F.lit(False)}).unionByName(labelled.withColumn("population", F.lit("injected")), allowMissingColumns=True)
    return {
        "preprocessor": pre, "model": model, "calibrator": calibrator, "threshold": threshold, "clean_scores": scores["clean"], "injected_scores": labelled,
        "metrics_summary": M.evaluate(test, [], "ground_truth_label", "raw_score", "observation_id", predicted="threshold_flag"),
        "top_k_metrics": M.ranking_metrics(test, [], "ground_truth_label", "raw_score", "observation_id"),
        "group_metrics": M.group_detection(test, "ground_truth_label", "threshold_flag", "top5_flag", lists, organisation),
        "period_stability": M.period_stability(checkpointed(both), "population", "period", "rep_id", "raw_score", "anomaly_score", "threshold_flag", "ground_truth_label"),
        "score_distributions": score_histogram(both, ["population", "split"], "anomaly_score", "raw_score", 20),
        "roc_curve": M.roc_curve(steps, []), "pr_curve": M.pr_curve(steps, []), "lift_curve": M.lift_curve(test, "ground_truth_label", "raw_score", "observation_id"),
        "explanations": V.driver_explanations(drivers, V.values_with_percentiles(injected, "observation_id", "period", list(features), peers), "observation_id"),
        "feature_contributions": drivers, "review_queue": V.manager_queue(scores["injected"]),
    }


def review(tables: Mapping[str, DataFrame], injected_tables: Mapping[str, DataFrame], truth: DataFrame, train_end: str, validation_end: str, review_fraction: float = 0.05) -> dict:
    """Feature stores of both layers, the fixed PCA and the review tables."""
    clean, features, peers = X.review_features(tables)
    injected, other, _ = X.review_features(injected_tables)
    if features != other:
        raise ValueError("the two layers have different features")
    clean, injected = checkpointed(clean), checkpointed(injected)
    usable = X.usable_features(clean.filter(F.col("period") <= F.to_date(F.lit(train_end))), features)
    result = fixed_pca(clean, injected, truth, usable, train_end, validation_end, review_fraction)
    return {**result, "clean_features": clean, "injected_features": injected, "feature_columns": features, "peer_comparison": peers}


def semantic_tables(result: Mapping, capacity: Mapping[str, DataFrame], orders: DataFrame, payouts: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Manager tables without labels, benchmark-only evidence, metrics and the headline row."""
    keys = ["rep_id", "period"]
    rolled = truth_rollup(truth, keys, "ground_truth_label", [c for c in ("anomaly_type", "anomaly_category", "severity") if c in truth.columns])
    queue = result["review_queue"]
    summary = result["metrics_summary"]
    numeric = [c for c, t in summary.dtypes if t in ("double", "bigint", "int")]
    return {
        "kpi_summary": V.kpi_row(orders, payouts, queue, result["injected_scores"], capacity["capacity_calendar"], capacity["capacity_territory_summary"]),
        "manager_review_queue": queue, "rep_period_summary": V.without_labels(result["injected_scores"].drop("vector")), "anomaly_evidence": V.evidence(result["injected_scores"].drop("vector"), rolled, keys),
        "feature_contributions": result["feature_contributions"], "capacity_summary": V.without_labels(capacity["capacity_calendar"]),
        "capacity_territory_summary": V.without_labels(capacity["capacity_territory_summary"]), "model_metrics": V.metrics_long(summary.withColumn("model", F.lit("PCA Reconstruction")), ["model"], numeric),
        "anomaly_type_metrics": result["group_metrics"],
    }
