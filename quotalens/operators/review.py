"""Review datasets: filters, drivers, queues, rep and model summaries, semantic tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from quotalens.functions import first_match, whole_count
from quotalens.functions.text import manager_label, plain_label, reason_code, recommended_action, short_number
from quotalens.operators import history as H
from quotalens.operators.aggregates import rate
from quotalens.operators.quality import require_no_labels, without_labels
from quotalens.operators.ranking import best_row, null_safe_join, percent_rank_average, row_numbers, top_n_per_group, unpivot, with_scalars


def category_filter(df: DataFrame, selections: Mapping[str, Sequence | None]) -> DataFrame:
    """Keep rows whose columns are among the selected values; an empty selection keeps all."""
    for c, values in selections.items():
        if values:
            df = df.filter(F.col(c).isin(*values))
    return df


def linked_filter(owners: DataFrame, allocation: DataFrame, selections: Mapping[str, Sequence | None], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Filter the allocation and keep the owners that still have a row in it."""
    kept = category_filter(allocation, selections)
    return owners.join(kept.select(*keys).distinct(), list(keys), "left_semi"), kept


PERIOD_NAMES = ("period", "date", "month")
ENTITY_NAMES = ("observation_id", "rep_id", "representative", "territory_id")


def infer_keys(clean: DataFrame, injected: DataFrame, truth: DataFrame) -> list[str]:
    """Entity and period columns shared by two layers and the truth table."""
    shared = [c for c in clean.columns if c in injected.columns and c in truth.columns]
    if "observation_id" in shared:
        return ["observation_id"]
    entity = next((c for c in ENTITY_NAMES if c in shared), None)
    period = next((c for c in PERIOD_NAMES if c in shared), None)
    if entity is None or period is None:
        raise ValueError(f"no common entity and period among {shared}")
    return [entity, period]


def top_drivers(contributions: DataFrame, row_id: str, feature: str, contribution: str, n: int = 3) -> DataFrame:
    """The n largest contributions per row, numbered; ties by feature name."""
    return top_n_per_group(contributions, [row_id], [F.col(contribution).desc(), F.col(feature)], n, "driver_rank")


def drivers_wide(drivers: DataFrame, row_id: str, feature: str, contribution: str, n: int = 3) -> DataFrame:
    pick = lambda i, c: F.max(F.when(F.col("driver_rank") == i, F.col(c)))
    out = drivers.groupBy(row_id).agg(*[
        x for i in range(1, n + 1) for x in (pick(i, feature).alias(f"top_driver_{i}_feature"), pick(i, contribution).alias(f"top_driver_{i}_contribution"))])
    return out.withColumns({f"top_driver_{i}": manager_label(f"top_driver_{i}_feature") for i in range(1, n + 1)})


def driver_explanations(drivers: DataFrame, values: DataFrame, row_id: str, feature: str = "feature", contribution: str = "contribution") -> DataFrame:
    """Value, peer value and percentile beside each driver, with reason code, sentence and action.

    ``values`` is long: (row_id, feature, value, peer_value, percentile).
    """
    d = drivers.join(values, [row_id, feature], "left").withColumn("name", plain_label(feature))
    first = F.when(
        F.col("peer_value").isNotNull(),
        F.concat(F.col("name"), F.lit(" was "), short_number("value"), F.lit(" versus a comparable-representative reference of "),
                 short_number("peer_value"), F.lit("; it was the largest PCA reconstruction deviation.")),
    ).otherwise(F.concat(F.col("name"), F.lit(" was the largest PCA reconstruction deviation (observed "), short_number("value"), F.lit(").")))
    second = F.concat(F.col("name"), F.lit(" was the next-largest reconstruction deviation (observed "), short_number("value"), F.lit(")."))
    return d.withColumn("reason", F.when(F.col("driver_rank") == 1, first).when(F.col("driver_rank") == 2, second)).withColumn(
        "reason_code", F.when(F.col("driver_rank") == 1, reason_code(feature))).withColumn(
        "recommended_review_action", F.when(F.col("driver_rank") == 1, recommended_action(feature)))


def values_with_percentiles(df: DataFrame, row_id: str, period: str, features: Sequence[str], peers: Mapping[str, str]) -> DataFrame:
    """Long (row_id, feature, value, peer_value, percentile); percentiles are same-period average-tie ranks."""
    long = unpivot(df, [row_id, period], features, "feature", "value")
    long = percent_rank_average(long, [period, "feature"], "value", "percentile")
    if not peers:
        return long.drop(period).withColumn("peer_value", F.lit(None).cast("double"))
    known = unpivot(df, [row_id], list(dict.fromkeys(peers.values())), "_peer", "peer_value")
    name = F.create_map(*[F.lit(x) for pair in peers.items() for x in pair])
    long = long.withColumn("_peer", F.element_at(name, F.col("feature")))
    return long.join(known, [row_id, "_peer"], "left").drop("_peer", period)


def strongest(df: DataFrame, row_id: str, value: str, name: str) -> DataFrame:
    """Per row the record with the largest absolute value; ties by name."""
    return best_row(df.filter(F.col(value).isNotNull()), [row_id], [-F.abs(F.col(value)), F.col(name)])


def scores_wide(long: DataFrame, row_id: str, model: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Pick (model, column) cells of the long score table into named columns."""
    return long.groupBy(row_id).agg(*[F.max(F.when(F.col(model) == m, F.col(c))).alias(out) for out, (m, c) in columns.items()])


SCORE_CELLS = {
    "pca_raw_score": ("PCA Reconstruction", "raw_score"), "pca_score_percentile": ("PCA Reconstruction", "anomaly_score"),
    "pca_review_flag": ("PCA Reconstruction", "anomaly_flag"), "pca_threshold_exceedance": ("PCA Reconstruction", "threshold_flag"),
    "pca_raw_threshold": ("PCA Reconstruction", "threshold"), "ewma_score": ("EWMA Residual", "anomaly_score"),
    "temporal_review_flag": ("EWMA Residual", "anomaly_flag"), "robust_peer_percentile": ("Robust Peer Baseline", "anomaly_score"),
    "robust_peer_flag": ("Robust Peer Baseline", "anomaly_flag"), "kmeans_distance": ("K-Means", "raw_score"),
    "kmeans_percentile": ("K-Means", "anomaly_score"), "isolation_forest_percentile": ("Isolation Forest", "anomaly_score"),
}


def review_dataset(source: DataFrame, scores: DataFrame, contributions: DataFrame, peers: DataFrame, temporal: DataFrame, rules: DataFrame,
                   very_high: float = 0.99, elevated: float = 0.95, support: int = 2) -> DataFrame:
    """One row per observation: scores, drivers, strongest evidence, rule summary, priority, agreement and rank."""
    if not 0 <= elevated <= very_high <= 1 or support < 1:
        raise ValueError("percentiles must satisfy 0 <= elevated <= very_high <= 1 and support be positive")
    key = "observation_id"
    series = ["representative", "product_class"]
    keep = [c for c in ("representative", "manager", "team", "country", "product_class", "date", "split", "total_sales", "total_quantity",
                        "transaction_count", "distinct_customers", "new_customers", "distinct_products", "simulated_actual_payout") if c in source.columns]
    prior = H.calendar_lag("distinct_customers", 1, series, "date")
    out = source.select(
        key, *keep, whole_count(F.col("distinct_customers") * F.col("repeat_customer_ratio")).alias("repeat_customers"),
        whole_count(prior * F.col("customer_loss_rate")).alias("lost_customers"),
        F.format_string("%d distributors; concentration index %.3f; mix change %.3f", F.col("distributor_count"), F.col("distributor_concentration"),
                        F.col("distributor_mix_change")).alias("distributor_mix_summary"))
    out = out.join(scores_wide(scores, key, "model_name", {n: c for n, c in SCORE_CELLS.items()}), [key], "left")
    out = out.join(drivers_wide(top_drivers(contributions, key, "feature", "contribution"), key, "feature", "contribution"), [key], "left")
    p = strongest(peers.select(key, "metric", "robust_z", "cohort"), key, "robust_z", "metric")
    out = out.join(p.select(key, manager_label("metric").alias("strongest_peer_deviation_metric"), F.col("robust_z").alias("strongest_peer_deviation_value"),
                            F.col("cohort").alias("peer_comparison_cohort")), [key], "left")
    history = [c for c in source.columns if c.endswith("_history_deviation")]
    h = strongest(unpivot(source, [key], history, "metric", "deviation"), key, "deviation", "metric")
    out = out.join(h.select(key, manager_label("metric").alias("strongest_history_deviation_metric"), F.col("deviation").alias("strongest_history_deviation_value")), [key], "left")
    t = strongest(temporal.filter(F.col("model") == "EWMA Residual"), key, "score", "metric")
    out = out.join(t.select(
        key, manager_label("metric").alias("temporal_metric"), F.col("observed").alias("temporal_observed"), F.col("expected").alias("temporal_expected"),
        F.when(F.col("available"), F.col("direction")).alias("temporal_direction"), F.col("history_length").alias("temporal_history_length")), [key], "left")
    r = rules.groupBy(key).agg(
        F.max("flag").alias("business_rule_flag"),
        F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.when(F.col("flag"), F.struct("rule_name", "explanation")))), lambda x: x["explanation"])).alias("business_rule_summary"))
    out = out.join(r, [key], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    signals = yes("temporal_review_flag").cast("int") + yes("robust_peer_flag").cast("int") + yes("business_rule_flag").cast("int")
    out = out.withColumn("number_of_supporting_signals", signals)
    high = yes("pca_review_flag") | ((F.col("pca_score_percentile") >= very_high) & (F.col("number_of_supporting_signals") >= 1))
    medium = (F.col("pca_score_percentile") >= elevated) | (F.col("number_of_supporting_signals") >= support)
    out = out.withColumn("review_priority", first_match([(high, "High"), (medium, "Medium")], "Low"))
    pca = yes("pca_review_flag") | yes("pca_threshold_exceedance") | (F.col("pca_score_percentile") >= elevated)
    names = F.array_compact(F.array(*[F.when(c, n) for n, c in (("PCA", pca), ("Peer", yes("robust_peer_flag")), ("Temporal", yes("temporal_review_flag")), ("Business Rule", yes("business_rule_flag")))]))
    joined = F.concat_ws(" + ", names)
    out = out.withColumn("model_agreement_summary", F.when(joined == "", "No elevated signals").when(joined == "PCA", "PCA only").otherwise(joined))
    return row_numbers(out, "pca_raw_score", key, "review_rank")


def rep_summary(anomaly: DataFrame, rollup: DataFrame) -> DataFrame:
    """Per representative as of the latest month: counts, strongest row, exact three-month sales."""
    rep = "representative"
    rank = F.when(F.col("review_priority") == "High", 1).when(F.col("review_priority") == "Medium", 2).otherwise(3)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = anomaly.groupBy(rep).agg(
        F.max("date").alias("latest_month"), F.count(F.lit(1)).alias("total_observations"), n(F.col("review_priority") == "High").alias("high_priority_review_count"),
        n(F.col("review_priority") == "Medium").alias("medium_priority_review_count"), n(yes("pca_review_flag")).alias("top_5_percent_review_count"),
        F.max("pca_score_percentile").alias("maximum_pca_percentile"), F.avg("pca_score_percentile").alias("mean_pca_percentile"),
        n(yes("temporal_review_flag")).alias("temporal_flag_count"), n(yes("business_rule_flag")).alias("business_rule_flag_count"),
        n(yes("robust_peer_flag")).alias("peer_flag_count"), n(F.col("number_of_supporting_signals") >= 2).alias("model_agreement_high_count"))
    latest = anomaly.withColumn("_rank", rank).join(base.select(rep, F.col("latest_month").alias("date")), [rep, "date"])
    head = latest.groupBy(rep).agg(
        F.max("pca_score_percentile").alias("latest_pca_percentile"), F.min("_rank").alias("_rank"),
        F.min_by("top_driver_1", F.struct(-F.col("pca_score_percentile"), F.col("product_class"))).alias("strongest_recent_driver"),
        F.array_distinct(F.flatten(F.collect_set(F.split("country", r"\|")))).alias("_countries"))
    head = head.select(
        rep, "latest_pca_percentile", "strongest_recent_driver", first_match([(F.col("_rank") == 1, "High"), (F.col("_rank") == 2, "Medium")], "Low").alias("latest_review_priority"),
        F.when(F.size("_countries") == 1, F.element_at("_countries", 1)).alias("primary_country"))
    past = rollup.join(base.select(rep, "latest_month"), [rep]).filter(F.col("date") <= F.col("latest_month"))
    total = past.groupBy(rep).agg(F.sum("total_sales").alias("total_sales"))
    w = past.withColumns({
        "recent_3m_sales": H.exact_window_sum("total_sales", 3, [rep], "date"), "prior_3m_sales": H.exact_window_sum("total_sales", 3, [rep], "date", -3),
        "_before": H.calendar_lag("distinct_customers", 3, [rep], "date")}).filter(F.col("date") == F.col("latest_month"))
    w = w.select(rep, "recent_3m_sales", "prior_3m_sales", F.col("distinct_customers").alias("unique_customers_latest"),
                 (F.col("distinct_customers") - F.col("_before")).alias("customer_change_3m"),
                 F.when(F.col("prior_3m_sales") != 0, (F.col("recent_3m_sales") - F.col("prior_3m_sales")) / F.abs("prior_3m_sales")).alias("sales_growth_3m"))
    return base.join(head, [rep]).join(total, [rep], "left").join(w, [rep], "left")


# Manager-facing label and role of each detector.
MODEL_LABELS = {
    "PCA Reconstruction": "Pattern deviation", "EWMA Residual": "Recent trend deviation", "Robust Peer Baseline": "Peer deviation",
    "Business Rules": "Business rule indicator", "K-Means": "Commercial behavior segment", "DBSCAN": "Local density deviation",
    "Autoencoder": "Nonlinear pattern deviation", "Isolation Forest": "Tree-based unusual pattern", "Rolling Residual": "Recent historical deviation",
    "Seasonal Residual": "Same-month historical deviation", "Change-Point / Level Shift": "Sustained change indicator", "Best Ensemble": "Combined comparison signal",
}
MODEL_ROLES = {
    "PCA Reconstruction": "Primary anomaly ranking", "K-Means": "Segmentation", "DBSCAN": "Density diagnostic", "EWMA Residual": "Temporal specialist",
    "Business Rules": "Transparent rule evidence", "Robust Peer Baseline": "Peer comparison", "Autoencoder": "Reconstruction comparator",
    "Isolation Forest": "Tree-based anomaly comparator", "Best Ensemble": "Benchmark comparator only", "Rolling Residual": "Temporal comparator",
    "Seasonal Residual": "Seasonal comparator", "Change-Point / Level Shift": "Sustained-change comparator",
}


def model_summary(benchmark: DataFrame, selected: str, model: str = "model") -> DataFrame:
    """Benchmark rows with their manager-facing label and role; the chosen model is the primary ranking."""
    label = F.element_at(F.create_map(*[F.lit(x) for p in MODEL_LABELS.items() for x in p]), F.col(model))
    role = F.element_at(F.create_map(*[F.lit(x) for p in MODEL_ROLES.items() for x in p]), F.col(model))
    chosen = F.col(model) == selected
    role = first_match([(chosen, "Primary anomaly ranking"), (F.col(model) == "PCA Reconstruction", "Reconstruction comparator")],
                       F.coalesce(role, F.lit("Benchmark comparator")))
    return benchmark.withColumn("manager_facing_label", F.coalesce(label, F.col(model))).withColumn(
        "selected_for_primary_use", chosen).withColumn("role", role)


def metric_by_model(metrics: DataFrame, model: str, names: Mapping[str, str], models: Sequence[str]) -> DataFrame:
    """Presentation table: one row per metric, one column per model."""
    long = unpivot(metrics, [model], list(names.values()), "_c", "value")
    label = F.create_map(*[F.lit(x) for n, c in names.items() for x in (c, n)])
    return long.withColumn("metric", F.element_at(label, F.col("_c"))).groupBy("metric").pivot(model, list(models)).agg(F.max("value"))


def metrics_long(metrics: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return unpivot(metrics, ids, values, "metric_name", "metric_value")


def manager_queue(scored: DataFrame, flag: str = "manager_review_flag", score: str = "anomaly_score", raw: str = "raw_score", row_id: str = "observation_id") -> DataFrame:
    """Flagged rows with priority, risk band and global rank, free of label columns."""
    risk = F.when(F.col(score) <= 0.95, "low").when(F.col(score) <= 0.99, "medium").otherwise("high")
    priority = first_match([(F.col(flag) & (F.col(score) >= 0.99), "High"), (F.col(flag), "Medium")], "Context only")
    ranked = row_numbers(scored.withColumn("risk_band", risk).withColumn("review_priority", priority), raw, row_id, "review_rank")
    return require_no_labels(without_labels(ranked.filter(F.col(flag))), "review queue")


def evidence(scored: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Benchmark-only: scored rows beside the rolled-up truth."""
    joined = scored.drop("ground_truth_label", "anomaly_type", "anomaly_category", "severity").join(truth, list(keys), "left")
    fill = {c: F.coalesce(F.col(c), F.lit("none")) for c in ("anomaly_type", "anomaly_category", "severity") if c in joined.columns}
    return joined.withColumns({**fill, "ground_truth_label": F.coalesce("ground_truth_label", F.lit(False))})


def kpi_row(orders: DataFrame, payouts: DataFrame, queue: DataFrame, scored: DataFrame, capacity: DataFrame, territories: DataFrame) -> DataFrame:
    """One row of headline totals."""
    o = orders.agg(F.sum("gross_sales").alias("total_gross_sales"), F.sum("net_sales").alias("total_net_sales"))
    p = payouts.agg(F.sum("final_incentive_paid").alias("total_incentive_paid"))
    q = queue.agg(F.count(F.lit(1)).alias("review_candidate_count"), F.sum(F.when(F.col("review_priority") == "High", 1).otherwise(0)).alias("high_priority_review_candidate_count"))
    s = scored.agg(F.count(F.lit(1)).alias("_n"))
    over = F.col("capacity_risk_band").isin("high", "critical")
    c = capacity.agg(F.count_distinct(F.when(over, F.col("rep_id"))).alias("overloaded_representative_count"),
                     F.sum(F.greatest(F.col("fte_gap"), F.lit(0.0))).alias("total_positive_fte_gap"))
    t = territories.agg(F.count_distinct(F.when(over, F.col("territory_id"))).alias("overloaded_territory_count"))
    out = o
    for row in (p, q, s, c, t):
        out = with_scalars(out, row)
    return out.withColumn("review_rate", F.col("review_candidate_count") / F.greatest(F.col("_n"), F.lit(1))).drop("_n")


def technical_queue(frame: DataFrame, long: DataFrame, temporal: DataFrame, selected: str, drivers: Sequence[str], temporal_models: Sequence[str], ensemble: str = "Best Ensemble") -> DataFrame:
    """Observation rows with the selected score, agreement count, three named drivers and the temporal expectation."""
    key = "observation_id"
    single = F.col("model_name") != ensemble
    s = long.groupBy(key).agg(
        F.max(F.when(F.col("model_name") == selected, F.col("anomaly_score"))).alias("selected_score"),
        F.max(F.when(F.col("model_name") == selected, F.col("raw_score"))).alias("selected_raw_score"),
        F.sum(F.when(single & F.col("anomaly_flag"), 1).otherwise(0)).alias("model_agreement_count"),
        F.max(F.when(F.col("model_name").isin(*temporal_models), F.col("anomaly_score"))).alias("temporal_score"))
    d = unpivot(frame, [key], drivers, "feature", "value").withColumn("_size", F.abs(F.coalesce("value", F.lit(0.0))))
    d = top_n_per_group(d, [key], [F.col("_size").desc(), F.col("feature")], 3, "driver_rank")
    text = F.format_string("%s=%.2f", F.col("feature"), F.coalesce("value", F.lit(0.0)))
    d = d.groupBy(key).agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("driver_rank", text.alias("t")))), lambda x: x["t"])).alias("top_drivers"))
    t = best_row(temporal.select(key, "metric", "model", "score", "observed", "expected"), [key], [-F.col("score"), F.col("metric"), F.col("model")])
    t = t.select(key, F.col("observed").alias("temporal_observed"), F.col("expected").alias("temporal_expected"), (F.col("observed") - F.col("expected")).alias("temporal_difference"))
    return frame.join(s, [key]).join(d, [key], "left").join(t, [key], "left")


def rep_risk(queue: DataFrame, keys: Sequence[str]) -> DataFrame:
    return queue.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.avg("selected_score").alias("mean_score"), F.max("selected_score").alias("max_score"))


def field_lineage(df: DataFrame, observed: Sequence[str], derived: Sequence[str], simulated: Sequence[str] = ()) -> DataFrame:
    """(field, lineage) for every column of a table."""
    kind = lambda c: "source_observed" if c in observed else "synthetic_derived" if c in derived else "synthetic_normal" if c in simulated else "derived"
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), kind(f.name)) for f in df.schema.fields], "field string, type string, lineage string")


def flag_rate_grid(df: DataFrame, period: str, group: str, groups: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(period).pivot(group, list(groups)).agg(rate(F.col(flag)))


def distance_explanations(contributions: DataFrame, values: DataFrame, row_id: str, cluster: str, n: int = 5) -> DataFrame:
    """Sentence per row from its largest centroid-distance shares.

    ``contributions``: (row_id, cluster, feature, share, residual); ``values``: (row_id, feature, value).
    """
    from quotalens.operators.ranking import quantiles
    long = contributions.join(values, [row_id, "feature"])
    medians = quantiles(long, [cluster, "feature"], "value", {"_median": 0.5})
    top = top_n_per_group(null_safe_join(long, medians, [cluster, "feature"], "left"), [row_id], [F.col("share").desc(), F.col("feature")], n, "driver_rank")
    side = F.when(F.col("residual") >= 0, "above").otherwise("below")
    text = F.format_string("%s %s cluster center (%.0f%% of centroid distance; cluster-median difference %,.2f)",
                           plain_label("feature"), side, F.col("share") * 100.0, F.col("value") - F.col("_median"))
    return top.groupBy(row_id).agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("driver_rank", text.alias("t")))), lambda x: x["t"])).alias("explanation"))


def density_explanations(distances: DataFrame, matrix: DataFrame, row_id: str, features: Sequence[str], min_samples: int, n: int = 5) -> DataFrame:
    """Sentence per row from its neighbour distance and its features' robust distance from the median.

    ``distances``: (row_id, distance); ``matrix``: row_id and one column per feature.
    """
    from quotalens.operators.metrics import ecdf_score
    from quotalens.operators.ranking import quantiles
    ranked = ecdf_score(distances, distances, [], "distance", "_pct")
    density = F.format_string(f"Low local density: {min_samples}-neighbor distance %.2f (%.0f%% percentile)", F.col("distance"), F.col("_pct") * 100)
    long = unpivot(matrix, [row_id], features, "feature", "value")
    q = quantiles(long, ["feature"], "value", {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75})
    gap = F.col("_q75") - F.col("_q25")
    long = null_safe_join(long, q, ["feature"], "left").withColumn("_dev", (F.col("value") - F.col("_q50")) / F.when(gap > 1e-9, gap).otherwise(1.0))
    top = top_n_per_group(long, [row_id], [F.abs(F.col("_dev")).desc(), F.col("feature")], max(1, n - 1), "driver_rank")
    text = F.format_string("%s %.1f robust units %s population median", plain_label("feature"), F.abs(F.col("_dev")), F.when(F.col("_dev") >= 0, "above").otherwise("below"))
    parts = top.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("driver_rank", text.alias("t")))), lambda x: x["t"]).alias("_t"))
    return ranked.select(row_id, density.alias("_d")).join(parts, [row_id], "left").select(row_id, F.concat_ws(" | ", F.col("_d"), F.col("_t")).alias("explanation"))

