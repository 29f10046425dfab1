"""Rep × class × month review: population, features, controlled copy, detectors, choice, queues, staffing.

Stages hand over materialised tables (checkpoints), because each is read by several later ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from quotalens.functions import split_label
from quotalens.operators import aggregates as A, clustering as K, detectors as D, features as X, injection as I, metrics as M, planning as P, reconstruction as RC, review as V
from quotalens.operators.forest import fit_isolation_forest
from quotalens.operators.preprocess import Preprocessor, fit_preprocessor
from quotalens.session import checkpointed

KEEP_CONSTANT = ("simulated_adjustment", "simulated_payout_delta", "simulated_payout_delta_pct")
TEMPORAL_WEIGHTS_SLOT, RECONSTRUCTION_SLOT = "temporal", "reconstruction"


@dataclass
class ExtendedConfig:
    train_end: str = "2018-06-01"
    validation_end: str = "2018-12-01"
    seed: int = 42
    injection_rate: float = 0.06
    review_fraction: float = 0.05
    minimum_peers: int = 4
    pca_variance: Sequence[float] = (0.8, 0.9, 0.95)
    kmeans_k: Sequence[int] = tuple(range(2, 13))
    forest: Sequence[Mapping] = ({"trees": 200, "feature_share": 0.7}, {"trees": 200, "feature_share": 1.0})
    dbscan: bool = False
    dbscan_grid: Sequence[tuple[int, float]] = ((5, 0.9), (12, 0.9))
    correlation_limit: float = 0.95
    material_recall: float = 0.03
    material_pr_auc: float = 0.02
    ensemble_weights: Mapping[str, float] = field(default_factory=lambda: {"Isolation Forest": 0.30, "temporal": 0.20, "Robust Peer Baseline": 0.20, "reconstruction": 0.15, "Business Rules": 0.15})


def feature_layers(tx: DataFrame, config: ExtendedConfig) -> dict:
    """Population, demonstration payouts, the feature store and its controlled copy."""
    tx = checkpointed(tx)
    population = checkpointed(X.class_population(tx))
    demo = checkpointed(X.demo_incentives(population).withColumn("split", split_label("date", config.train_end, config.validation_end)))
    clean, features = X.extended_features(demo, config.minimum_peers)
    marked = checkpointed(I.inject(demo, "observation_id", "split", config.injection_rate, config.seed, series=["representative", "product_class"]).frame)
    labels = marked.select("observation_id", "injected_anomaly_flag", "anomaly_type", "severity")
    bench, _ = X.extended_features(marked.drop("injected_anomaly_flag", "anomaly_type", "severity"), config.minimum_peers)
    return {"transactions": tx, "population": population, "demo": demo, "clean": checkpointed(clean), "bench": checkpointed(bench), "labels": checkpointed(labels), "features": features}


@dataclass
class Fitted:
    preprocessor: Preprocessor
    models: dict
    trials: list[dict]


def model_scores(name: str, model, df: DataFrame) -> DataFrame:
    """(observation_id, model_name, raw_score) of one fitted model on prepared vectors."""
    if name == "K-Means":
        out = model.assign(df).withColumnRenamed("distance", "raw_score")
    else:
        out = model.score(df)
    return out.select("observation_id", F.lit(name).alias("model_name"), "raw_score")


def tune(layers: Mapping, config: ExtendedConfig) -> Fitted:
    """Fit every candidate on clean training rows, keep the best per family by validation utility.

    K-Means is chosen by silhouette, balance and size limits on clean validation rows; without a
    candidate inside the limits the best diagnostic one is kept.
    """
    train = layers["clean"].filter("split = 'train'")
    usable = X.usable_features(train, layers["features"], KEEP_CONSTANT)
    pre = fit_preprocessor(train, usable, log=True)
    prepared = {n: checkpointed(pre.transform(layers[n]).select("observation_id", "split", "vector")) for n in ("clean", "bench")}
    fit_rows = prepared["clean"].filter("split = 'train'")
    check = prepared["bench"].filter("split = 'validation'").join(layers["labels"], ["observation_id"])
    calm = prepared["clean"].filter("split = 'validation'")
    candidates = [("PCA Reconstruction", {"variance": v}, lambda v=v: RC.fit_pca(fit_rows, variance=v)) for v in config.pca_variance]
    candidates += [("Isolation Forest", dict(f), lambda f=f: fit_isolation_forest(fit_rows, "observation_id", seed=config.seed, **f)) for f in config.forest]
    candidates += [("K-Means", {"k": k}, lambda k=k: K.fit_kmeans(fit_rows, k, config.seed)) for k in config.kmeans_k]
    best: dict = {}
    trials = []
    for name, params, fit in candidates:
        model = fit()
        row = M.evaluate(checkpointed(model_scores(name, model, check).join(layers["labels"], ["observation_id"])), [], "injected_anomaly_flag", "raw_score", "observation_id", config.review_fraction)
        scored = row.withColumn("utility", M.selection_utility()).first().asDict()
        utility, eligible = scored["utility"], True
        if name == "K-Means":
            sizes = [r["n"] for r in model.assign(fit_rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()]
            shares = [s / sum(sizes) for s in sizes]
            q = K.clustering_quality(model.assign(calm), "observation_id", "cluster", sample=1200).first()
            eligible = len(shares) >= 2 and min(shares) >= 0.01 and max(shares) <= 0.9
            utility = 0.6 * (q["silhouette_score"] if q["silhouette_score"] is not None else -1.0) + 0.3 * (1 - max(shares))
        trials.append({"model": name, "parameters": str(params), "eligible": eligible, "selection_utility": utility})
        if name not in best or (eligible, utility) > best[name][0]:
            best[name] = ((eligible, utility), model)
    return Fitted(pre, {n: m for n, (_, m) in best.items()}, trials)


def population_scores(frame: DataFrame, fitted: Fitted) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Raw scores of all detectors on one population, and the evidence tables."""
    key = ["representative", "product_class"]
    vectors = checkpointed(fitted.preprocessor.transform(frame).select("observation_id", "vector"))
    details = checkpointed(D.temporal_details(frame, "observation_id", key, "date", X.EXTENDED_METRICS))
    peer, peers = D.robust_peer(frame, "observation_id", X.EXTENDED_METRICS, X.EXTENDED_LEVELS)
    rule, rules = D.business_rules(frame, "observation_id", key, "date")
    raw = D.temporal_scores(details, "observation_id").unionByName(peer).unionByName(rule)
    for name, model in fitted.models.items():
        raw = raw.unionByName(model_scores(name, model, vectors))
    return checkpointed(raw), {"temporal": details, "peers": checkpointed(peers), "rules": checkpointed(rules), "vectors": vectors}


def choose_ensemble(scores: DataFrame, labels: DataFrame, config: ExtendedConfig) -> tuple[dict, DataFrame]:
    """Fill the role slots by validation utility, drop near-duplicates, try combinations and boosts.

    Returns the choice (kind, weights, members) and the comparison rows.
    """
    val = checkpointed(scores.filter("split = 'validation'").join(labels, ["observation_id"]))
    single = M.evaluate(val, ["model_name"], "injected_anomaly_flag", "raw_score", "observation_id", config.review_fraction).withColumn("utility", M.selection_utility())
    utility = {r["model_name"]: r["utility"] for r in single.collect()}  # one row per model
    pick = lambda names: max((n for n in names if n in utility), key=utility.get)
    temporal, reconstruction = pick(D.TEMPORAL_MODELS), pick(("PCA Reconstruction", "K-Means"))
    slot = {TEMPORAL_WEIGHTS_SLOT: temporal, RECONSTRUCTION_SLOT: reconstruction}
    weights = {slot.get(n, n): w for n, w in config.ensemble_weights.items() if slot.get(n, n) in utility}
    matrix = {(r["model"], r["other"]): r["correlation"] for r in M.spearman_matrix(val, "model_name", "observation_id", "anomaly_score", list(weights)).collect()}
    dropped: list[str] = []
    for a, b in itertools.combinations(list(weights), 2):
        if a in dropped or b in dropped or (matrix.get((a, b)) or 0.0) <= config.correlation_limit:
            continue
        loser = a if utility[a] < utility[b] else b
        if loser != "Business Rules":
            dropped.append(loser)
    weights = {n: w for n, w in weights.items() if n not in dropped}
    variants = [(k, weights) for k in ("equal_percentile", "consensus", "maximum", "weighted")]
    variants += [("weighted", {n: w * (2 if n == boost else 1) for n, w in weights.items()}) for boost in weights]
    tried = None
    for i, (kind, w) in enumerate(variants):
        e = M.ensemble_scores(val, ["observation_id", "injected_anomaly_flag"], "model_name", "anomaly_score", w, kind, "raw_score").withColumn("option", F.lit(i))
        tried = e if tried is None else tried.unionByName(e)
    table = M.evaluate(checkpointed(tried), ["option"], "injected_anomaly_flag", "raw_score", "observation_id", config.review_fraction).withColumn("utility", M.selection_utility())
    rows = {r["option"]: r for r in table.collect()}
    best = max(rows, key=lambda i: rows[i]["utility"])
    kind, w = variants[best]
    leader = max((n for n in utility if n != "Business Rules"), key=utility.get)
    alone = {r["model_name"]: r for r in single.collect()}[leader]
    gain = (rows[best]["recall_at_5pct"] or 0) >= (alone["recall_at_5pct"] or 0) + config.material_recall and (rows[best]["pr_auc"] or 0) >= (alone["pr_auc"] or 0) + config.material_pr_auc
    return {"kind": kind, "weights": w, "best_temporal": temporal, "reconstruction": reconstruction, "dropped": dropped, "best_single": leader,
            "selected": "Best Ensemble" if gain else leader, "material_gain": bool(gain)}, table


def run(tx: DataFrame, config: ExtendedConfig = ExtendedConfig()) -> dict:
    """The whole review over one transaction table; returns tables and the frozen choice."""
    layers = feature_layers(tx, config)
    fitted = tune(layers, config)
    out: dict = {"layers": layers, "trials": fitted.trials}
    contracts = {}
    for name in ("bench", "clean"):
        raw, evidence = population_scores(layers[name], fitted)
        out[f"{name}_evidence"] = evidence
        contracts[name] = checkpointed(D.score_contract(raw, layers[name], "observation_id", "date", "split", name, config.review_fraction))
    choice, out["ensemble_comparison"] = choose_ensemble(contracts["bench"], layers["labels"], config)
    out["choice"] = choice
    for name, long in contracts.items():
        e = M.ensemble_scores(long, ["observation_id"], "model_name", "anomaly_score", choice["weights"], choice["kind"], "raw_score").withColumn("model_name", F.lit("Best Ensemble"))
        combined = D.score_contract(e, layers[name], "observation_id", "date", "split", name, config.review_fraction)
        out[f"{name}_scores"] = checkpointed(long.unionByName(combined.select(*long.columns)))
    test = out["bench_scores"].filter("split = 'test'").join(layers["labels"], ["observation_id"])
    out["test_metrics"] = M.evaluate(checkpointed(test), ["model_name"], "injected_anomaly_flag", "raw_score", "observation_id", config.review_fraction)
    out["queue"] = V.technical_queue(layers["clean"], out["clean_scores"], out["clean_evidence"]["temporal"], choice["selected"], [
        "total_sales_peer_z", "distinct_customers_peer_z", "total_sales_history_deviation", "simulated_actual_payout_history_deviation", "simulated_payout_delta_pct", "product_mix_change"], D.TEMPORAL_MODELS)
    errors = fitted.models["PCA Reconstruction"].errors(out["clean_evidence"]["vectors"])
    out["contributions"] = checkpointed(RC.long_contributions(errors, "observation_id", fitted.preprocessor.features))
    ev = out["clean_evidence"]
    out["review"] = V.review_dataset(layers["clean"], out["clean_scores"], out["contributions"], ev["peers"], ev["temporal"], ev["rules"])
    rollup = A.sales_grain(layers["transactions"], ["representative", "date"], {"distinct_customers": "customer"})
    out["rep_month_rollup"] = rollup
    out["rep_summary"] = V.rep_summary(checkpointed(out["review"]), rollup)
    out["model_summary"] = V.model_summary(out["test_metrics"].withColumnRenamed("model_name", "model"), choice["selected"])
    return out


PLAN_WEIGHTS = {"distinct_customers": 0.40, "transaction_count": 0.25, "distinct_cities": 0.15, "distinct_products": 0.10, "distributor_count": 0.10}
PLAN_METRICS = ["total_sales", "distinct_customers", "transaction_count", "distinct_products", "distinct_cities", "distributor_count"]


def plan_capacity(tx: DataFrame, config: ExtendedConfig = ExtendedConfig(), unit: Sequence[str] = ("team", "country", "product_class"), rep: str = "representative", period: str = "date") -> dict[str, DataFrame]:
    """Forecasts, staffing plan, scenarios and one transfer per business unit."""
    unit = list(unit)
    d = lambda c, n: F.count_distinct(c).cast("double").alias(n)
    agg = lambda keys: tx.groupBy(*keys).agg(
        F.sum("sales").alias("total_sales"), d("customer", "distinct_customers"), F.count(F.lit(1)).cast("double").alias("transaction_count"), d("product", "distinct_products"),
        d("city", "distinct_cities"), d("distributor", "distributor_count"))
    reps = checkpointed(P.workload_index(agg([rep, *unit, period]), PLAN_WEIGHTS, F.col(period) <= F.to_date(F.lit(config.train_end))))
    units = checkpointed(agg([*unit, period]).join(reps.groupBy(*unit, period).agg(F.sum("workload").alias("workload")), [*unit, period]))
    tested = checkpointed(P.backtest(units, unit, period, [*PLAN_METRICS, "workload"], config.train_end, config.validation_end))
    errors = checkpointed(P.backtest_metrics(tested))
    per_rep = reps.groupBy(rep, period).agg(F.sum("workload").alias("workload"))
    capacity = checkpointed(P.sustainable_capacity(per_rep, rep, period, "workload", config.train_end))
    allocation = checkpointed(P.fte_allocation(reps, rep, period, "workload", reps.agg(F.max(period).alias("latest"))))
    plan = checkpointed(P.unit_plan(units, unit, period, tested, P.best_methods(errors), capacity, allocation, PLAN_METRICS, config.train_end, rep))
    scenarios = P.scenarios(plan, unit).unionByName(P.reallocation(plan, unit, "team"), allowMissingColumns=True)
    base = P.capacity_base(plan, unit, errors, units.select(*unit, period, "workload"), period)
    return {"plan": plan, "scenarios": scenarios, "assumptions": capacity, "backtest": tested, "metrics": errors, "allocation": allocation, "base": base,
            "checks": P.capacity_base_checks(base, allocation, unit, rep)}
