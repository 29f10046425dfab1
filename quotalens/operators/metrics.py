"""Detection quality: confusion, ranking, curves, calibration, stability, ensembles, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.operators.ranking import (
    budget, null_safe_join, percent_rank_average, percent_ranks, positions, quantiles, row_numbers, unpivot, with_scalars,
)
from quotalens.operators.joins import interpolate

CUTOFFS = (0.01, 0.05, 0.10)


def _div(a, b) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


CELLS = ("true_positives", "false_positives", "false_negatives", "true_negatives")


def _confusion_sums(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    cells = (y & p, ~y & p, y & ~p, ~y & ~p)
    return [F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in zip(CELLS, cells)]


def _confusion_from(g: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    g = g.withColumn("precision", _div(tp, tp + fp)).withColumn("recall", _div(tp, tp + fn))
    fbeta = lambda b: _div((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    specificity = F.when(tn + fp > 0, tn / F.when(tn + fp > 0, tn + fp))
    both = (tp + fn > 0) & (tn + fp > 0)
    return (
        g.withColumn("f1", fbeta(1)).withColumn("f2", fbeta(2)).withColumn("specificity", specificity)
        .withColumn("balanced_accuracy", F.when(both, (F.col("recall") + F.col("specificity")) / 2.0))
        .withColumn("predicted_anomalies", tp + fp).withColumn("predicted_anomaly_pct", (tp + fp) / (tp + fp + fn + tn) * 100.0)
    )


def confusion_metrics(df: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Counts, precision, recall, F1, F2, specificity and balanced accuracy in one aggregate."""
    return _confusion_from(df.groupBy(*keys).agg(*_confusion_sums(label, predicted)))


def score_steps(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Per distinct score: rows and positives, and both cumulated from the highest score down.

    Everything downstream (AUC, average precision, curves) works on distinct scores.
    """
    d = df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("threshold"), F.when(F.col(label), 1).otherwise(0).alias("_y"))
    return positions(d, keys, "threshold", {"pos": "_y"}).select(
        *keys, "threshold", F.col("n_equal").alias("rows"), F.col("pos_equal").alias("positives"), F.col("n_total").alias("n"), F.col("pos_total").alias("p"),
        (F.col("n_total") - F.col("n_below")).alias("cum_rows"), (F.col("pos_total") - F.col("pos_below")).alias("cum_positives"))


def area_metrics(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC with half credit for ties, and average precision as a step sum."""
    pos, neg = F.col("positives"), F.col("rows") - F.col("positives")
    # Positives beat every negative below them; ties count half.
    below = (F.col("n") - F.col("p")) - (F.col("cum_rows") - F.col("cum_positives"))
    wins = F.sum(pos.cast("double") * (below + neg / 2.0))
    p, n = F.max("p"), F.max("n") - F.max("p")
    precision = F.col("cum_positives") / F.col("cum_rows")
    return steps.groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), wins / F.when((p > 0) & (n > 0), p.cast("double") * n)).alias("roc_auc"),
        F.when(p > 0, F.sum(F.col("positives") * precision) / F.when(p > 0, p)).alias("pr_auc"))


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, tie: str, cutoffs: Sequence[float] = CUTOFFS) -> DataFrame:
    """Precision, recall and lift in the exact top fraction, one row per cutoff, from one ranking."""
    ranked = row_numbers(df.select(*keys, label, score, tie), score, tie, "_rank", keys, size="_total")
    return _ranking_rows(ranked, keys, label, cutoffs)


def _ranking_rows(ranked: DataFrame, keys: Sequence[str], label: str, cutoffs: Sequence[float]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(float(c)).alias("review_fraction"), (F.col("_rank") <= budget(F.col("_total"), c)).alias("_top")) for c in cutoffs])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, t = F.col(label), F.col("_top")
    g = ranked.select(*keys, label, F.inline(cells)).groupBy(*keys, "review_fraction").agg(
        n(t).alias("review_count"), n(y).alias("positive_count"), n(y & t).alias("captured_count"), F.count(F.lit(1)).alias("_n"))
    precision = F.col("captured_count") / F.greatest(F.col("review_count"), F.lit(1))
    positive = F.col("positive_count")
    return g.select(
        *keys, "review_fraction", "review_count", "positive_count", "captured_count", precision.alias("precision"),
        F.when(positive > 0, F.col("captured_count") / F.when(positive > 0, positive)).alias("recall"),
        F.when(positive > 0, precision / F.when(positive > 0, positive / F.col("_n"))).alias("lift"))


def evaluate(df: DataFrame, keys: Sequence[str], label: str, score: str, tie: str, fraction: float = 0.05,
             predicted: str | None = None) -> DataFrame:
    """The shared metric row per group: confusion at the budget (or a given flag), areas and top-k ratios."""
    keys = list(keys)
    columns = list(dict.fromkeys([*keys, label, score, tie, *([predicted] if predicted else [])]))
    ranked = row_numbers(df.select(*columns), score, tie, "_rank", keys, size="_total")
    flag = predicted or "_flag"
    if predicted is None:
        ranked = ranked.withColumn("_flag", F.col("_rank") <= budget(F.col("_total"), fraction))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y = F.col(label)
    in_top = {c: F.col("_rank") <= budget(F.col("_total"), c) for c in CUTOFFS}
    tops = [x for c, t in in_top.items() for x in (n(t).alias(f"_k_{round(c * 100)}"), n(t & y).alias(f"_tp_{round(c * 100)}"))]
    base = _confusion_from(ranked.groupBy(*keys).agg(*_confusion_sums(label, flag), *tops))
    p, total = F.col("true_positives") + F.col("false_negatives"), sum((F.col(c) for c in CELLS), F.lit(0))
    for c in CUTOFFS:
        k, tp, tag = F.col(f"_k_{round(c * 100)}"), F.col(f"_tp_{round(c * 100)}"), f"{round(c * 100)}pct"
        precision = tp / F.greatest(k, F.lit(1))
        base = base.withColumns({
            f"precision_at_{tag}": precision, f"recall_at_{tag}": F.when(p > 0, tp / F.when(p > 0, p)),
            f"lift_at_{tag}": F.when(p > 0, precision / F.when(p > 0, p / total))}).drop(f"_k_{round(c * 100)}", f"_tp_{round(c * 100)}")
    base = base.withColumn("top_decile_capture", F.col("recall_at_10pct"))
    area = area_metrics(score_steps(df, keys, label, score), keys)
    return null_safe_join(base, area, keys, "inner") if keys else with_scalars(base, area)


def selection_utility(recall: str = "recall_at_5pct", pr: str = "pr_auc", f2: str = "f2") -> Column:
    return 0.4 * F.coalesce(F.col(recall), F.lit(0.0)) + 0.4 * F.coalesce(F.col(pr), F.lit(0.0)) + 0.2 * F.coalesce(F.col(f2), F.lit(0.0))


def roc_curve(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.select(*keys, "threshold", (F.col("cum_positives") / F.col("p")).alias("true_positive_rate"),
                        ((F.col("cum_rows") - F.col("cum_positives")) / (F.col("n") - F.col("p"))).alias("false_positive_rate"))


def pr_curve(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.select(*keys, "threshold", (F.col("cum_positives") / F.col("cum_rows")).alias("precision"), (F.col("cum_positives") / F.col("p")).alias("recall"))


def lift_curve(df: DataFrame, label: str, score: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per review rank: captured positives, precision, recall and lift so far."""
    keys = list(keys)
    order = F.struct((-F.col(score).cast("double")).alias("s"), F.col(tie).alias("t"))
    d = df.select(*keys, order.alias("_order"), F.when(F.col(label), 1).otherwise(0).alias("_y"))
    out = positions(d, keys, "_order", {"pos": "_y"}).select(
        *keys, (F.col("n_below") + 1).alias("review_rank"), (-F.col("_order.s")).alias(score), (F.col("pos_below") + F.col("pos_equal")).alias("captured_count"),
        F.col("pos_total").alias("_p"), F.col("n_total").alias("_n"))
    precision = F.col("captured_count") / F.col("review_rank")
    return out.select(
        *keys, "review_rank", (F.col("review_rank") / F.col("_n")).alias("review_fraction"), F.col(score).alias("threshold"), "captured_count",
        precision.alias("precision"), (F.col("captured_count") / F.col("_p")).alias("recall"), (precision / (F.col("_p") / F.col("_n"))).alias("lift"))


# --- calibration ----------------------------------------------------------------------------

def ecdf_score(df: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Fraction of reference values at or below each value."""
    both = reference.select(*keys, value, F.lit(1).alias("_ref")).unionByName(df.select(*keys, value, F.lit(0).alias("_ref")))
    pos = positions(both, keys, value, {"ref": "_ref"}).select(
        *keys, value, ((F.col("ref_below") + F.col("ref_equal")) / F.when(F.col("ref_total") > 0, F.col("ref_total"))).alias(out))
    return null_safe_join(df, pos, [*keys, value], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def fit_calibrator(train: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """Reference table (keys, raw, position, and per key: ends, their positions and the tail scale)."""
    keys = list(keys)
    pos = positions(train, keys, raw).select(
        *keys, raw, ((F.col("n_below") + F.col("n_equal") * 0.5) / (F.col("n_total") + 1)).alias("position"))
    ends = train.groupBy(*keys).agg(
        F.min(raw).alias("_low"), F.max(raw).alias("_high"),
        F.greatest(F.coalesce(F.stddev_pop(raw), F.lit(0.0)), (F.max(raw) - F.min(raw)) * 0.1, F.lit(1e-8)).alias("_tail"))
    rims = pos.groupBy(*keys).agg(F.min("position").alias("_low_position"), F.max("position").alias("_high_position"))
    extra = null_safe_join(ends, rims, keys, "inner") if keys else with_scalars(ends, rims)
    return null_safe_join(pos, extra, keys, "left") if keys else with_scalars(pos, extra)


def calibrate(df: DataFrame, calibrator: DataFrame, keys: Sequence[str], raw: str, out: str) -> DataFrame:
    """Training percentile of a raw score: linear inside, bounded and increasing beyond both ends."""
    keys = list(keys)
    inner = interpolate(df, calibrator, keys, raw, "position", "_inside")
    ends = calibrator.select(*keys, "_low", "_high", "_tail", "_low_position", "_high_position")
    if keys:
        ends = ends.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_low", "_high", "_tail", "_low_position", "_high_position")])
        joined = null_safe_join(inner, ends, keys, "left")
    else:
        joined = with_scalars(inner, ends.agg(*[F.max(c).alias(c) for c in ends.columns]))
    x = F.col(raw)
    above = 1 - (1 - F.col("_high_position")) / (1 + (x - F.col("_high")) / F.col("_tail"))
    below = F.col("_low_position") / (1 + (F.col("_low") - x) / F.col("_tail"))
    value = F.when(x > F.col("_high"), above).when(x < F.col("_low"), below).otherwise(F.col("_inside"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return joined.withColumn(out, clipped).drop("_inside", "_low", "_high", "_tail", "_low_position", "_high_position")


# --- stability, overlap, ensembles ----------------------------------------------------------

def score_stability(df: DataFrame, a: str, b: str, tie: str, fraction: float = 0.05) -> DataFrame:
    """Rank correlation of two score columns and the overlap of their top fractions (one row)."""
    pick = lambda c, name: row_numbers(df.select(tie, c), c, tie, "_r", size="_n").select(tie, (F.col("_r") <= budget(F.col("_n"), fraction)).alias(name))
    flagged = pick(a, "_fa").join(pick(b, "_fb"), [tie])
    overlap = flagged.agg((F.sum(F.when(F.col("_fa") & F.col("_fb"), 1.0).otherwise(0.0)) / F.greatest(F.sum(F.col("_fa").cast("int")), F.lit(1))).alias("queue_overlap"))
    ranked = percent_ranks(df.select(tie, a, b), [], {a: "_ra", b: "_rb"})
    return with_scalars(ranked.agg(F.corr("_ra", "_rb").alias("score_correlation")), overlap)


def overlap_matrix(long: DataFrame, model: str, flag: str, row_id: str, models: Sequence[str]) -> DataFrame:
    """Share of each model's flagged rows that another model flags too, for every pair of models."""
    sets = long.filter(F.col(flag)).groupBy(row_id).agg(F.collect_set(model).alias("_m"))  # bounded by the number of models
    counts = sets.agg(*[F.sum(F.when(F.array_contains("_m", a) & F.array_contains("_m", b), 1).otherwise(0)).alias(f"c{i}_{j}")
                        for i, a in enumerate(models) for j, b in enumerate(models)])
    cells = [F.struct(F.lit(a).alias("model"), F.lit(b).alias("other"),
                      (F.col(f"c{i}_{j}") / F.greatest(F.col(f"c{i}_{i}"), F.lit(1))).alias("overlap")) for i, a in enumerate(models) for j, b in enumerate(models)]
    return counts.select(F.inline(F.array(*cells)))


def spearman_matrix(long: DataFrame, model: str, row_id: str, score: str, models: Sequence[str]) -> DataFrame:
    """Rank correlations between all models' scores."""
    from quotalens.operators.aggregates import pearson_matrix
    ranked = percent_rank_average(long.select(model, row_id, score), [model], score, "_r")
    wide = ranked.groupBy(row_id).agg(*[F.max(F.when(F.col(model) == m, F.col("_r"))).alias(f"m{i}") for i, m in enumerate(models)])
    matrix = pearson_matrix(wide, [f"m{i}" for i in range(len(models))])
    name = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (f"m{i}", m)])
    return matrix.select(F.element_at(name, F.col("left_column")).alias("model"), F.element_at(name, F.col("right_column")).alias("other"), "correlation")


def ensemble_scores(long: DataFrame, row_id: Sequence[str], model: str, percentile: str, weights: Mapping[str, float], kind: str, out: str) -> DataFrame:
    """mean (equal_percentile, rank_average), consensus, maximum or weighted combination per row."""
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be nonnegative with a positive sum")
    p = F.col(percentile)
    chosen = long.filter(F.col(model).isin(*weights))
    if kind in ("equal_percentile", "rank_average"):
        value = F.avg(p)
    elif kind == "consensus":
        value = F.sum(F.when(p >= 0.95, 1.0).otherwise(0.0)) + F.avg(p) * 0.001
    elif kind == "maximum":
        value = F.max(p)
    elif kind == "weighted":
        total = float(sum(weights.values()))
        w = F.lit(0.0)
        for name, weight in weights.items():
            w = F.when(F.col(model) == name, weight / total).otherwise(w)
        value = F.sum(w * p)
    else:
        raise ValueError(kind)
    return chosen.groupBy(*row_id).agg(value.alias(out))


def minmax(c: str, keys: Sequence[str], higher_is_better: bool = True) -> Column:
    """0–1 scaling over a small table; constant columns become 0.5, missing values 0."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    low, high = F.min(c).over(w), F.max(c).over(w)
    scaled = F.when(high - low < 1e-12, 0.5).otherwise((F.col(c) - low) / F.when(high - low >= 1e-12, high - low))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, F.lit(0.0))))
    return scaled if higher_is_better else 1 - scaled


def weighted_selection(metrics: DataFrame, model: str, weights: Mapping[str, float], lower_is_better: Sequence[str] = (), bounded: Sequence[str] = ()) -> DataFrame:
    """Contribution rows (model, metric, raw, normalised, weight, contribution); weights must sum to one.

    ``bounded`` metrics (run times) use 1/(1+x) instead of min–max.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    long = unpivot(metrics, [model], list(weights), "metric", "raw_value")
    normal = minmax("raw_value", ["metric"])
    normal = F.when(F.col("metric").isin(list(lower_is_better) or [""]), 1 - normal).otherwise(normal)
    normal = F.when(F.col("metric").isin(list(bounded) or [""]), F.coalesce(1 / (1 + F.greatest(F.col("raw_value"), F.lit(0.0))), F.lit(0.0))).otherwise(normal)
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("metric") == name, float(value)).otherwise(weight)
    out = long.withColumn("normalised_value", normal).withColumn("weight", weight)
    return out.withColumn("weighted_contribution", F.col("normalised_value") * F.col("weight"))


def selected_model(contributions: DataFrame, model: str) -> DataFrame:
    total = contributions.groupBy(model).agg(F.sum("weighted_contribution").alias("selection_score"))
    best = total.agg(F.min_by(model, F.struct(-F.col("selection_score"), F.col(model))).alias("_best"))
    return with_scalars(total, best).withColumn("selected", F.col(model) == F.col("_best")).drop("_best")


def selection_overlap(df: DataFrame, keys: Sequence[str], period: str, entity: str, flag: str) -> DataFrame:
    """Per period: share of the previous observed period's selected entities selected again."""
    keys = list(keys)
    periods = df.select(*keys, period).distinct()
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(period)  # one row per month
    steps = periods.withColumn("_next", F.lead(period).over(w)).withColumn("_has_previous", F.lag(period).over(w).isNotNull())
    chosen = df.filter(F.col(flag)).select(*keys, period, entity).distinct()
    carried = null_safe_join(chosen, steps.select(*keys, period, "_next"), [*keys, period], "inner").filter(F.col("_next").isNotNull()).select(
        *keys, F.col("_next").alias(period), entity)
    kept = carried.withColumn("_prev", F.lit(1)).join(chosen.withColumn("_cur", F.lit(1)), [*keys, period, entity], "left")
    ratio = kept.groupBy(*keys, period).agg((F.sum(F.coalesce("_cur", F.lit(0))) / F.greatest(F.sum("_prev"), F.lit(1))).alias("_o"))
    out = null_safe_join(steps, ratio, [*keys, period], "left")
    return out.select(*keys, period, F.when(F.col("_has_previous"), F.coalesce("_o", F.lit(0.0))).alias("overlap"))


def period_stability(df: DataFrame, population: str, period: str, entity: str, raw: str, score: str, flag: str, label: str) -> DataFrame:
    """Score level, spread, review rate, selection overlap and precision / recall per period."""
    key = [population, period]
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, f = F.col(label), F.col(flag)
    base = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("observations"), F.avg(raw).alias("mean_raw_score"), F.stddev_pop(raw).alias("std_raw_score"),
        F.avg(score).alias("mean_score"), F.avg(F.when(f, 1.0).otherwise(0.0)).alias("review_rate"),
        F.avg(F.when(y, 1.0).otherwise(0.0)).alias("prevalence"), n(y & f).alias("_tp"), n(f).alias("_sel"), n(y).alias("_pos"))
    base = base.withColumn("precision", F.col("_tp") / F.greatest(F.col("_sel"), F.lit(1))).withColumn(
        "recall", F.when(F.col("_pos") > 0, F.col("_tp") / F.when(F.col("_pos") > 0, F.col("_pos")))).drop("_tp", "_sel", "_pos")
    base = null_safe_join(base, quantiles(df, key, raw, {"median_raw_score": 0.5}), key, "left")
    base = null_safe_join(base, quantiles(df, key, score, {"p95_score": 0.95}), key, "left")
    base = null_safe_join(base, selection_overlap(df, [population], period, entity, flag), key, "left")
    return base.withColumn("mean_score_change", F.col("mean_score") - F.lag("mean_score").over(W.partitionBy(population).orderBy(period)))


def group_detection(df: DataFrame, label: str, flag: str, top: str, list_columns: Sequence[str], organisation: Sequence[str]) -> DataFrame:
    """Detection by label category (``a|b`` lists exploded, positives only) and by organisational unit."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, f, t = F.col(label), F.col(flag), F.col(top)
    aggregates = [F.count(F.lit(1)).alias("observations"), n(y).alias("positive_support"), n(f).alias("selected_at_threshold"),
                  n(y & f).alias("captured_at_threshold"), n(~y & f).alias("false_positives_at_threshold"), n(y & t).alias("captured_at_top5pct")]
    out = None
    for c in list_columns:
        exploded = df.filter(y).withColumn("value", F.explode(F.split(F.coalesce(F.col(c), F.lit("none")), r"\|"))).filter(
            (F.col("value") != "") & ~F.lower("value").isin("none", "nan"))
        part = exploded.groupBy("value").agg(*aggregates).withColumn("grouping", F.lit(c)).withColumn("group_kind", F.lit("ground_truth"))
        out = part if out is None else out.unionByName(part)
    if organisation:
        from quotalens.operators.aggregates import grouping_sets
        sets = [[c] for c in organisation] + ([list(organisation)] if len(organisation) > 1 else [])
        org = grouping_sets(df, organisation, aggregates, sets)
        value = F.concat_ws(" / ", *[F.col(c).cast("string") for c in organisation])
        org = org.withColumn("value", value).withColumn("group_kind", F.lit("organization")).drop(*organisation)
        out = org if out is None else out.unionByName(org)
    organisational = F.col("group_kind") == "organization"
    positive = F.col("positive_support")
    safe = F.when(positive > 0, positive)
    return (
        out.withColumn("precision_at_threshold", F.when(organisational, F.col("captured_at_threshold") / F.greatest(F.col("selected_at_threshold"), F.lit(1))))
        .withColumn("recall_at_threshold", F.col("captured_at_threshold") / safe).withColumn("recall_at_top5pct", F.col("captured_at_top5pct") / safe)
        .withColumn("false_positives_at_threshold", F.when(organisational, F.col("false_positives_at_threshold")))
    )


def family_recall(df: DataFrame, keys: Sequence[str], kind: str, top: str, families: Mapping[str, Sequence[str]] | Column) -> DataFrame:
    """Support and recall at the budget per business family of anomaly types.

    ``families`` maps a family to its types, or is an array column of the families of a row.
    """
    match = families
    if not isinstance(families, Column):
        pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("kind")) for f, kinds in families.items() for k in kinds])
        match = F.transform(F.filter(pairs, lambda x: x["kind"] == F.col(kind)), lambda x: x["family"])
    exploded = df.withColumn("family", F.explode(match))
    return exploded.groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("support"), F.sum(F.when(F.col(top), 1).otherwise(0)).alias("captured"),
        F.avg(F.when(F.col(top), 1.0).otherwise(0.0)).alias("recall"))


def false_positive_review(df: DataFrame, label: str, flag: str, driver: str, score: str, row_id: str, examples: int = 5) -> DataFrame:
    """False positives by leading driver with score statistics and example ids."""
    fp = df.filter(F.col(flag) & ~F.col(label))
    base = fp.groupBy(driver).agg(F.count(F.lit(1)).alias("false_positives"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))
    from quotalens.operators.ranking import top_n_per_group
    shown = top_n_per_group(fp.select(driver, score, row_id), [driver], [F.col(score).desc(), F.col(row_id)], examples)
    shown = shown.groupBy(driver).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", row_id))), lambda x: x[row_id]).alias("_ids"))
    base = null_safe_join(base, quantiles(fp, [driver], score, {"median_score": 0.5}), [driver], "left")
    return null_safe_join(base, shown, [driver], "left").withColumn("examples", F.concat_ws("|", F.transform("_ids", lambda x: x.cast("string")))).drop("_ids")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table (one row)."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    both = cells.agg(pairs("_n").alias("_both"), F.sum("_n").alias("_total"))
    rows = cells.groupBy(a).agg(F.sum("_n").alias("_n")).agg(pairs("_n").alias("_rows"))
    cols = cells.groupBy(b).agg(F.sum("_n").alias("_n")).agg(pairs("_n").alias("_cols"))
    joined = with_scalars(with_scalars(both, rows), cols)
    expected = F.col("_rows") * F.col("_cols") / (F.col("_total") * (F.col("_total") - 1) / 2.0)
    maximum = (F.col("_rows") + F.col("_cols")) / 2.0
    gap = maximum - expected
    return joined.select(F.when(gap == 0, 1.0).otherwise((F.col("_both") - expected) / F.when(gap != 0, gap)).alias("adjusted_rand"))

