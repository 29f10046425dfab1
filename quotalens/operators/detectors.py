"""Temporal, peer and rule detectors.

A series is one key's monthly rows; all temporal baselines use strictly earlier rows of it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.operators.history import array_mad, array_median, calendar_lag, repeated_flags, row_frame
from quotalens.operators.peers import peer_statistics
from quotalens.operators.ranking import unpivot

TEMPORAL_MODELS = ("Rolling Residual", "EWMA Residual", "Seasonal Residual", "Change-Point / Level Shift")


def prior_values(c: str, alpha: float, keys: Sequence[str], period: str) -> Column:
    """The earlier values that still weigh in an exponentially weighted mean: older ones weigh under 2^-60, less than rounding."""
    reach = 1 if alpha >= 1 else math.ceil(60 * math.log(2) / -math.log1p(-alpha))
    return F.collect_list(c).over(row_frame(keys, period, -reach, -1))


def ewma(values: Column, alpha: float) -> Column:
    """Exponentially weighted mean of an array, seeded by its first value; null for an empty one."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda mean, x: F.when(mean.isNull(), x).otherwise((1.0 - alpha) * mean + alpha * x))


def temporal_details(df: DataFrame, row_id: str, keys: Sequence[str], period: str, metrics: Sequence[str], window: int = 6,
                     min_history: int = 3, alpha: float = 0.3, drift: float = 0.5) -> DataFrame:
    """One row per (observation, metric, model): observed, expected, residuals, direction, score, availability."""
    long = unpivot(df, [row_id, *keys, period], metrics, "metric", "observed")
    series = [*keys, "metric"]
    order = W.partitionBy(*series).orderBy(period)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    before = order.rowsBetween(W.unboundedPreceding, -1)

    h = F.col("_h")
    long = long.withColumns({
        "_h": F.collect_list("observed").over(row_frame(series, period, -window, -1)),
        "history_length": F.count("observed").over(before),
        "_seasonal": calendar_lag("observed", 12, series, period),
        "_past": prior_values("observed", alpha, series, period)})
    long = long.withColumns({
        "_expected": array_median(h), "_mad": array_mad(h), "_enough": F.size(h) >= min_history,
        "_ewma": ewma(F.col("_past"), alpha)})
    long = long.withColumn("_scale", F.coalesce(F.greatest(1.4826 * F.col("_mad"), F.abs("_expected") * 0.1, F.lit(1.0)), F.lit(1.0)))
    long = long.withColumn("_residual", F.when(F.col("_enough"), (F.col("observed") - F.col("_expected")) / F.col("_scale")).otherwise(0.0))
    long = long.withColumns({
        "_up": F.sum(F.when(F.col("_enough"), F.col("_residual") - drift).otherwise(0.0)).over(so_far),
        "_down": F.sum(F.when(F.col("_enough"), -F.col("_residual") - drift).otherwise(0.0)).over(so_far),
        "_previous": F.lag(F.col("observed") - F.col("_expected")).over(order)})
    cusum = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(so_far))
    long = long.withColumns({"_cup": cusum("_up"), "_cdown": cusum("_down")})
    previous = F.when(F.col("history_length") > min_history, F.col("_previous") / F.col("_scale")).otherwise(0.0)
    level = F.when((F.col("_residual") * previous > 0) & (F.abs(previous) > 1), F.greatest("_cup", "_cdown")).otherwise(0.0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    trend = F.when(F.size(h) >= 6, (mean(F.slice(h, -3, 3)) - mean(F.slice(h, 1, F.size(h) - 3))) / F.col("_scale")).otherwise(0.0)

    o = F.col("observed")
    deviation = lambda e: F.abs(o - F.col(e)) / F.col("_scale")
    options = [
        (TEMPORAL_MODELS[0], "_expected", F.abs("_residual"), "point_anomaly"),
        (TEMPORAL_MODELS[1], "_ewma", F.when(F.col("_enough"), deviation("_ewma")).otherwise(0.0), "point_anomaly"),
        (TEMPORAL_MODELS[2], "_seasonal", F.coalesce(deviation("_seasonal"), F.lit(0.0)), "seasonal_anomaly"),
        (TEMPORAL_MODELS[3], "_expected", level, "level_shift"),
    ]
    rows = F.array(*[F.struct(
        F.lit(name).alias("model"), F.col(e).alias("expected"), (o - F.col(e)).alias("residual"), ((o - F.col(e)) / F.col("_scale")).alias("normalized_residual"),
        F.when(o > F.col(e), "up").otherwise("down").alias("direction"), F.lit(kind).alias("anomaly_type"), score.alias("score"),
        F.abs(trend).alias("trend_score"), (F.col("_enough") & F.col(e).isNotNull()).alias("available")) for name, e, score, kind in options])
    return long.select(row_id, *keys, period, "metric", "observed", "history_length", F.inline(rows))


def temporal_scores(details: DataFrame, row_id: str) -> DataFrame:
    """Long scores: per observation and model the largest metric score."""
    return details.groupBy(row_id, F.col("model").alias("model_name")).agg(F.max("score").alias("raw_score"))


def robust_peer(df: DataFrame, row_id: str, metrics: Sequence[str], levels: Mapping[str, Sequence[str]], minimum: int = 4) -> tuple[DataFrame, DataFrame]:
    """(scores, details): the largest absolute robust z over the metrics, and its evidence rows."""
    details = peer_statistics(df, row_id, metrics, levels, minimum)
    scores = details.groupBy(row_id).agg(F.max(F.abs("robust_z")).alias("raw_score")).withColumn("model_name", F.lit("Robust Peer Baseline"))
    return scores.select(row_id, "model_name", "raw_score"), details


def _positive(c) -> Column:
    return F.greatest(c if isinstance(c, Column) else F.col(c), F.lit(0.0))


def rule_definitions() -> dict[str, tuple[Column, str]]:
    """Severity (1 = flagged) and wording of the named rules."""
    c = F.col
    return {
        "payout_above_expected": (F.abs("simulated_payout_delta_pct") / 25, "DEMO payout differs from formula expectation"),
        "large_adjustment": (F.abs("simulated_adjustment") / F.greatest(c("simulated_expected_incentive"), F.lit(1.0)) / 0.25, "DEMO adjustment exceeds 25% of expected payout"),
        "payout_rising_sales_falling": (_positive("simulated_actual_payout_month_over_month_growth") * _positive(-c("total_sales_month_over_month_growth")) / 0.1,
                                        "DEMO payout growth accompanies commercial decline"),
        "payout_to_sales": (_positive(c("simulated_payout_to_sales_ratio") - 0.05) / 0.05, "DEMO payout exceeds 5% of net sales"),
        "attainment_without_coverage": (F.when(F.coalesce("customer_growth", F.lit(0.0)) <= 0, _positive(c("simulated_target_attainment_pct") - 150) / 100).otherwise(0.0),
                                        "High DEMO attainment without customer growth"),
        "single_customer_sales_spike": (_positive("total_sales_month_over_month_growth") * c("customer_concentration") / 0.25, "Sales growth is concentrated in few customers"),
        "product_concentration": (_positive(c("product_concentration") - 0.5) / 0.5, "High product concentration"),
        "coverage_expansion": (_positive("customer_growth") / 0.5, "Sudden customer expansion"),
    }


def business_rules(df: DataFrame, row_id: str, keys: Sequence[str], period: str) -> tuple[DataFrame, DataFrame]:
    """(scores, details) of the eight rules and the repeated-period rule."""
    rules = rule_definitions()
    # Missing inputs make a growth-based severity zero; GREATEST would otherwise skip the null.
    guard = {
        "payout_rising_sales_falling": ["simulated_actual_payout_month_over_month_growth", "total_sales_month_over_month_growth"],
        "single_customer_sales_spike": ["total_sales_month_over_month_growth"], "coverage_expansion": ["customer_growth"],
    }
    def severity(name, value):
        for c in guard.get(name, []):
            value = F.when(F.col(c).isNotNull(), value)
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(n).alias("rule_name"), severity(n, s).alias("severity"), F.lit(t).alias("explanation")) for n, (s, t) in rules.items()])
    base = df.select(row_id, *keys, period, cells.alias("_rules"))
    worst = F.array_max(F.transform("_rules", lambda r: r["severity"] / (1 + r["severity"])))
    base = base.withColumn("_score", worst).withColumn("_flag", F.col("_score") >= 0.5)
    base = base.withColumn("_repeat", repeated_flags("_flag", 3, keys, period))
    repeat = F.struct(F.lit("repeated_unusual_periods").alias("rule_name"), (F.col("_repeat") >= 2).alias("flag"), (F.col("_repeat") / 3.0).alias("normalized_severity"),
                      F.lit("Repeated prior rule-triggering periods (not confirmed misconduct)").alias("explanation"))
    shaped = F.transform("_rules", lambda r: F.struct(r["rule_name"].alias("rule_name"), (r["severity"] >= 1).alias("flag"),
                                                      (r["severity"] / (1 + r["severity"])).alias("normalized_severity"), r["explanation"].alias("explanation")))
    details = base.select(row_id, F.inline(F.concat(shaped, F.array(repeat))))
    scores = base.select(row_id, F.lit("Business Rules").alias("model_name"), F.greatest(F.col("_score"), F.col("_repeat") / 3.0).alias("raw_score"))
    return scores, details


def score_contract(raw: DataFrame, frame: DataFrame, row_id: str, period: str, split: str, population: str, fraction: float = 0.05) -> DataFrame:
    """The long score table: calibrated percentile, training threshold and the exact budget per split.

    ``raw``: (row_id, model_name, raw_score); ``frame`` supplies period and split label.
    """
    from quotalens.operators.metrics import calibrate, fit_calibrator
    from quotalens.operators.ranking import null_safe_join, quantiles, top_fraction
    long = raw.join(frame.select(row_id, period, split), [row_id])
    train = long.filter(F.col(split) == "train")
    calibrator = fit_calibrator(train, ["model_name"], "raw_score")
    out = calibrate(long, calibrator, ["model_name"], "raw_score", "anomaly_score")
    cut = quantiles(train, ["model_name"], "raw_score", {"threshold": 1 - fraction})
    out = null_safe_join(out, cut, ["model_name"], "left")
    out = out.withColumn("threshold_flag", F.col("raw_score") > F.col("threshold")).withColumn("anomaly_percentile", F.col("anomaly_score") * 100).withColumn("population", F.lit(population))
    return top_fraction(out, "raw_score", row_id, fraction, "anomaly_flag", ["model_name", split])
