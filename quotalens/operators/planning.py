"""Workload forecasts, backtests, sustainable capacity, staffing need and scenarios per business unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.functions import first_match, split_label
from quotalens.operators import history as H
from quotalens.operators.aggregates import forecast_errors
from quotalens.operators.detectors import ewma, prior_values
from quotalens.operators.joins import coverage_check
from quotalens.operators.quality import all_rows, check_row, reconciliation, union_all
from quotalens.operators.ranking import null_safe_join, quantiles, unpivot, with_scalars, with_totals

METHODS = ("seasonal_naive", "moving_average", "exponential_smoothing")


def one_step_forecasts(df: DataFrame, keys: Sequence[str], period: str, c: str, alpha: float = 0.3) -> DataFrame:
    """For every row the three forecasts made from earlier rows (never below zero, 0 without history)."""
    df = df.withColumn("_past", prior_values(c, alpha, keys, period))
    mean3 = F.avg(c).over(H.row_frame(keys, period, -3, -1))
    floor = lambda e: F.greatest(F.coalesce(e, F.lit(0.0)), F.lit(0.0))
    return df.withColumns({
        "seasonal_naive": floor(F.coalesce(H.calendar_lag(c, 12, keys, period), mean3)), "moving_average": floor(mean3), "exponential_smoothing": floor(ewma(F.col("_past"), alpha))}).drop("_past")


def backtest(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str], train_end: str, validation_end: str) -> DataFrame:
    """Rolling-origin one-month forecasts: (keys, period, metric, method, split, observed, prediction)."""
    long = unpivot(df, [*keys, period], metrics, "metric", "observed")
    f = one_step_forecasts(long, [*keys, "metric"], period, "observed")
    f = f.withColumn("split", split_label(period, train_end, validation_end)).filter(F.col("split") != "train")
    return f.unpivot([*keys, period, "metric", "split", "observed"], list(METHODS), "method", "prediction")


def backtest_metrics(tested: DataFrame) -> DataFrame:
    return forecast_errors(tested, ["metric", "method", "split"], "observed", "prediction")


def best_methods(metrics: DataFrame) -> DataFrame:
    """Per metric the method with the lowest validation WAPE (ties by name)."""
    v = metrics.filter(F.col("split") == "validation")
    return v.groupBy("metric").agg(F.min_by("method", F.struct("wape", "method")).alias("method"))


def next_month_forecasts(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str], chosen: DataFrame, latest: DataFrame) -> DataFrame:
    """(keys, metric, forecast) for the month after ``latest`` (one row, column latest) with the chosen methods."""
    ahead = with_scalars(df.groupBy(*keys).agg(F.max(period).alias("_last")), latest).filter(F.col("_last") == F.col("latest"))
    future = ahead.select(*keys, F.add_months("latest", 1).alias(period), *[F.lit(None).cast("double").alias(m) for m in metrics])
    real = df.join(ahead.select(*keys), list(keys), "left_semi").select(*keys, period, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = real.unionByName(future).unpivot([*keys, period], list(metrics), "metric", "observed")
    f = with_scalars(one_step_forecasts(long, [*keys, "metric"], period, "observed"), latest).filter(F.col(period) > F.col("latest"))
    f = f.join(chosen, ["metric"], "left")
    value = first_match([(F.col("method") == m, F.col(m)) for m in METHODS], F.lit(None).cast("double"))
    return f.select(*keys, "metric", "method", value.alias("forecast"))


def workload_index(df: DataFrame, weights: Mapping[str, float], train: Column) -> DataFrame:
    """Weighted sum of metric over its training median (at least 1)."""
    long = unpivot(df.filter(train), [], list(weights), "m", "v")
    q = quantiles(long, ["m"], "v", {"q": 0.5})
    scales = q.agg(*[F.greatest(F.coalesce(F.max(F.when(F.col("m") == m, F.col("q"))), F.lit(1.0)), F.lit(1.0)).alias(f"_{m}") for m in weights])
    out = with_scalars(df, scales)
    return out.withColumn("workload", sum((F.lit(float(w)) * F.col(m) / F.col(f"_{m}") for m, w in weights.items()), F.lit(0.0))).drop(*[f"_{m}" for m in weights])


def sustainable_capacity(rep_month: DataFrame, rep: str, period: str, workload: str, train_end: str, limit: float = 0.5,
                         probabilities: Mapping[str, float] | None = None, least: int = 10) -> DataFrame:
    """Quantiles of stable training months (|growth| <= limit); all training months if fewer than ``least`` (one row)."""
    p = probabilities or {"capacity": 0.6, "capacity_low": 0.4, "capacity_high": 0.8}
    w = W.partitionBy(rep).orderBy(period)
    growth = F.try_divide(F.col(workload) - F.lag(workload).over(w), F.lag(workload).over(w))
    train = rep_month.withColumn("_growth", growth).filter(F.col(period) <= F.to_date(F.lit(train_end)))
    train = train.withColumn("_stable", F.coalesce(F.abs("_growth") <= limit, F.lit(False)))
    counted = train.agg(F.sum(F.col("_stable").cast("long")).alias("stable_rows"))
    kept = with_scalars(train, counted).filter(F.col("_stable") | (F.col("stable_rows") < least))
    return with_scalars(quantiles(kept, [], workload, p), counted).withColumn("fallback", F.col("stable_rows") < least)


def fte_allocation(rep_units: DataFrame, rep: str, period: str, workload: str, latest: DataFrame) -> DataFrame:
    """One FTE per representative active in the latest month, split by that month's workload."""
    now = with_scalars(rep_units, latest).filter(F.col(period) == F.col("latest")).drop("latest")
    return with_totals(now, [rep], _total=F.sum(workload)).withColumn("allocated_fte", F.col(workload) / F.col("_total")).drop("_total")


def staffing_need(workload, capacity, fte) -> dict[str, Column]:
    """Required FTE, gap, additional need, current capacity and utilisation."""
    w, c, f = (F.col(x) if isinstance(x, str) else x for x in (workload, capacity, fte))
    need = w / F.when(c > 0, c).otherwise(F.raise_error(F.lit("capacity must be positive")).cast("double"))
    return {
        "required_fte": need, "fte_gap": need - f, "additional_fte_need": F.greatest(need - f, F.lit(0.0)), "current_capacity": f * c,
        "utilization": F.when(f > 0, need / F.when(f > 0, f)).when(need > 0, float("inf")).otherwise(0.0)}


# Priority weights and the labels up to each priority score.
PRIORITY_WEIGHTS = {"utilization": 0.30, "gap": 0.30, "demand_growth": 0.15, "customer_growth": 0.10, "geographic_load": 0.05, "product_opportunity": 0.05, "workload_pressure": 0.05}
PRIORITY_LABELS = [(30, "No modeled capacity pressure"), (50, "Monitor"), (70, "Validate capacity assumptions"), (85, "Capacity pressure indicated"), (100, "Additional field-capacity scenario strongly indicated")]


def unit_plan(units: DataFrame, keys: Sequence[str], period: str, tested: DataFrame, chosen: DataFrame, capacity: DataFrame, allocation: DataFrame,
              metrics: Sequence[str], train_end: str, rep: str) -> DataFrame:
    """One planning row per unit: forecast, bounds, winsorised sensitivity, growth, priority and label; stale units stay null.

    ``units`` holds the metrics and ``workload`` per unit and month; ``capacity`` is one row.
    """
    keys = list(keys)
    latest = units.agg(F.max(period).alias("latest"))
    every = [*metrics, "workload"]
    ahead = next_month_forecasts(units, keys, period, every, chosen, latest)
    wide = ahead.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("forecast"))).alias(f"forecast_{m}") for m in every],
                                    F.max(F.when(F.col("metric") == "workload", F.col("method"))).alias("forecast_method"))
    train = units.filter(F.col(period) <= F.to_date(F.lit(train_end)))
    bounds = quantiles(train, keys, "workload", {"_lo": 0.05, "_hi": 0.95})
    clipped = null_safe_join(units.select(*keys, period, "workload"), bounds, keys, "left").withColumn("workload", F.least(F.greatest("workload", "_lo"), "_hi")).drop("_lo", "_hi")
    clean = next_month_forecasts(clipped, keys, period, ["workload"], chosen, latest).select(*keys, F.col("forecast").alias("_clean"))
    errors = tested.filter((F.col("metric") == "workload") & (F.col("split") == "validation")).join(chosen, ["metric", "method"], "left_semi").withColumn("_e", F.abs(F.col("prediction") - F.col("observed")))
    error = quantiles(errors, keys, "_e", {"_error": 0.8})
    last = W.partitionBy(*keys).orderBy(period).rowsBetween(-2, 0)
    tail = units.withColumns({f"_t_{m}": F.avg(m).over(last) for m in ("total_sales", "distinct_customers", "workload")}).groupBy(*keys).agg(
        F.max(period).alias("last_observed_month"), *[F.max_by(f"_t_{m}", period).alias(f"_t_{m}") for m in ("total_sales", "distinct_customers", "workload")],
        F.percentile("distinct_cities", F.lit(0.5)).alias("_m_cities"), F.percentile("distinct_products", F.lit(0.5)).alias("_m_products"))
    staff = allocation.groupBy(*keys).agg(F.sum("allocated_fte").alias("allocated_current_fte"), F.count_distinct(rep).alias("current_active_reps"))
    out = tail
    for part in (wide, clean, error, staff):
        out = null_safe_join(out, part, keys, "left")
    out = with_scalars(with_scalars(out, latest), capacity)
    c = F.col
    out = out.withColumns({
        "planning_eligible": c("last_observed_month") == c("latest"), "forecast_date": F.add_months("latest", 1), "capacity_per_rep": c("capacity"),
        "_error": F.coalesce("_error", F.lit(0.0)), "allocated_current_fte": F.coalesce("allocated_current_fte", F.lit(0.0)), "current_active_reps": F.coalesce("current_active_reps", F.lit(0))})
    work, fte = c("forecast_workload"), c("allocated_current_fte")
    out = out.withColumns(staffing_need(work, "capacity", fte))
    low = lambda e: F.greatest(e, F.lit(1e-9))
    clip01 = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({
        "required_fte_low": F.greatest(work - c("_error"), F.lit(0.0)) / low(c("capacity_high")), "required_fte_high": (work + c("_error")) / low(c("capacity_low")),
        "forecast_uncertainty": c("_error") / low(work), "raw_required_fte": work / c("capacity"), "cleaned_required_fte": c("_clean") / c("capacity"),
        "cleaning_difference": (c("_clean") - work) / c("capacity"),
        "demand_growth": c("forecast_total_sales") / F.greatest(F.abs("_t_total_sales"), F.lit(1.0)) - 1,
        "customer_growth": c("forecast_distinct_customers") / F.greatest(c("_t_distinct_customers"), F.lit(1.0)) - 1})
    parts = {
        "utilization": clip01((c("utilization") - 0.7) / 0.8), "gap": clip01(c("additional_fte_need") / F.greatest(fte, F.lit(0.1))), "demand_growth": clip01(c("demand_growth") / 0.2),
        "customer_growth": clip01(c("customer_growth") / 0.2), "geographic_load": clip01(c("forecast_distinct_cities") / F.greatest(c("_m_cities"), F.lit(1.0)) - 1),
        "product_opportunity": clip01(c("forecast_distinct_products") / F.greatest(c("_m_products"), F.lit(1.0)) - 1), "workload_pressure": clip01(work / low(c("_t_workload")) - 1)}
    raw = 100 * sum((F.lit(PRIORITY_WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0))
    out = out.withColumn("hiring_priority", raw * (1 - 0.25 * F.least(c("forecast_uncertainty"), F.lit(1.0))))
    label = first_match([(c("hiring_priority") <= up, text) for up, text in PRIORITY_LABELS], F.lit(None).cast("string"))
    out = out.withColumn("recommendation", F.when(c("planning_eligible"), label).otherwise("Insufficient recent source coverage — validate data"))
    numeric = ["allocated_current_fte", "capacity_per_rep", "current_active_reps", "required_fte", "fte_gap", "additional_fte_need", "current_capacity", "utilization", "required_fte_low", "required_fte_high",
               "forecast_uncertainty", "hiring_priority", "cleaning_difference", "demand_growth", "customer_growth"]
    out = out.withColumns({n: F.when(c("planning_eligible"), c(n)) for n in numeric})
    return out.drop("latest", "stable_rows", "fallback", "capacity", "capacity_low", "capacity_high", *[n for n in out.columns if n.startswith("_")])


# Scenario name, demand change, added FTE, capacity change.
SCENARIOS = [("Base case", 0.0, 0.0, 0.0), ("Demand +10%", 0.1, 0.0, 0.0), ("Demand +20%", 0.2, 0.0, 0.0), ("Add 1 representative", 0.0, 1.0, 0.0),
             ("Add 2 representatives", 0.0, 2.0, 0.0), ("Capacity -10%", 0.0, 0.0, -0.1), ("Product launch +30%", 0.3, 0.0, 0.0)]


def _before_after(df: DataFrame, workload: str, capacity: str, fte: str) -> DataFrame:
    c = F.col
    before = staffing_need(workload, capacity, fte)
    df = df.withColumns({"workload_before": c(workload), "capacity_before": before["current_capacity"], "utilization_before": before["utilization"], "fte_gap_before": before["fte_gap"],
                         "workload_after": c(workload) * (1 + c("demand_change"))})
    after = staffing_need(c("workload_after"), c(capacity) * (1 + c("capacity_change")), c(fte) + c("fte_change"))
    return df.withColumns({"capacity_after": after["current_capacity"], "utilization_after": after["utilization"], "remaining_gap": after["fte_gap"]})


def scenarios(plan: DataFrame, keys: Sequence[str], specs: Sequence[tuple] = SCENARIOS, workload: str = "forecast_workload", capacity: str = "capacity_per_rep", fte: str = "allocated_current_fte") -> DataFrame:
    """Every eligible unit under every scenario, before and after."""
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(d)).alias("demand_change"), F.lit(float(a)).alias("fte_change"), F.lit(float(k)).alias("capacity_change")) for n, d, a, k in specs])
    rows = plan.filter("planning_eligible").select(*keys, workload, capacity, fte, F.inline(cells))
    return _before_after(rows, workload, capacity, fte).drop(workload, capacity, fte)


def reallocation(plan: DataFrame, keys: Sequence[str], team: str, priority: str = "hiring_priority", workload: str = "forecast_workload", capacity: str = "capacity_per_rep", fte: str = "allocated_current_fte") -> DataFrame:
    """One net-zero transfer: the top-priority unit receives up to one FTE from its team's least-used unit."""
    eligible = plan.filter("planning_eligible")
    label = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    e = eligible.withColumn("_id", label)
    receiver = e.agg(F.min_by(F.struct("_id", team), F.struct(-F.col(priority), F.col("_id"))).alias("_r")).select(F.col("_r._id").alias("_receiver"), F.col(f"_r.{team}").alias("_team"))
    e = with_scalars(e, receiver)
    pool = e.filter((F.col(team) == F.col("_team")) & (F.col("_id") != F.col("_receiver")))
    donor = pool.agg(F.min_by(F.struct("_id", fte), F.struct("utilization", "_id")).alias("_d")).select(F.col("_d._id").alias("_donor"), F.least(F.lit(1.0), F.col(f"_d.{fte}")).alias("_amount"))
    e = with_scalars(e, donor).filter(F.col("_id").isin(F.col("_receiver"), F.col("_donor")) & F.col("_donor").isNotNull())
    e = e.withColumns({"scenario": F.lit("Reallocate 1 representative (bounded by donor FTE)"), "demand_change": F.lit(0.0), "capacity_change": F.lit(0.0),
                       "fte_change": F.when(F.col("_id") == F.col("_receiver"), F.col("_amount")).otherwise(-F.col("_amount")),
                       "reallocation_role": F.when(F.col("_id") == F.col("_receiver"), "Receiver").otherwise("Donor")})
    out = _before_after(e, workload, capacity, fte)
    return out.select(*keys, "scenario", "reallocation_role", "demand_change", "fte_change", "capacity_change", "workload_before", "capacity_before", "utilization_before", "fte_gap_before",
                      "workload_after", "capacity_after", "utilization_after", "remaining_gap")


def gap_label(gap, eligible, epsilon: float = 1e-9) -> Column:
    g, e = F.col(gap), F.col(eligible)
    return first_match([(~e, "Ineligible / Stale Coverage"), (g > epsilon, "Potential Capacity Gap"), (g < -epsilon, "Potential Spare Capacity")], "Balanced")


def capacity_base(plan: DataFrame, keys: Sequence[str], metrics: DataFrame, history: DataFrame, period: str) -> DataFrame:
    """Planning rows with pooled forecast errors, recent growth and the gap label.

    ``metrics``: backtest metrics; ``history``: (keys, period, workload).
    """
    wape = metrics.filter(F.col("metric") == "workload").groupBy(F.col("method").alias("forecast_method")).agg(
        F.max(F.when(F.col("split") == "validation", F.col("wape"))).alias("validation_wape"), F.max(F.when(F.col("split") == "test", F.col("wape"))).alias("test_wape"))
    growth = history.select(*keys, F.col(period).alias("last_observed_month"), F.col("workload").alias("latest_observed_workload"), H.recent_growth("workload", 3, keys, period).alias("recent_workload_growth"))
    out = plan.join(wape, ["forecast_method"], "left").join(growth, [*keys, "last_observed_month"], "left")
    return out.withColumn("capacity_priority", gap_label("fte_gap", "planning_eligible"))


def capacity_base_checks(base: DataFrame, allocation: DataFrame, keys: Sequence[str], rep: str) -> DataFrame:
    """Check rows: arithmetic of the plan, one FTE per rep, allocation inside the eligible units."""
    ok = base.filter("planning_eligible")
    per_rep = allocation.groupBy(rep).agg(F.sum("allocated_fte").alias("_f"))
    unit = allocation.groupBy(*keys).agg(F.sum("allocated_fte").alias("_f"))
    both = ok.join(unit, list(keys), "left").withColumn("_f", F.coalesce("_f", F.lit(0.0)))
    outside = coverage_check(unit, ok, keys)
    return union_all([
        reconciliation(ok, "fte_gap", F.col("fte_gap"), F.col("required_fte") - F.col("allocated_current_fte"), 1e-9, "gap = required - allocated"),
        reconciliation(ok, "required_fte", F.col("required_fte"), F.col("forecast_workload") / F.col("capacity_per_rep"), 1e-9, "required = workload / capacity"),
        reconciliation(per_rep, "one_fte_per_rep", F.col("_f"), F.lit(1.0), 1e-9, "every representative counts once"),
        reconciliation(both, "unit_fte", F.col("allocated_current_fte"), F.col("_f"), 1e-9, "unit FTE equals the allocation"),
        check_row(outside, "allocation_inside_units", F.col("left_only") == 0, F.col("left_only"), "no allocation outside the eligible units"),
        all_rows(ok, "bounds", (F.col("required_fte_low") <= F.col("required_fte") + 1e-9) | F.col("required_fte_low").isNull(), "lower bound does not exceed the estimate"),
    ])


# Presentation names of the scenarios.
SCENARIO_NAMES = {"Base case": "Base Case", "Demand +10%": "Demand +10%", "Demand +20%": "Demand +20%", "Add 1 representative": "Add 1 FTE", "Add 2 representatives": "Add 2 FTE",
                  "Capacity -10%": "Capacity -10%", "Product launch +30%": "Product Launch", "Reallocate 1 representative (bounded by donor FTE)": "Net-zero Reallocation"}


def scenario_dataset(rows: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scenario rows with effective capacity, allocated FTE, gap label and transfer role."""
    name = F.element_at(F.create_map(*[F.lit(x) for p in SCENARIO_NAMES.items() for x in p]), F.col("scenario"))
    s = rows.withColumn("scenario_name", name).join(base.select(*keys, "capacity_per_rep", "allocated_current_fte", F.col("planning_eligible")), list(keys), "left")
    per_rep = F.col("capacity_per_rep") * (1 + F.col("capacity_change"))
    s = s.withColumns({"sustainable_capacity_per_rep": per_rep, "allocated_fte": F.col("capacity_after") / per_rep, "required_fte": F.col("workload_after") / per_rep, "fte_gap": F.col("remaining_gap")})
    s = s.withColumn("allocated_fte_change", F.col("allocated_fte") - F.col("allocated_current_fte")).withColumn("capacity_priority", gap_label("fte_gap", "planning_eligible"))
    transfer = F.col("scenario_name") == "Net-zero Reallocation"
    return s.withColumn("reallocation_role", F.when(transfer & (F.col("fte_change") < -1e-9), "Donor").when(transfer & (F.col("fte_change") > 1e-9), "Receiver"))


def scenario_checks(dataset: DataFrame) -> DataFrame:
    moved = dataset.filter(F.col("scenario_name") == "Net-zero Reallocation").agg(F.coalesce(F.sum("allocated_fte_change"), F.lit(0.0)).alias("net"))
    return union_all([
        reconciliation(dataset, "remaining_gap", F.col("fte_gap"), F.col("required_fte") - F.col("allocated_fte"), 1e-9, "gap = required - allocated"),
        reconciliation(dataset, "demand_assumption", F.col("workload_after"), F.col("workload_before") * (1 + F.col("demand_change")), 1e-9, "named demand change"),
        reconciliation(dataset, "fte_assumption", F.col("allocated_fte_change"), F.col("fte_change"), 1e-9, "named FTE change"),
        check_row(moved, "net_zero_transfer", F.abs("net") <= 1e-9, F.col("net"), "donor and receiver cancel"),
    ])
