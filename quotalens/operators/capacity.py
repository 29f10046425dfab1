"""Field workload, availability, coverage and territory allocation.

Facts are reduced to rep-period, customer-period or rep-period-territory before they meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.functions import exact_id, first_match, lenient_bool, month_start, number, stable_integer, value_or_seeded, visits_per_month
from quotalens.operators import aggregates as A, shares as S
from quotalens.operators.joins import assemble, month_grid, unique_or_fail, with_fallback
from quotalens.session import bucketed, checkpointed, dealt, sent
from quotalens.operators.ranking import average_rank, middle_quantile, null_safe_join, quantiles, unpivot, with_scalars

REP = ["rep_id", "period"]
CELL = ["rep_id", "period", "territory_id"]
CUSTOMER = ["customer_id", "period"]

# The workload metrics and their default weights.
WORKLOAD_WEIGHTS = {"distinct_customers": 0.40, "transaction_count": 0.25, "distinct_cities": 0.15, "distinct_products": 0.10, "distributor_count": 0.10}

# Quantities that add up over territories.
VISIT_MEASURES = ["planned_visit_count", "completed_visit_count", "planned_visit_hours", "planned_travel_hours",
                  "excess_service_visit_count", "excess_service_visit_hours", "excess_service_travel_hours", "excess_service_hours",
                  "observed_visit_count", "observed_completed_visit_count", "observed_visit_hours", "observed_travel_hours"]
COVERAGE_MEASURES = ["required_visit_count", "priority_required_visit_count", "credited_planned_visit_count", "credited_completed_visit_count",
                     "required_customer_coverage_hours", "required_priority_customer_coverage_hours", "customer_coverage_gap", "priority_customer_coverage_gap"]
AVAILABILITY_MEASURES = ["working_days", "leave_days", "holiday_days", "training_hours", "administrative_hours", "meeting_hours",
                         "gross_rostered_field_hours", "non_field_hours", "available_field_hours", "nominal_full_time_hours"]
DERIVED_MEASURES = ["core_required_hours", "workload_buffer_hours", "required_total_hours", "required_fte", "available_fte", "fte_gap"]


@dataclass
class CapacityRules:
    """Assumptions of the calendar; every field can be overridden."""
    seed: int = 42
    visit_minutes: float = 42.0
    speed_kmh: float = 42.0
    hours_per_call: float = 0.70
    travel_hours_per_visit: float = 0.50
    buffer: float = 0.08
    field_hours_per_day: float = 8.0
    working_days: float = 20.0
    cadence_divisor: float = 1.6
    zero_capacity_pct: float = 10000.0
    bands: tuple[float, float, float] = (85.0, 100.0, 120.0)
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WORKLOAD_WEIGHTS))
    train_end: str | None = None


def share(numerator, denominator, default: float = 0.0) -> Column:
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    return F.when(d > 0, n / F.when(d > 0, d)).otherwise(F.lit(float(default)))


def prepare_visits(visits: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Counts and hours per visiting rep, month, customer and visited territory.

    Hours come from minutes, else from the timestamps, else from the default; travel from km and speed.
    """
    have = set(visits.columns)
    v = visits if "period" in have else visits.withColumn("period", month_start("visit_date"))
    minutes = number("visit_duration_minutes") if "visit_duration_minutes" in have else F.lit(None).cast("double")
    minutes = F.when(minutes > 0, minutes)
    if {"actual_start_time", "actual_end_time"} <= have:
        elapsed = (F.unix_micros(F.col("actual_end_time").cast("timestamp")) - F.unix_micros(F.col("actual_start_time").cast("timestamp"))) / 6e7
        minutes = F.coalesce(minutes, F.when(elapsed > 0, elapsed))
    hours = F.coalesce(minutes, F.lit(rules.visit_minutes)) / 60.0
    if "planned_travel_hours" in have:
        travel = number("planned_travel_hours")
    elif "estimated_travel_km" in have:
        travel = number("estimated_travel_km") / rules.speed_kmh
    else:
        travel = F.lit(0.0)
    travel = F.coalesce(F.when(travel >= 0, travel), F.lit(0.0))
    done = lenient_bool("visit_completed_flag", True) if "visit_completed_flag" in have else F.lit(True)
    keys = [*REP, "customer_id", *(["territory_id"] if "territory_id" in have else [])]
    return v.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("planned_visit_count"), F.sum(done.cast("double")).alias("completed_visit_count"),
        F.sum(hours).alias("planned_visit_hours"), F.sum(travel).alias("planned_travel_hours"))


def customer_activity(tx: DataFrame, field_visits: DataFrame, rules: CapacityRules = CapacityRules()) -> tuple[DataFrame, DataFrame]:
    """(activity, visits): the transactions per customer, month and rep beside :func:`prepare_visits`, dealt by customer and written once.

    ``activity`` weighs a row by its transactions or visits, ``_n``; ``visits`` are its visits.
    """
    traded = dealt(tx.select(*CUSTOMER, "rep_id"), "customer_id").groupBy(*CUSTOMER, "rep_id").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    visits = prepare_visits(dealt(field_visits, "customer_id"), rules)
    both = bucketed(traded.unionByName(visits.withColumn("_n", F.col("planned_visit_count")), allowMissingColumns=True), "customer_id")
    return both, both.filter("planned_visit_count IS NOT NULL").select(*visits.columns)


def normalized_workload(tx: DataFrame, reps: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Rep × month grid with activity counts and the weighted count index over training medians."""
    # A rep's lines of one month are moved once and counted where they arrive, instead of once per distinct count.
    distinct = lambda c, name: F.size(F.collect_set(c)).cast("double").alias(name)
    loads = tx.select(*REP, "customer_id", "city", "product_id", "distributor").repartition(*REP).groupBy(*REP).agg(
        distinct("customer_id", "distinct_customers"), F.count(F.lit(1)).cast("double").alias("transaction_count"),
        distinct("city", "distinct_cities"), distinct("product_id", "distinct_products"), distinct("distributor", "distributor_count"))
    weights = rules.weights
    if set(weights) - set(WORKLOAD_WEIGHTS) or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("workload weights must be known, nonnegative and not all zero")
    train = loads.filter(F.col("period") <= F.to_date(F.lit(rules.train_end))) if rules.train_end else loads
    medians = quantiles(unpivot(train, [], list(weights), "m", "v"), ["m"], "v", {"q": 0.5})
    scales = medians.agg(*[F.greatest(F.coalesce(F.max(F.when(F.col("m") == m, F.col("q"))), F.lit(1.0)), F.lit(1.0)).alias(f"{m}_scale") for m in weights])
    grid = month_grid(reps.select("rep_id"), tx, "period").join(loads, REP, "left")
    grid = with_scalars(grid.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in WORKLOAD_WEIGHTS}), scales)
    index = sum((F.lit(float(w)) * F.col(m) / F.col(f"{m}_scale") for m, w in weights.items()), F.lit(0.0))
    return grid.withColumn("normalized_workload_index", index)


def period_territory(tx: DataFrame) -> DataFrame:
    """Dominant territory per rep-period, its share, and the full fractional allocation as id:share tokens."""
    # dealt by rep-period, where its few territories are counted and summed
    counts = tx.filter(F.col("territory_id").isNotNull()).select(*CELL).repartition(*REP).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_share", F.col("_n") / F.sum("_n").over(W.partitionBy(*REP)))
    token = F.concat(F.col("territory_id").cast("string"), F.lit(":"), F.format_string("%.8f", F.col("_share")))
    return counts.groupBy(*REP).agg(
        F.min_by("territory_id", F.struct(-F.col("_n"), F.col("territory_id").cast("string"))).alias("territory_id"),
        F.max("_share").alias("dominant_territory_activity_share"), F.count(F.lit(1)).alias("active_territory_count"),
        F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(F.col("territory_id").cast("string").alias("k"), token.alias("t")))), lambda x: x["t"])).alias("fractional_territory_allocation"))


def months_of_customers(facts: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """(customer_id, ``out``): the columns of one row per customer and month as a map from the month, so a customer meets its facts once.

    A map holds at most the calendar's months; rows without a month match nothing.
    """
    entry = F.struct("period", F.struct(*columns))
    return facts.filter(F.col("period").isNotNull()).groupBy("customer_id").agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def customer_owners(tx: DataFrame, visits: DataFrame, customers: DataFrame, reps: DataFrame, rules: CapacityRules = CapacityRules(), activity: DataFrame | None = None) -> DataFrame:
    """Customer × month portfolio rows: the most active rep that month, else the customer's static owner.

    Customers without a static owner get one by a stable hash over the territory's representatives.
    ``activity`` is what :func:`customer_activity` gives of the same transactions and visits; without it their rows are moved here.
    """
    if activity is None:
        activity = tx.groupBy(*CUSTOMER, "rep_id").agg(F.count(F.lit(1)).cast("double").alias("_n")).unionByName(
            visits.groupBy(*CUSTOMER, "rep_id").agg(F.sum("planned_visit_count").alias("_n")))
    dynamic = S.dominant_member(activity, CUSTOMER, "rep_id", "_dynamic", weight="_n")
    starts = activity.groupBy("customer_id").agg(F.min("period").alias("portfolio_start_period"))

    master = unique_or_fail(customers, ["customer_id"], "customers")
    owners = [F.col(c) for c in ("primary_rep_id", "assigned_rep_id") if c in customers.columns]
    master = master.withColumn("_static", F.coalesce(*owners) if owners else F.lit(None).cast(dict(reps.dtypes)["rep_id"]))
    # Representatives of a territory are numbered, so the hash picks a number and the join finds the rep.
    team = reps.filter(F.col("territory_id").isNotNull()).select("territory_id", "rep_id")
    numbered = team.withColumn("_slot", F.row_number().over(W.partitionBy("territory_id").orderBy(F.col("rep_id").cast("string"))) - 1)
    size = team.groupBy("territory_id").agg(F.count(F.lit(1)).alias("_size"))
    if "territory_id" in master.columns:
        master = master.join(size, ["territory_id"], "left")
        slot = F.pmod(stable_integer("customer_id", rules.seed), F.coalesce("_size", F.lit(1))).cast("int")
        master = master.withColumn("_slot", F.when(F.col("_static").isNull(), slot)).join(numbered.withColumnRenamed("rep_id", "_hashed"), ["territory_id", "_slot"], "left")
        fallback = reps.agg(F.min("rep_id").alias("_any"))
        master = with_scalars(master, fallback).withColumn("_static", F.coalesce("_static", "_hashed", "_any")).drop("_size", "_slot", "_hashed", "_any")
    master = master.join(starts, ["customer_id"], "left")
    if "customer_priority" not in master.columns:
        potential = number("potential_score") if "potential_score" in master.columns else F.lit(0.5)
        master = master.withColumn("_p", potential)
        master = with_scalars(master, master.agg(F.when(F.max("_p") > 1.0, 100.0).otherwise(1.0).alias("_scale")))
        master = master.withColumn("customer_priority", first_match(
            [(F.col("_p") >= 0.75 * F.col("_scale"), "high"), (F.col("_p") >= 0.40 * F.col("_scale"), "medium")], "low")).drop("_p", "_scale")
    priority = F.lower(F.trim(F.coalesce("customer_priority", F.lit("medium"))))
    cadence = F.col("required_visit_frequency").cast("string") if "required_visit_frequency" in master.columns else F.lit(None).cast("string")
    master = master.withColumn("customer_priority", priority).withColumn("required_visit_count", visits_per_month(cadence, "customer_priority", rules.cadence_divisor))
    span = tx.select("period").unionByName(visits.select("period"))
    # The customers meet their months' owners before the months are laid out, so only customers are moved.
    master = dealt(master, "customer_id").join(months_of_customers(dynamic, ["_dynamic"], "_owners"), ["customer_id"], "left")
    drill = month_grid(master, span, "period", "portfolio_start_period")
    return drill.withColumn("rep_id", F.coalesce(F.element_at("_owners", F.col("period"))["_dynamic"], "_static")).drop("_owners", "_static", "primary_rep_id", "assigned_rep_id", "portfolio_start_period")


def coverage(owned: DataFrame, visits: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Required, observed and credited visits, gaps and hours per portfolio customer and month."""
    seen = visits.groupBy(*CUSTOMER).agg(
        F.count_distinct("rep_id").cast("double").alias("servicing_rep_count"), F.sum("planned_visit_count").alias("observed_visit_count"),
        F.sum("completed_visit_count").alias("observed_completed_visit_count"), F.sum("planned_visit_hours").alias("observed_visit_hours"),
        F.sum("planned_travel_hours").alias("observed_travel_hours"))
    measures = [c for c in seen.columns if c not in CUSTOMER]
    d = owned.join(months_of_customers(seen, measures, "_months"), ["customer_id"], "left").withColumn("_month", F.element_at("_months", F.col("period"))).drop("_months")
    d = d.withColumns({c: F.coalesce(F.col("_month")[c], F.lit(0.0)) for c in measures}).drop("_month")
    d = d.withColumn("_travel", F.when(F.col("observed_visit_count") > 0, F.col("observed_travel_hours") / F.col("observed_visit_count")))
    if "territory_id" in d.columns:
        # only visited months have a travel time; a median is taken from the rows near it and sent to the portfolio, which is not moved
        travelled = checkpointed(d.filter("_travel IS NOT NULL").select("territory_id", "_travel"))
        usual = checkpointed(middle_quantile(travelled, ["territory_id"], "_travel", "_usual"))
        d = null_safe_join(d, sent(usual), ["territory_id"], "left").withColumn("_travel", F.coalesce("_travel", F.when(F.col("territory_id").isNotNull(), F.col("_usual")))).drop("_usual")
    c = F.col
    plus = lambda e: F.greatest(e, F.lit(0.0))
    d = d.withColumn("estimated_travel_hours_per_visit", F.coalesce("_travel", F.lit(rules.travel_hours_per_visit))).drop("_travel")
    d = d.withColumn("planned_visit_count", F.least("required_visit_count", "observed_visit_count"))
    d = d.withColumn("_share", share("planned_visit_count", "observed_visit_count"))
    high = c("customer_priority") == "high"
    only_high = lambda e: F.when(high, e).otherwise(0.0)
    d = d.withColumns({
        "planned_visit_hours": c("observed_visit_hours") * c("_share"), "planned_travel_hours": c("observed_travel_hours") * c("_share"),
        "completed_visit_count": F.least("required_visit_count", "observed_completed_visit_count")}).drop("_share")
    d = d.withColumns({
        "excess_service_visit_count": plus(c("observed_visit_count") - c("planned_visit_count")),
        "excess_service_visit_hours": plus(c("observed_visit_hours") - c("planned_visit_hours")),
        "excess_service_travel_hours": plus(c("observed_travel_hours") - c("planned_travel_hours")),
        "planned_coverage_gap_count": plus(c("required_visit_count") - c("planned_visit_count")),
        "customer_coverage_gap": plus(c("required_visit_count") - c("completed_visit_count"))})
    d = d.withColumns({
        "excess_service_hours": c("excess_service_visit_hours") + c("excess_service_travel_hours"),
        "priority_required_visit_count": only_high(c("required_visit_count")), "priority_customer_coverage_gap": only_high(c("customer_coverage_gap")),
        "required_customer_coverage_hours": c("planned_coverage_gap_count") * rules.hours_per_call + c("planned_coverage_gap_count") * c("estimated_travel_hours_per_visit"),
        "customer_coverage_pct": F.least(share("completed_visit_count", "required_visit_count", 1.0), F.lit(1.0)) * 100.0,
        "coverage_status": first_match([(c("customer_coverage_gap") <= 1e-12, "Covered"), (c("planned_coverage_gap_count") <= 1e-12, "Planned / not completed")], "Coverage gap"),
        "coverage_met_flag": c("customer_coverage_gap") <= 1e-12, "priority_customer_flag": high})
    return d.withColumn("required_priority_customer_coverage_hours", only_high(c("required_customer_coverage_hours")))


def obligations(covered: DataFrame) -> DataFrame:
    """(customer_id, _obligations): by month what a visited customer is owed, how often it was seen and its territory, one row per customer."""
    # Every visited customer-month has observed visits; the others owe nothing to a visit and are not moved.
    owner = [F.col("territory_id").alias("_owner")] if "territory_id" in covered.columns else []
    due = dealt(covered.filter("observed_visit_count > 0"), "customer_id").select(
        *CUSTOMER, F.col("required_visit_count").alias("_due"), F.col("observed_visit_count").alias("_seen"), F.col("observed_completed_visit_count").alias("_done"), *owner)
    return months_of_customers(unique_or_fail(due, CUSTOMER, "coverage"), [c for c in due.columns if c not in CUSTOMER], "_obligations")


def credited_visits(visits: DataFrame, covered: DataFrame, default_territory: bool = False) -> DataFrame:
    """Each visit row with what it is credited and what is in excess; a visit without a territory takes its customer's on request."""
    v = visits.join(obligations(covered), ["customer_id"], "left").withColumn("_of", F.element_at("_obligations", F.col("period"))).drop("_obligations")
    if default_territory:
        v = v.withColumn("territory_id", F.coalesce("territory_id", "_of._owner") if "territory_id" in v.columns else F.col("_of._owner"))
    v = v.withColumns({c: F.col(f"_of.{c}") for c in ("_due", "_seen", "_done")}).drop("_of")
    v = v.withColumn("_due", F.when(F.col("_due").isNotNull(), F.col("_due")).otherwise(F.raise_error(F.lit("a visit has no coverage obligation")).cast("double")))
    planned, completed = share(F.least("_due", "_seen"), "_seen"), share(F.least("_due", "_done"), "_done")
    plus = lambda e: F.greatest(e, F.lit(0.0))
    c = F.col
    v = v.withColumns({"_pc": c("planned_visit_count") * planned, "_cc": c("completed_visit_count") * completed, "_ph": c("planned_visit_hours") * planned, "_th": c("planned_travel_hours") * planned})
    return v.withColumns({"_xc": plus(c("planned_visit_count") - c("_pc")), "_xh": plus(c("planned_visit_hours") - c("_ph")), "_xt": plus(c("planned_travel_hours") - c("_th"))})


def _credits() -> list[Column]:
    return [F.sum("_pc").alias("planned_visit_count"), F.sum("_cc").alias("completed_visit_count"), F.sum("_ph").alias("planned_visit_hours"), F.sum("_th").alias("planned_travel_hours"),
            F.sum("_xc").alias("excess_service_visit_count"), F.sum("_xh").alias("excess_service_visit_hours"),
            F.sum("_xt").alias("excess_service_travel_hours"), F.sum(F.col("_xh") + F.col("_xt")).alias("excess_service_hours")]


def _observed() -> list[Column]:
    return [F.sum("planned_visit_count").alias("observed_visit_count"), F.sum("completed_visit_count").alias("observed_completed_visit_count"),
            F.sum("planned_visit_hours").alias("observed_visit_hours"), F.sum("planned_travel_hours").alias("observed_travel_hours")]


def servicing_allocation(visits: DataFrame, covered: DataFrame, keys: Sequence[str] = tuple(REP), observed: bool = False) -> DataFrame:
    """Credit capped at the customer's obligation, shared pro rata by who visited; the excess is kept.  ``observed`` adds :func:`observed_visits`."""
    return credited_visits(visits, covered).groupBy(*keys).agg(*_credits(), *(_observed() if observed else []))


def observed_visits(visits: DataFrame, keys: Sequence[str] = tuple(REP)) -> DataFrame:
    return visits.groupBy(*keys).agg(*_observed())


def coverage_totals(covered: DataFrame, keys: Sequence[str] = tuple(REP)) -> DataFrame:
    """Sums over coverage rows, which are one per customer and month, so within a month their count is that of the customers."""
    s = lambda c, n=None: F.sum(c).alias(n or c)
    customers = F.count("customer_id") if "period" in keys else F.count_distinct("customer_id")
    return covered.groupBy(*keys).agg(
        customers.cast("double").alias("active_customer_count"), F.sum(F.col("priority_customer_flag").cast("double")).alias("priority_customer_count"),
        s("required_visit_count"), s("priority_required_visit_count"), s("planned_visit_count", "credited_planned_visit_count"), s("completed_visit_count", "credited_completed_visit_count"),
        s("required_customer_coverage_hours"), s("required_priority_customer_coverage_hours"), s("customer_coverage_gap"), s("priority_customer_coverage_gap"))


def risk_band(pct: Column, bands=(85.0, 100.0, 120.0)) -> Column:
    medium, high, critical = bands
    return first_match([(pct >= critical, "critical"), (pct >= high, "high"), (pct >= medium, "medium")], "low")


def utilization(required, available, zero_capacity: float = 10000.0) -> Column:
    r, a = F.col(required), F.col(available)
    return F.when(a > 0, r * 100.0 / F.when(a > 0, a)).when(r > 0, zero_capacity).otherwise(0.0)


def hours_and_fte(df: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Core, buffer and total required hours, FTE figures, utilisation and risk band from their components."""
    c = F.col
    df = df.withColumn("core_required_hours", c("planned_visit_hours") + c("planned_travel_hours") + c("required_customer_coverage_hours"))
    df = df.withColumn("workload_buffer_hours", c("core_required_hours") * rules.buffer)
    df = df.withColumn("required_total_hours", c("core_required_hours") + c("workload_buffer_hours"))
    return fte_and_risk(df, rules)


def fte_and_risk(df: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    df = df.withColumns({
        "utilization_pct": utilization("required_total_hours", "available_field_hours", rules.zero_capacity_pct),
        "required_fte": share("required_total_hours", "nominal_full_time_hours"), "available_fte": share("available_field_hours", "nominal_full_time_hours")})
    return df.withColumns({
        "fte_gap": F.col("required_fte") - F.col("available_fte"), "capacity_risk_band": risk_band(F.col("utilization_pct"), rules.bands),
        "capacity_overload_flag": F.col("utilization_pct") >= rules.bands[1]})


def capacity_calendar(tx: DataFrame, reps: DataFrame, customers: DataFrame, field_visits: DataFrame, rules: CapacityRules = CapacityRules()) -> tuple[DataFrame, DataFrame]:
    """(calendar, coverage): deterministic rep-period capacity and its customer drill-down."""
    # Both are tables of their own that several later steps read; materialise them once.
    activity, visits = customer_activity(tx, field_visits, rules)
    covered = checkpointed(coverage(customer_owners(tx, visits, customers, reps, rules, activity), visits, rules))
    cal = normalized_workload(tx, reps, rules).join(reps.withColumnRenamed("territory_id", "_home"), ["rep_id"], "left")
    cal = cal.join(period_territory(tx), REP, "left") if "territory_id" in tx.columns else cal.withColumn("territory_id", F.lit(None).cast("string"))
    home = F.concat(F.col("_home").cast("string"), F.lit(":1.00000000"))
    if "active_territory_count" in cal.columns:
        cal = cal.withColumns({"active_territory_count": F.coalesce("active_territory_count", F.lit(1)), "dominant_territory_activity_share": F.coalesce("dominant_territory_activity_share", F.lit(1.0)),
                               "fractional_territory_allocation": F.coalesce("fractional_territory_allocation", home)})
    cal = cal.withColumn("territory_id", F.coalesce("territory_id", "_home")).drop("_home")
    if "hire_date" in cal.columns:
        cal = cal.filter(F.col("hire_date").isNull() | (F.col("period") >= month_start("hire_date")))
    token = F.concat_ws("|", F.col("rep_id").cast("string"), F.date_format("period", "yyyy-MM"))
    have = set(cal.columns)
    per_day = F.coalesce(number("standard_field_hours_per_day"), F.lit(rules.field_hours_per_day)) if "standard_field_hours_per_day" in have else F.lit(rules.field_hours_per_day)
    days = F.coalesce(number("standard_working_days_per_month"), F.lit(rules.working_days)) if "standard_working_days_per_month" in have else F.lit(rules.working_days)
    cal = cal.withColumn("standard_field_hours_per_day", per_day).withColumn("standard_working_days_per_month", days)
    cal = cal.withColumn("working_days", F.greatest(number("working_days") if "working_days" in have else F.col("standard_working_days_per_month"), F.lit(1.0)))
    seeded = lambda c, lo, hi, whole=False: F.greatest(value_or_seeded(cal, c, token, rules.seed, lo, hi, whole), F.lit(0.0))
    cal = cal.withColumns({
        "leave_days": F.least(seeded("leave_days", 0.0, 2.999, True), F.col("working_days")), "holiday_days": seeded("holiday_days", 0.0, 2.999, True),
        "training_hours": seeded("training_hours", 2.0, 7.0), "administrative_hours": seeded("administrative_hours", 8.0, 14.0), "meeting_hours": seeded("meeting_hours", 4.0, 9.0)})
    cal = cal.withColumn("holiday_days", F.least("holiday_days", F.col("working_days") - F.col("leave_days")))
    cal = cal.withColumns({
        "gross_rostered_field_hours": (F.col("working_days") - F.col("leave_days") - F.col("holiday_days")) * F.col("standard_field_hours_per_day"),
        "non_field_hours": F.col("training_hours") + F.col("administrative_hours") + F.col("meeting_hours"),
        "nominal_full_time_hours": F.col("standard_working_days_per_month") * F.col("standard_field_hours_per_day")})
    cal = cal.withColumn("available_field_hours", F.greatest(F.col("gross_rostered_field_hours") - F.col("non_field_hours"), F.lit(0.0)))
    cal = assemble(cal, [coverage_totals(covered), servicing_allocation(visits, covered, observed=True)], REP)
    cal = cal.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ["active_customer_count", "priority_customer_count", *COVERAGE_MEASURES, *VISIT_MEASURES]})
    cal = hours_and_fte(cal, rules).withColumns({
        "customer_coverage_pct": F.least(share("credited_completed_visit_count", "required_visit_count", 1.0), F.lit(1.0)) * 100.0,
        "average_travel_hours": share("planned_travel_hours", "planned_visit_count"), "workload_per_active_customer": share("required_total_hours", "active_customer_count"),
        "capacity_record_id": exact_id("CAPCAL", "rep_id", "period"), "data_lineage": F.lit("synthetic_derived")})
    return cal, covered


def transaction_shares(calendar: DataFrame, tx: DataFrame) -> DataFrame:
    """Transaction-count shares per rep-period-territory; idle rep-periods go wholly to the roster territory."""
    # dealt by rep-period, where its few territories are counted and summed; the calendar's cells are read twice
    calendar = checkpointed(calendar.select(*CELL))
    counts = tx.filter(F.col("territory_id").isNotNull()).select(*CELL).repartition(*REP).groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("territory_activity_count"))
    counts = counts.join(calendar.select(*REP), REP, "left_semi")
    shares = counts.withColumn("territory_allocation_share", F.col("territory_activity_count") / F.sum("territory_activity_count").over(W.partitionBy(*REP)))
    shares = shares.withColumn("allocation_basis", F.lit("rep_period_transaction_count"))
    idle = calendar.select(*CELL, F.lit(0.0).alias("territory_activity_count"), F.lit(1.0).alias("territory_allocation_share"), F.lit("roster_territory_idle_period_fallback").alias("allocation_basis"))
    return with_fallback(shares, idle, REP)


def allocate_by_share(calendar: DataFrame, tx: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Planning proxy: every additive rep-period measure times its territory share."""
    measures = [c for c in [*AVAILABILITY_MEASURES, *VISIT_MEASURES, *COVERAGE_MEASURES, "transaction_count", *DERIVED_MEASURES] if c in calendar.columns]
    out = transaction_shares(calendar, tx).join(
        calendar.select(*REP, F.col("territory_id").alias("dominant_territory_id"), F.col("capacity_risk_band").alias("source_risk_band"), *measures), REP, "inner")
    out = out.withColumns({c: F.col(c) * F.col("territory_allocation_share") for c in measures})
    return out.withColumns({
        "utilization_pct": utilization("required_total_hours", "available_field_hours", rules.zero_capacity_pct), "capacity_risk_band": F.col("source_risk_band"),
        "dominant_territory_flag": F.col("territory_id") == F.col("dominant_territory_id"), "geographic_workload_attribution_flag": F.lit(False),
        "capacity_territory_allocation_id": exact_id("CAPALLOC", "rep_id", "period", "territory_id")}).drop("source_risk_band")


def reconcile_onto_dominant(df: DataFrame, source: DataFrame, columns: Sequence[str], hours: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """Add what the rows of a rep-period lack against the source to the dominant row, and say which columns.

    Adds residual_allocation_columns (sorted list) and unrepresented_workload_residual_hours.
    """
    # a rep-period has few territories, so its sums are windows over rows dealt by it
    sums = df.withColumns({f"_sum_{c}": F.sum(c).over(W.partitionBy(*REP)) for c in columns})
    joined = sums.join(source.select(*REP, *[F.col(c).alias(f"_src_{c}") for c in columns]), REP, "left")
    gap = {c: F.col(f"_src_{c}") - F.col(f"_sum_{c}") for c in columns}
    moved = {c: F.coalesce(F.when(F.col("dominant_territory_flag") & (F.abs(g) > tolerance), g), F.lit(0.0)) for c, g in gap.items()}
    names = F.array_compact(F.array(*[F.when(moved[c] != 0, F.lit(c)) for c in sorted(columns)]))
    unseen = sum((moved[c] for c in hours), F.lit(0.0))
    before_names = F.col("residual_allocation_columns") if "residual_allocation_columns" in df.columns else F.array().cast("array<string>")
    before_hours = F.col("unrepresented_workload_residual_hours") if "unrepresented_workload_residual_hours" in df.columns else F.lit(0.0)
    joined = joined.withColumns({"_names": F.array_sort(F.array_union(before_names, names)), "_unseen": before_hours + unseen, **{f"_new_{c}": F.col(c) + moved[c] for c in columns}})
    for c in columns:
        joined = joined.withColumn(c, F.col(f"_new_{c}"))
    joined = joined.withColumn("residual_allocation_columns", F.col("_names")).withColumn("unrepresented_workload_residual_hours", F.col("_unseen"))
    return joined.drop("_names", "_unseen", *[f"_new_{c}" for c in columns], *[f"_sum_{c}" for c in columns], *[f"_src_{c}" for c in columns])


def allocate_by_service(calendar: DataFrame, tx: DataFrame, field_visits: DataFrame, covered: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Core workload where it was served or owned; shared quantities by activity share; totals conserved."""
    exact = ["transaction_count", *VISIT_MEASURES, *COVERAGE_MEASURES]
    used = dict.fromkeys([*CELL, *exact, *AVAILABILITY_MEASURES, "core_required_hours", "workload_buffer_hours", "required_total_hours"])
    calendar = checkpointed(calendar.select(*used))  # read several times
    home = calendar.select(*REP, F.col("territory_id").alias("dominant_territory_id"))
    served = credited_visits(prepare_visits(dealt(field_visits, "customer_id"), rules), covered, default_territory=True).withColumn("_x", F.col("_xh") + F.col("_xt"))
    credits = dict(zip(VISIT_MEASURES, ["_pc", "_cc", "_ph", "_th", "_xc", "_xh", "_xt", "_x", "planned_visit_count", "completed_visit_count", "planned_visit_hours", "planned_travel_hours"]))
    served = served.select(*CELL, *[F.col(c).alias(m) for m, c in credits.items()])
    owned = covered.select(*CELL, *[F.col({"credited_planned_visit_count": "planned_visit_count", "credited_completed_visit_count": "completed_visit_count"}.get(c, c)).alias(c) for c in COVERAGE_MEASURES])
    traded = tx.select(*CELL).repartition(*REP).groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("transaction_count")).join(home, REP, "inner").withColumn(
        "territory_id", F.coalesce("territory_id", "dominant_territory_id")).drop("dominant_territory_id")
    # All that a cell gets is summed in one pass, its rows dealt by rep-period, where the later sums and joins find them.  A cell without a territory gets nothing.
    parts = served
    for more in (owned, traded, calendar.select(*CELL)):
        parts = parts.unionByName(more, allowMissingColumns=True)
    out = parts.repartition(*REP).groupBy(*CELL).agg(*[F.coalesce(F.sum(F.when(F.col("territory_id").isNotNull(), F.col(c))), F.lit(0.0)).alias(c) for c in exact])
    out = out.join(home, REP, "inner").withColumn("dominant_territory_flag", F.col("territory_id").eqNullSafe(F.col("dominant_territory_id")))
    source = calendar.withColumn("transaction_count", F.coalesce(F.col("transaction_count").cast("double"), F.lit(0.0)))
    out = reconcile_onto_dominant(out, source, exact, ["planned_visit_hours", "planned_travel_hours", "required_customer_coverage_hours"])
    out = out.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in exact})
    out = out.withColumn("core_required_hours", F.col("planned_visit_hours") + F.col("planned_travel_hours") + F.col("required_customer_coverage_hours"))
    whole = W.partitionBy(*REP)
    out = out.withColumns({"_tx": F.sum("transaction_count").over(whole), "_work": F.sum("core_required_hours").over(whole)})
    by_work = F.when(F.col("_work") > 0, share("core_required_hours", "_work")).otherwise(F.col("dominant_territory_flag").cast("double"))
    out = out.withColumn("territory_allocation_share", F.when(F.col("_tx") > 0, share("transaction_count", "_tx")).otherwise(by_work))
    out = out.withColumn("allocation_basis", F.when(F.col("_tx") > 0, "actual visits + owned-customer coverage; availability by rep-period transaction share").otherwise(
        "actual visits + owned-customer coverage; availability by workload/roster fallback")).drop("_tx", "_work")
    common = source.select(*REP, *[F.col(c).alias(f"_cal_{c}") for c in [*AVAILABILITY_MEASURES, "core_required_hours", "workload_buffer_hours"]])
    out = out.join(common, REP, "inner")
    out = out.withColumns({c: F.col(f"_cal_{c}") * F.col("territory_allocation_share") for c in AVAILABILITY_MEASURES})
    out = out.withColumn("workload_buffer_hours", F.col("core_required_hours") * share("_cal_workload_buffer_hours", "_cal_core_required_hours"))
    out = out.withColumn("required_total_hours", F.col("core_required_hours") + F.col("workload_buffer_hours"))
    out = reconcile_onto_dominant(out, source, ["core_required_hours", "workload_buffer_hours", "required_total_hours"])
    nominal = F.col("_cal_nominal_full_time_hours")
    out = out.withColumns({"required_fte": F.when(nominal > 0, F.col("required_total_hours") / nominal).otherwise(0.0), "available_fte": F.when(nominal > 0, F.col("available_field_hours") / nominal).otherwise(0.0)})
    out = out.withColumns({
        "fte_gap": F.col("required_fte") - F.col("available_fte"), "utilization_pct": utilization("required_total_hours", "available_field_hours", rules.zero_capacity_pct),
        "residual_allocation_flag": F.size("residual_allocation_columns") > 0, "geographic_workload_attribution_flag": F.lit(True),
        "capacity_territory_allocation_id": exact_id("CAPALLOC", "rep_id", "period", "territory_id")})
    out = out.withColumns({"capacity_risk_band": risk_band(F.col("utilization_pct"), rules.bands), "capacity_overload_flag": F.col("utilization_pct") >= rules.bands[1]})
    return out.drop(*[c for c in out.columns if c.startswith("_cal_")])


def territory_allocation(calendar: DataFrame, tx: DataFrame, field_visits: DataFrame | None = None, covered: DataFrame | None = None, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Exact allocation when visits and coverage are given, else the activity-share proxy."""
    if field_visits is None or covered is None:
        return allocate_by_share(calendar, tx, rules)
    return allocate_by_service(calendar, tx, field_visits, covered, rules)


def territory_summary(allocation: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """One row per territory and period: sums, distinct reps, and ratios recomputed from the sums."""
    key = ["territory_id", "period"]
    measures = [c for c in [*AVAILABILITY_MEASURES, *VISIT_MEASURES, *COVERAGE_MEASURES, "core_required_hours", "workload_buffer_hours", "required_total_hours", "required_fte", "available_fte"] if c in allocation.columns]
    out = allocation.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in measures], F.size(F.collect_set("rep_id")).cast("long").alias("rep_count"), F.sum("territory_allocation_share").alias("fractional_rep_equivalent"),
        F.count(F.lit(1)).alias("allocation_row_count"), A.token_join("rep_id").alias("rep_ids"))
    out = out.withColumn("utilization_pct", utilization("required_total_hours", "available_field_hours", rules.zero_capacity_pct)).withColumn("fte_gap", F.col("required_fte") - F.col("available_fte"))
    return out.withColumns({
        "positive_fte_gap": F.greatest(F.col("fte_gap"), F.lit(0.0)), "capacity_risk_band": risk_band(F.col("utilization_pct"), rules.bands),
        "capacity_overload_flag": F.col("utilization_pct") >= rules.bands[1], "capacity_territory_record_id": exact_id("CAPTERR", "territory_id", "period")})


def evaluate_capacity(calendar: DataFrame, truth: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Overload precision / recall and hour errors against separate truth (one row).

    ``truth``: truth_id, record_ids (array), period, rep_id, territory_id, required_total_hours_truth.
    """
    from quotalens.operators.joins import resolve_by_ladder
    calendar = checkpointed(calendar.select("capacity_record_id", *CELL, "utilization_pct", "required_total_hours"))  # read several times
    hits = resolve_by_ladder(truth, "truth_id", calendar, "capacity_record_id", "record_ids", [["period", "rep_id"], ["period", "territory_id"]])
    positive = hits.select("capacity_record_id").distinct().withColumn("_y", F.lit(True))
    unmatched = truth.join(hits.select("truth_id").distinct(), ["truth_id"], "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    joined = calendar.join(positive, ["capacity_record_id"], "left").withColumn("_y", F.coalesce("_y", F.lit(False))).withColumn("_p", F.col("utilization_pct") >= threshold)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, p = F.col("_y"), F.col("_p")
    row = with_scalars(joined.agg(n(y & p).alias("true_positives"), n(~y & p).alias("false_positives"), n(y & ~p).alias("_fn"), n(~y & ~p).alias("true_negatives")), unmatched)
    row = row.withColumn("false_negatives", F.col("_fn") + F.col("_missing"))
    value = hits.join(truth.select("truth_id", "required_total_hours_truth"), ["truth_id"]).filter(F.col("required_total_hours_truth").isNotNull())
    value = value.groupBy("capacity_record_id").agg(F.avg("required_total_hours_truth").alias("_t")).join(calendar.select("capacity_record_id", "required_total_hours"), ["capacity_record_id"])
    row = with_scalars(row, value.agg(F.avg(F.abs(F.col("required_total_hours") - F.col("_t"))).alias("workload_mae"), F.count(F.lit(1)).alias("workload_mae_rows")))
    return row.withColumns({"overload_precision": share("true_positives", F.col("true_positives") + F.col("false_positives")),
                            "overload_recall": share("true_positives", F.col("true_positives") + F.col("false_negatives"))}).drop("_fn", "_missing")


def threshold_sensitivity(calendar: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """How many rep-periods lie at or above each utilisation threshold."""
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold_pct"), (F.col("utilization_pct") >= t).alias("_hit")) for t in thresholds])
    return calendar.select(F.inline(cells)).groupBy("threshold_pct").agg(F.sum(F.col("_hit").cast("long")).alias("overloaded_rows"), A.rate(F.col("_hit")).alias("overload_rate"))


def flagged_counts(scored: DataFrame, label: str, flag: str) -> DataFrame:
    """One row: observations, positive_support, selected, captured, false_positives, precision, recall (null without positives)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    y, p = F.coalesce(F.col(label), F.lit(False)), F.coalesce(F.col(flag), F.lit(False))
    row = scored.agg(F.count(F.lit(1)).alias("observations"), n(y).alias("positive_support"), n(p).alias("selected"), n(y & p).alias("captured"), n(~y & p).alias("false_positives"))
    return row.withColumn("precision", share("captured", "selected")).withColumn("recall", F.try_divide(F.col("captured"), F.col("positive_support")))


def undercoverage_rows(clean: DataFrame, injected: DataFrame, truth: DataFrame, probability: float = 0.95) -> DataFrame:
    """How the rule "gap above the clean table's percentile" finds the records named by ``truth`` (one row).

    ``truth``: truth_id, record_ids (array).  Records that the injected table does not hold support nothing.
    """
    cut = quantiles(clean, [], "priority_customer_coverage_gap", {"threshold": probability})
    named = truth.select(F.explode("record_ids").alias("capacity_record_id")).distinct().withColumn("_y", F.lit(True))
    marked = with_scalars(injected.join(named, ["capacity_record_id"], "left"), cut)
    marked = marked.withColumn("_p", F.col("priority_customer_coverage_gap") > F.col("threshold"))
    return with_scalars(flagged_counts(marked, "_y", "_p"), cut)


def scenario_type_rows(clean: DataFrame, injected: DataFrame, truth: DataFrame, overload: str, undercoverage: str, threshold: float = 100.0, probability: float = 0.95) -> DataFrame:
    """One row per capacity scenario: support, what its rule selected and captured, precision and recall.

    ``truth`` is what ``evaluate_capacity`` takes, with the column scenario.  Overload is matched record by record;
    a truth row that no record carries counts as missed.  ``recall`` is null where nothing was to be found.
    """
    of = lambda name: truth.filter(F.col("scenario") == name)
    size = lambda name: of(name).agg(F.count(F.lit(1)).alias("overall_truth_support"))
    over = evaluate_capacity(injected, of(overload).drop("scenario"), threshold)
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("true_positives", "false_positives", "false_negatives"))
    over = with_scalars(over, injected.agg(F.count(F.lit(1)).alias("observations"))).select(
        F.lit(overload).alias("scenario"), "observations", (tp + fn).alias("positive_support"), (tp + fp).alias("selected"), tp.alias("captured"), fp.alias("false_positives"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.lit(float(threshold)).alias("threshold"))
    under = undercoverage_rows(clean, injected, of(undercoverage), probability).withColumn("scenario", F.lit(undercoverage))
    rows = with_scalars(over, size(overload)).unionByName(with_scalars(under, size(undercoverage)))
    return rows.withColumn("support_status", F.when(F.col("positive_support") > 0, "evaluated").otherwise("no_support"))


def rank_shift(clean: DataFrame, injected: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """Units of either table with both values, their ranks (highest first, ties averaged) and the shift.

    A unit that only one table has, or whose value is null in one, has no rank.  Positive shift: the unit rose.
    Both tables hold one row per unit; they are paired in one shuffle, null keys included.
    """
    both = clean.select(*unit, F.col(value).cast("double").alias("clean_value")).unionByName(
        injected.select(*unit, F.col(value).cast("double").alias("injected_value")), allowMissingColumns=True)
    both = both.groupBy(*unit).agg(F.max("clean_value").alias("clean_value"), F.max("injected_value").alias("injected_value"))
    paired = F.col("clean_value").isNotNull() & F.col("injected_value").isNotNull()
    both = checkpointed(both.withColumns({"_clean": F.when(paired, F.col("clean_value")), "_injected": F.when(paired, F.col("injected_value"))}))
    ranked = average_rank(average_rank(both, [], "_clean", "clean_rank"), [], "_injected", "injected_rank")
    return ranked.drop("_clean", "_injected").withColumn("rank_shift", F.col("clean_rank") - F.col("injected_rank"))


def rank_sensitivity(shifts: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Agreement of two rankings, one row per threshold on the value.

    Units above it in each ranking and in both, their overlap (shared over either; null when no unit is above), with
    the rank correlation and the mean and largest shift of all paired units (correlation null for constant ranks).
    """
    a, b = F.col("clean_rank"), F.col("injected_rank")
    paired = shifts.filter(a.isNotNull() & b.isNotNull())
    whole = paired.agg(
        F.count(F.lit(1)).alias("paired_units"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("spearman"),
        F.avg(F.abs("rank_shift")).alias("mean_abs_shift"), F.max(F.abs("rank_shift")).alias("max_abs_shift"))
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col("clean_value") >= t).alias("_c"), (F.col("injected_value") >= t).alias("_i")) for t in thresholds])
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    rows = paired.select(F.inline(cells)).groupBy("threshold").agg(
        n(F.col("_c")).alias("clean_above"), n(F.col("_i")).alias("injected_above"), n(F.col("_c") & F.col("_i")).alias("both_above"), n(F.col("_c") | F.col("_i")).alias("_any"))
    return with_scalars(rows.withColumn("overlap", F.try_divide(F.col("both_above"), F.col("_any"))).drop("_any"), whole)


def raise_required_total(df: DataFrame, target: str, component: str, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Lift the required total to a target by raising one component, then recompute what depends on it."""
    need = F.greatest((F.col(target) - F.col("required_total_hours")) / (1 + rules.buffer), F.lit(0.0))
    return hours_and_fte(df.withColumn(component, F.col(component) + need), rules)


def recalculate(df: DataFrame, rules: CapacityRules = CapacityRules()) -> DataFrame:
    """Recompute hours, FTE, utilisation and bands after a component changed."""
    return hours_and_fte(df, rules)
