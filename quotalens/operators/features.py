"""Rep-period facts, as-of context and the assembled feature stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from quotalens.functions import (
    exact_id, finite_or, finite_or_null, first_match, missing_flag, month_start, ratio_or, right_closed_band, tenure_months,
)
from quotalens.operators import aggregates as A, history as H, shares as S
from quotalens.operators.joins import assemble
from quotalens.session import checkpointed, sent
from quotalens.operators.peers import peer_statistics, potential_residual, wide_by_metric, with_peer_means
from quotalens.operators.ranking import null_safe_join, percent_rank_average, percent_ranks, quantiles, with_totals


def customer_context(orders: DataFrame, customer: str, period: str, value: str) -> DataFrame:
    """Customer potential and priority known before each period, from earlier sales only."""
    h = orders.groupBy(customer, period).agg(F.sum(F.abs(F.col(value))).alias("_s"))
    h = h.withColumn("_prior", H.prior_total("_s", [customer], period))
    h = with_totals(percent_rank_average(h, [period], "_prior", "_pct"), [period], _top=F.max("_prior"))
    potential = F.when(F.col("_top") <= 0, 50.0).otherwise(10.0 + 90.0 * F.col("_pct"))
    potential = F.greatest(F.lit(1.0), F.least(F.lit(100.0), potential))
    out = h.select(customer, period, potential.alias("potential"))
    return out.withColumn("priority", first_match([(F.col("potential") >= 75, "high"), (F.col("potential") >= 40, "medium")], "low"))


def territory_context(orders: DataFrame, territory: str, customer: str, period: str, value: str) -> DataFrame:
    """Territory potential known before each period, from earlier sales and customers."""
    sales = orders.groupBy(territory, period).agg(F.sum(F.abs(F.col(value))).alias("_s"))
    firsts = orders.groupBy(territory, customer).agg(F.min(period).alias(period)).groupBy(territory, period).agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    h = sales.join(firsts, [territory, period], "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)))
    h = h.withColumn("_ps", H.prior_total("_s", [territory], period)).withColumn("_pn", H.prior_total("_n", [territory], period))
    h = percent_ranks(h, [period], {"_ps": "_a", "_pn": "_b"})
    h = with_totals(h, [period], _top=F.max("_ps"))
    potential = F.when(F.col("_top") <= 0, 50.0).otherwise(50.0 + 25.0 * (F.col("_a") + F.col("_b") - 1.0))
    return h.select(territory, period, F.greatest(F.lit(1.0), F.least(F.lit(100.0), potential)).alias("potential"))


def order_facts(orders: DataFrame, keys: Sequence[str], net: str = "net_sales", gross: str = "gross_sales") -> DataFrame:
    """Gross, net, counts, mean and largest order, period-end share and average price per rep-period."""
    end = F.col("end_of_period_flag")
    out = orders.groupBy(*keys).agg(
        F.sum(gross).alias("gross_sales"), F.sum(net).alias("net_sales"), F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("order_count"), F.avg(net).alias("average_order_value"),
        F.max(F.abs(F.col(net))).alias("maximum_order_value"), F.sum(end.cast("long")).alias("end_period_order_count"),
        F.sum(F.when(end, F.col(net)).otherwise(0.0)).alias("end_period_sales"))
    return (
        out.withColumn("end_of_period_sales_share", ratio_or("end_period_sales", F.abs(F.col("net_sales"))))
        .withColumn("average_selling_price", ratio_or("net_sales", "total_quantity"))
        .withColumn("order_frequency", F.col("order_count") / 21.0)
        .withColumn("unusual_order_timing_score", F.col("end_period_order_count") / F.greatest(F.col("order_count"), F.lit(1)))
    )


def price_deviation(orders: DataFrame, keys: Sequence[str], product: str, period: str, price: str) -> DataFrame:
    """Mean relative distance from the product's earlier monthly median prices."""
    monthly = quantiles(orders, [product, period], price, {"_price": 0.5})
    norms = monthly.select(product, period, H.prior_expanding_median("_price", [product], period).alias("_norm"))
    joined = orders.join(norms, [product, period], "left").withColumn("_norm", F.coalesce("_norm", F.col(price).cast("double")))
    return joined.groupBy(*keys).agg(F.avg(ratio_or(F.col(price) - F.col("_norm"), "_norm")).alias("product_price_deviation"),
                                     F.count_distinct(product).alias("active_product_count"))


def return_facts(returns: DataFrame, rep: str = "rep_id") -> DataFrame:
    """Returns by the month they became visible, plus post-payout amounts by payout month."""
    seen = returns.withColumn("period", month_start("return_date")).groupBy(rep, "period").agg(
        F.sum("return_amount").alias("return_amount"), F.count(F.lit(1)).alias("return_count"),
        F.sum(F.col("cancellation_flag").cast("long")).alias("cancellation_count"))
    late = returns.filter("after_incentive_payout_flag").groupBy(rep, F.col("payout_period").alias("period")).agg(
        F.sum("return_amount").alias("post_payout_return_amount"))
    out = seen.join(late, [rep, "period"], "full_outer")
    return out.select(rep, "period", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns if c not in (rep, "period")])


def visit_facts(visits: DataFrame, orders: DataFrame, keys: Sequence[str], customer: str, net: str = "net_sales") -> DataFrame:
    """Completed visits, durations, short-visit rate, travel and customers that bought in the period."""
    out = visits.groupBy(*keys).agg(
        F.sum(F.col("visit_completed_flag").cast("long")).alias("completed_visit_count"),
        F.avg("visit_duration_minutes").alias("average_visit_duration"),
        A.rate(F.col("visit_duration_minutes") < 10).alias("extremely_short_visit_rate"),
        F.sum("estimated_travel_km").alias("estimated_visit_travel_km"))
    bought = orders.groupBy(*keys, customer).agg(F.sum(net).alias("_s")).filter("_s > 0")
    met = visits.filter("visit_completed_flag").select(*keys, customer).distinct().join(bought, [*keys, customer], "left_semi")
    converted = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("visit_converted_customer_count"))
    return out.join(converted, list(keys), "left").withColumn(
        "visit_converted_customer_count", F.coalesce("visit_converted_customer_count", F.lit(0)))


def interaction_facts(crm: DataFrame, keys: Sequence[str]) -> DataFrame:
    return crm.groupBy(*keys).agg(F.count(F.lit(1)).alias("crm_interaction_count"),
                                  F.avg("sentiment_or_interest_score").alias("average_interest_score"))


def expense_facts(expenses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claimed and expected amounts, missing receipts and repeated claims per rep-period."""
    sums = expenses.groupBy(*keys).agg(
        F.sum("claimed_distance_km").alias("claimed_distance_km"), F.sum("estimated_distance_km").alias("estimated_distance_km"),
        F.sum("claimed_amount").alias("claimed_expense_amount"), F.sum("expected_amount").alias("expected_expense_amount"),
        (1 - A.rate(F.col("receipt_available_flag"))).alias("missing_receipt_rate"))
    repeats = A.duplicate_share(expenses, keys, [*keys, "visit_id", "expense_category", "claimed_amount"], "duplicate_expense_signal")
    return sums.join(repeats, list(keys), "left")


def entity_master(facts: DataFrame, entity: str, day: str, tie: str, reference_end, attributes: Mapping[str, str],
                  measures: Mapping[str, object]) -> DataFrame:
    """One row per entity with attributes frozen at a reference date.

    Entities seen by then are described by their rows up to that date; later ones only by their
    first row.
    """
    cutoff = F.to_date(F.lit(reference_end))
    firsts = facts.groupBy(entity).agg(F.min(day).alias("_first"), F.min_by(tie, F.struct(day, tie)).alias("_first_row"))
    joined = facts.join(firsts, [entity])
    known = F.when(F.col("_first") <= cutoff, F.col(day) <= cutoff).otherwise(F.col(tie) == F.col("_first_row"))
    kept = joined.filter(known)
    out = kept.groupBy(entity).agg(F.min("_first").alias("first_seen"), *[c.alias(n) for n, c in measures.items()])
    for name, c in attributes.items():
        out = out.join(S.dominant_member(kept, [entity], c, name), [entity], "left")
    return out


# --- extended store: rep × class × month ----------------------------------------------------

EXTENDED_METRICS = ("total_sales", "total_quantity", "distinct_customers", "simulated_actual_payout")
EXTENDED_LEVELS = {
    "product_class|peer_country|team|date": ["product_class", "peer_country", "team", "date"],
    "product_class|peer_country|date": ["product_class", "peer_country", "date"],
    "product_class|date": ["product_class", "date"],
    "date": ["date"],
}

# The demonstration payout plan and its formulas, in evaluation order.
DEMO_PLAN = {
    "target_growth": 0.03, "base_incentive": 250.0, "attainment_component": 750.0, "attainment_cap": 2.0,
    "accelerator_threshold": 1.0, "accelerator_amount": 500.0, "adjustment": 0.0,
}
DEMO_COLD_START_TARGET = 100000.0
DEMO_FORMULAS = {
    "simulated_target_sales": "greatest(historical_target * (1 + target_growth), 1)",
    "simulated_target_attainment_pct": "100 * greatest(total_sales, 0) / simulated_target_sales",
    "simulated_expected_incentive": "base_incentive + attainment_component * least(simulated_target_attainment_pct / 100, attainment_cap)"
                                    " + accelerator_amount * greatest(simulated_target_attainment_pct / 100 - accelerator_threshold, 0)",
    "simulated_adjustment": "adjustment",
    "simulated_actual_payout": "simulated_expected_incentive + simulated_adjustment",
}
DEMO_RATIOS = {
    "simulated_payout_delta": "simulated_actual_payout - simulated_expected_incentive",
    "simulated_payout_delta_pct": "100 * simulated_payout_delta / greatest(abs(simulated_expected_incentive), 1)",
    "simulated_payout_to_sales_ratio": "simulated_actual_payout / greatest(abs(total_sales), 1)",
}


def class_population(tx: DataFrame) -> DataFrame:
    """Rep × product class × month with customers, mixes, concentrations and ids.

    Input columns: representative, manager, team, country, date, product_class, customer,
    product, distributor, channel, subchannel, city, latitude, longitude, quantity, price, sales.
    """
    series, grain = ["representative", "product_class"], ["representative", "product_class", "date"]
    distinct = {"distinct_customers": "customer", "distinct_products": "product", "distinct_cities": "city", "distributor_count": "distributor"}
    dispersion = {"latitude_dispersion": "latitude", "longitude_dispersion": "longitude"}
    concentrated, mixed, changing = ("customer", "product", "city", "distributor"), ("country", "channel", "subchannel"), ("product", "distributor")
    # a country's weight, or its rows where the period's values are all zero
    weight = F.when(F.col("_gross") > 0, F.col("_w_country")).otherwise(F.col("_n_country").cast("double"))
    peer = F.min_by("country", F.when(F.col("_n_country").isNotNull(), F.struct(-weight, F.col("country")))).alias("peer_country")
    used = dict.fromkeys([*grain, *distinct.values(), *dispersion.values(), *concentrated, *mixed, "manager", "team", "sales", "quantity", "price"])
    out = S.member_history(
        tx.select(*used), series, "date", "sales", ["manager", "team"], {c: c for c in (*concentrated, *mixed)}, distinct, {c: f"{c}_mix_change" for c in changing}, "customer",
        [*A.grain_totals(dispersion=dispersion), A.token_join("country").alias("country"), peer])
    # rows without a key have totals only
    known = F.lit(True)
    for c in grain:
        known = known & F.col(c).isNotNull()
    parts = {"country": "country", "peer_country": "peer_country", "new_customers": "new_members", "repeat_customer_ratio": "repeat_ratio", "customer_loss_rate": "loss_rate", "manager": "manager", "team": "team"}
    for c in concentrated:
        parts[f"{c}_concentration"] = f"{c}_hhi"
        if c == "product":
            parts["dominant_product_share"] = "product_top_share"
    parts |= {f"{c}_mix": f"{c}_diversity" for c in mixed} | {f"{c}_mix_change": f"{c}_mix_change" for c in changing}
    out = out.select(*grain, "total_sales", "total_quantity", "transaction_count", "average_price", "median_price", *distinct, *dispersion,
                     *[F.when(known, F.col(c)).alias(name) for name, c in parts.items()])
    out = out.withColumn("geographic_spread", F.hypot(F.coalesce("latitude_dispersion", F.lit(0.0)), F.coalesce("longitude_dispersion", F.lit(0.0))))
    return out.withColumn("observation_id", exact_id("obs", "representative", "product_class", F.date_format("date", "yyyy-MM-dd 00:00:00")))


def demo_incentives(population: DataFrame, months: int = 3) -> DataFrame:
    """Target from the prior months' median sales, and the payout it implies."""
    from quotalens.functions import with_formulas
    prior = H.calendar_prior("total_sales", months, "median", ["representative", "product_class"], "date")
    df = population.withColumn("historical_target", F.coalesce(prior, F.lit(DEMO_COLD_START_TARGET)))
    return with_formulas(df, DEMO_FORMULAS, DEMO_PLAN).drop("historical_target")


def extended_features(population: DataFrame, minimum_peers: int = 4) -> tuple[DataFrame, list[str]]:
    """The rep × class × month feature store and the names of its model features."""
    from quotalens.functions import ratio_floored, with_formulas
    key = ["representative", "product_class"]
    before = set(population.columns)
    f = population.withColumn("average_transaction_value", ratio_floored("total_sales", "transaction_count"))
    f = f.withColumn("sales_per_transaction", F.col("average_transaction_value"))
    f = f.withColumn("sales_per_customer", ratio_floored("total_sales", "distinct_customers"))
    f = A.share_of_total(f, ["representative", "date"], "total_sales", "product_class_share")
    f = with_formulas(f, DEMO_RATIOS)
    f = H.metric_history(f, EXTENDED_METRICS, key, "date")
    f = f.withColumn("customer_growth", F.col("distinct_customers_month_over_month_growth"))
    prior = H.calendar_lag("distinct_products", 1, key, "date")
    f = f.withColumn("product_breadth_change", ratio_floored(F.col("distinct_products") - prior, prior))

    peers = peer_statistics(population, "observation_id", EXTENDED_METRICS, EXTENDED_LEVELS, minimum_peers)
    wide = wide_by_metric(peers, "observation_id", EXTENDED_METRICS, {"robust_z": "peer_z", "peer_percentile": "peer_percentile", "peer_median": "peer_median"})
    from quotalens.operators.peers import cohort_relative
    cohorts = {"team": ["team", "date"], "product_class": ["product_class", "date"], "peer_country_product_class": ["peer_country", "product_class", "date"]}
    rel = cohort_relative(population, "observation_id", EXTENDED_METRICS, cohorts)
    rel = rel.groupBy("observation_id").agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("cohort") == c), F.col("relative"))).alias(f"{m}_{c}_relative")
        for m in EXTENDED_METRICS for c in cohorts])
    ranks = population.select("observation_id", *key, "date", "total_sales")
    from quotalens.operators.ranking import average_rank
    ranks = average_rank(ranks, ["product_class", "date"], "total_sales", "representative_rank")
    ranks = ranks.withColumn("rank_change", F.col("representative_rank") - H.calendar_lag("representative_rank", 1, key, "date"))
    f = assemble(f, [wide, rel, ranks.select("observation_id", "representative_rank", "rank_change")], ["observation_id"])
    text = {n for n, t in f.dtypes if t in ("string", "date", "boolean")}
    features = [c for c in f.columns if c not in text and c not in ("simulated_target_sales",)]
    return f.select(*[finite_or_null(c).alias(c) if c in features and t == "double" else F.col(c) for c, t in f.dtypes]), features


# --- review store: rep × month --------------------------------------------------------------

REVIEW_PEER_METRICS = {"net_sales": "sales", "final_incentive_paid": "incentive", "average_discount_pct": "discount", "claimed_expense_amount": "expense"}
REVIEW_LEVELS = {"commercial_peer_group": ["peer_group_id", "period"], "team_period": ["team_id", "period"],
                 "territory_period": ["territory_id", "period"], "period": ["period"]}
REVIEW_MINIMUM = {"commercial_peer_group": 3, "team_period": 3, "territory_period": 3, "period": 1}


def review_features(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str], DataFrame]:
    """Rep-period store over all facts, its model features, and the long peer comparison.

    Tables: orders, product_master, customer_master, discount_detail, returns_cancellations,
    field_visits, crm_interactions, travel_expenses, incentive_calculations, rep_targets_quotas,
    capacity_calendar, rep_master (rep_id, team_id, manager_id, territory_id, hire_date) and
    territory_master (territory_id, travel_complexity_index).
    """
    key = ["rep_id", "period"]
    orders = tables["orders"]
    priced = orders.join(tables["product_master"].select("product_id", "incentive_weight"), ["product_id"], "left")
    context = customer_context(orders, "customer_id", "period", "net_sales").select(
        "customer_id", "period", F.col("potential").alias("_potential"), F.col("priority").alias("_priority"))
    placed = orders.join(context, ["customer_id", "period"], "left")

    facts = [order_facts(orders, key)]
    facts.append(A.duplicate_share(orders, key, [*key, "customer_id", "product_id", "order_date", "net_sales"], "duplicate_order_signal"))
    facts.append(price_deviation(orders, key, "product_id", "period", "unit_list_price"))
    facts.append(A.conditional_sums(priced, key, {"highly_incentivized_product_sales": (F.col("incentive_weight") >= 1.15, "net_sales")}))
    for c, prefix in (("product_id", "product"), ("customer_id", "customer")):
        h = S.concentration(orders, key, c, "net_sales", prefix, basis="net")
        facts.append(h.select(*key, F.col(f"{prefix}_hhi").alias(f"{prefix}_concentration_hhi"), F.col(f"{prefix}_top_share").alias(f"top_{prefix}_sales_share")))
        facts.append(S.mix_shift(orders, ["rep_id"], "period", c, "net_sales", f"{prefix}_mix_shift", basis="net", first="empty"))
    facts.append(placed.groupBy(*key).agg(
        F.count_distinct("customer_id").alias("active_customer_count"), F.sum("net_sales").alias("total_customer_sales"),
        F.sum(F.when(F.col("_priority") == "high", F.col("net_sales")).otherwise(0.0)).alias("_high"),
        F.sum(F.when(F.col("_potential") <= 35, F.col("net_sales")).otherwise(0.0)).alias("_low")))
    facts.append(S.first_purchases(orders, "rep_id", "customer_id", "period", "net_sales", "new_customer_count"))
    channels = orders.drop("channel").join(tables["customer_master"].select("customer_id", "channel"), ["customer_id"], "left")
    facts.append(S.concentration(channels, key, "channel", "net_sales", "channel").select(*key, "channel_hhi"))
    detail = tables["discount_detail"]
    if "period" not in detail.columns:
        detail = detail.join(orders.select("order_line_id", "period"), ["order_line_id"], "left")
    facts.append(detail.groupBy(*key).agg(
        F.avg("discount_pct").alias("average_discount_pct"), F.max("discount_pct").alias("maximum_discount_pct"),
        (1 - A.rate(F.col("approved_flag"))).alias("unapproved_discount_rate")))
    facts.append(return_facts(tables["returns_cancellations"]))
    facts.append(visit_facts(tables["field_visits"], orders, key, "customer_id"))
    facts.append(interaction_facts(tables["crm_interactions"], key))
    facts.append(expense_facts(tables["travel_expenses"], key))
    facts.append(tables["capacity_calendar"])
    targets = tables["rep_targets_quotas"]
    base = assemble(tables["incentive_calculations"], [targets, *facts], key)

    reps = tables["rep_master"]
    base = base.drop("team_id", "manager_id", "territory_id", "hire_date").join(
        reps.select("rep_id", "team_id", "manager_id", F.col("territory_id").alias("_home"), "hire_date"), ["rep_id"], "left")
    base = base.join(S.dominant_member(orders, key, "territory_id", "territory_id"), key, "left").withColumn(
        "territory_id", F.coalesce("territory_id", "_home")).drop("_home")
    base = base.join(tables["territory_master"].select("territory_id", "travel_complexity_index"), ["territory_id"], "left")
    potential = territory_context(orders, "territory_id", "customer_id", "period", "net_sales").withColumnRenamed("potential", "territory_potential")
    base = base.join(potential, ["territory_id", "period"], "left").withColumn("territory_potential", F.coalesce("territory_potential", F.lit(50.0)))
    base = base.withColumn("tenure_months", tenure_months("period", "hire_date"))
    base = base.withColumn("observation_id", exact_id("RPER", "rep_id", "period"))
    base = base.withColumn("tenure_band", right_closed_band("tenure_months", [24, 60], ["developing", "experienced", "senior"]))
    base = base.withColumn("peer_group_id", F.concat_ws(
        "|", "team_id", right_closed_band("territory_potential", [40, 70], ["lower", "medium", "higher"]), "tenure_band",
        right_closed_band("travel_complexity_index", [2, 3.5], ["compact", "mixed", "distributed"])))

    rows = lambda c, n, stat, k=1: H.row_prior(c, n, stat, ["rep_id"], "period", k)
    previous = lambda c: F.lag(c).over(H.W.partitionBy("rep_id").orderBy("period"))
    r = ratio_or
    first = {
        "rolling_sales_mean": rows("net_sales", 3, "mean"), "rolling_sales_std": rows("net_sales", 6, "std", 2),
        "rep_historical_mean": rows("net_sales", 6, "mean"), "rep_historical_std": rows("net_sales", 6, "std", 2),
        "_incentive_std": rows("final_incentive_paid", 6, "std", 2), "_incentive_mean": rows("final_incentive_paid", 3, "mean"),
        "_previous_sales": previous("net_sales"), "_previous_quantity": previous("total_quantity"), "_previous_incentive": previous("final_incentive_paid"),
        "highly_incentivized_product_share": r("highly_incentivized_product_sales", F.abs(F.col("net_sales"))),
        "high_priority_customer_share": r("_high", F.abs(F.col("total_customer_sales"))),
        "low_potential_customer_sales_share": r("_low", F.abs(F.col("total_customer_sales"))),
        "product_mix_entropy": S.entropy_proxy("product_concentration_hhi"),
        "discount_spike": F.col("maximum_discount_pct") - F.col("average_discount_pct"),
        "incentive_calculation_residual": F.col("final_incentive_paid") - F.col("calculated_incentive") - F.col("manual_adjustment"),
        "manual_adjustment_ratio": r("manual_adjustment", "calculated_incentive"),
        "accelerator_cliff_distance": F.least(*[F.abs(F.col("attainment_pct") - x) for x in (80, 100, 120)]),
        "return_rate": r("return_amount", F.abs(F.col("net_sales"))),
        "post_incentive_return_rate": r("post_payout_return_amount", F.abs(F.col("net_sales"))),
        "return_clawback_ratio": r("return_clawback", "final_incentive_paid"),
        "cancelled_order_rate": r("cancellation_count", "order_count"),
        "visits_per_customer": r("completed_visit_count", "active_customer_count"),
        "sales_per_visit": r("net_sales", "completed_visit_count"),
        "visit_to_sales_conversion": r("visit_converted_customer_count", "completed_visit_count"),
        "crm_interactions_per_customer": r("crm_interaction_count", "active_customer_count"),
        "distance_claim_ratio": r("claimed_distance_km", "estimated_distance_km"),
        "expense_per_visit": r("claimed_expense_amount", "completed_visit_count"),
        "sales_vs_territory_potential": r("net_sales", "territory_potential"),
    }
    base = base.withColumns(first)
    second = {
        "low_volume_product_spike": F.col("product_mix_shift") * F.col("highly_incentivized_product_share"),
        "sales_growth": r(F.col("net_sales") - F.col("_previous_sales"), "_previous_sales"),
        "quantity_growth": r(F.col("total_quantity") - F.col("_previous_quantity"), "_previous_quantity"),
        "incentive_growth": r(F.col("final_incentive_paid") - F.col("_previous_incentive"), "_previous_incentive"),
        "sales_volatility": r("rolling_sales_std", "rolling_sales_mean"), "incentive_volatility": r("_incentive_std", "_incentive_mean"),
        "rep_historical_z_score": r(F.col("net_sales") - F.col("rep_historical_mean"), F.greatest(F.abs(F.col("rep_historical_std")), F.lit(1.0))),
    }
    base = base.withColumns(second).drop("_incentive_std", "_incentive_mean", "_previous_sales", "_previous_quantity", "_previous_incentive", "_high", "_low")

    base = checkpointed(base)  # peers, residuals and cohort medians all start from this table
    peers = peer_statistics(base, "observation_id", list(REVIEW_PEER_METRICS), REVIEW_LEVELS, REVIEW_MINIMUM, "period")
    wide = wide_by_metric(peers, "observation_id", list(REVIEW_PEER_METRICS), {"robust_z": "peer_z", "peer_percentile": "peer_percentile", "peer_median": "peer_median"})
    wide = wide.select("observation_id", *[
        F.col(f"{m}_{s}").alias(f"{label}_{s}") for m, label in REVIEW_PEER_METRICS.items() for s in ("peer_z", "peer_percentile", "peer_median")])
    base = base.join(wide, ["observation_id"], "left")
    base = potential_residual(base, ["period"], "net_sales", "territory_potential", "territory_adjusted_sales_residual")
    base = potential_residual(base, ["period"], "final_incentive_paid", "territory_potential", "territory_adjusted_incentive_residual")
    tenure = quantiles(base, ["period", "tenure_band"], "net_sales", {"_tenure_median": 0.5})
    base = null_safe_join(base, tenure, ["period", "tenure_band"], "left")
    behaviour = [F.abs(F.col(c)) for c in ("sales_growth", "customer_mix_shift", "product_mix_shift", "discount_spike")]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in behaviour), F.lit(0))
    third = {
        "payout_to_peer_median_ratio": r("final_incentive_paid", "incentive_peer_median"),
        "discount_vs_peer": F.col("average_discount_pct") - F.col("discount_peer_median"),
        "expense_vs_peer": r("claimed_expense_amount", "expense_peer_median"),
        "tenure_adjusted_performance": r(F.col("net_sales") - F.col("_tenure_median"), "_tenure_median"),
        "product_mix_adjusted_performance": F.col("sales_peer_z") - F.coalesce("product_mix_shift", F.lit(0.0)),
        "channel_adjusted_performance": F.col("sales_peer_z") - F.coalesce("channel_hhi", F.lit(0.0)),
        "month_over_month_behavior_change": sum((F.coalesce(c, F.lit(0.0)) for c in behaviour), F.lit(0.0)) / F.when(known > 0, known),
        "threshold_crossing_discount_signal": F.when(
            F.col("attainment_pct").between(100, 105) & (F.col("average_discount_pct") > F.col("discount_peer_median") + 0.04), 1).otherwise(0),
    }
    base = base.withColumns(third).drop("_tenure_median")
    base = base.withColumn("rolling_anomaly_score", rows("month_over_month_behavior_change", 3, "mean"))
    cold = ["rolling_sales_mean", "rolling_sales_std", "rep_historical_mean", "rep_historical_std"]
    base = base.withColumns({f"{c}_missing": missing_flag(c) for c in cold})
    from quotalens.operators.quality import label_columns
    labels = set(label_columns(base))
    numeric = [n for n, t in base.dtypes if t in ("double", "bigint", "int", "float") and n not in labels and n not in ("target_version", "rep_id")]
    base = base.select(*[finite_or(F.col(c).cast("double")).alias(c) if c in numeric else F.col(c) for c in base.columns])
    return base, numeric, peers


# --- legacy store: rep × product × territory × month ----------------------------------------

LEGACY_LEVELS = {"product_territory": ["product_name", "territory_id", "date"], "product_team": ["product_name", "sales_team", "date"],
                 "product": ["product_name", "date"], "date": ["date"]}


def legacy_grain(assigned: DataFrame) -> DataFrame:
    """Totals, usual attributes, concentrations, portfolio size and territory density at the legacy grain.

    Input columns: rep_id, territory_id, product_name, date, customer, sales, quantity, price,
    latitude, longitude, country, city, product_class, channel, subchannel, sales_manager, sales_team.
    """
    grain = ["rep_id", "product_name", "territory_id", "date"]
    usual = ["country", "city", "product_class", "channel", "subchannel", "sales_manager", "sales_team"]
    means = ("price", "latitude", "longitude")
    lines = assigned.repartition(*grain).groupBy(*grain, *usual, "customer").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("sales").alias("_v"), F.sum(F.coalesce("sales", F.lit(0.0))).alias("_sales"), F.sum(F.coalesce("quantity", F.lit(0.0))).alias("_quantity"),
        *[F.sum(c).alias(f"_sum_{c}") for c in means], *[F.count(c).alias(f"_count_{c}") for c in means])
    mean = lambda c: F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}"))
    totals = [F.sum("_sales").alias("total_sales"), F.sum("_quantity").alias("total_quantity"), mean("price").alias("average_price"),
              mean("latitude").alias("latitude"), mean("longitude").alias("longitude"), F.sum("_n").alias("transaction_count")]
    out = S.member_summary(lines, grain, usual, [("customer", "customer_concentration"), ("channel", "channel_mix"), ("subchannel", "subchannel_mix")],
                           {"unique_customers": "customer"}, "_n", "_v", totals)
    out = out.withColumn("average_price", F.coalesce("average_price", ratio_or("total_sales", "total_quantity")))
    out = out.select(*grain, "total_sales", "total_quantity", "average_price", "unique_customers", "latitude", "longitude", "transaction_count", *usual,
                     "customer_concentration", "channel_mix", "subchannel_mix")
    portfolio = assigned.groupBy("rep_id").agg(F.count_distinct("customer").alias("assigned_customer_portfolio"))
    area = assigned.groupBy("territory_id").agg(
        F.count_distinct("customer").alias("territory_customer_count"), F.stddev_samp("latitude").alias("_lat"), F.stddev_samp("longitude").alias("_lon"))
    size = (1.0 + F.coalesce("_lat", F.lit(0.0)) * 111.0) * (1.0 + F.coalesce("_lon", F.lit(0.0)) * 85.0)
    area = area.withColumn("territory_customer_density", F.col("territory_customer_count") / F.greatest(size, F.lit(1.0))).drop("_lat", "_lon")
    # written first, so that Spark knows their size and moves no row of the grain for them
    return out.join(sent(checkpointed(portfolio)), ["rep_id"], "left").join(sent(checkpointed(area)), ["territory_id"], "left")


def legacy_features(data: DataFrame, minimum_peers: int = 3) -> DataFrame:
    """Growth, portfolio, productivity, incentive and peer features at the legacy grain.

    Activity and payout columns (total_calls, working_days, …) are used where present.
    """
    series, portfolio = ["rep_id", "product_name", "territory_id"], ["rep_id", "territory_id", "date"]
    # dealt once: a series and a portfolio's month lie inside a representative's territory
    f = data.repartition("rep_id", "territory_id").withColumn("row_id", exact_id("row", *series, "date"))
    prior = H.row_prior("total_sales", 3, "mean", series, "date")
    clip = lambda c: F.greatest(F.least(F.coalesce(finite_or_null(c), F.lit(0.0)), F.lit(10.0)), F.lit(-10.0))
    f = f.withColumn("_prior", prior).withColumns({
        "sales_growth": H.percent_change("total_sales", series, "date"), "quantity_growth": H.percent_change("total_quantity", series, "date"),
        "rolling_sales_growth": clip(ratio_or(F.col("total_sales") - F.col("_prior"), "_prior"))}).drop("_prior")
    # a portfolio's month has one row per product
    month = H.W.partitionBy(*portfolio)
    f = f.withColumns({"_portfolio_sales": F.sum("total_sales").over(month), "unique_products": F.count("product_name").over(month)})
    f = f.withColumn("product_sales_share", ratio_or("total_sales", "_portfolio_sales"))
    f = f.withColumns({"product_concentration": F.sum(F.col("product_sales_share") * F.col("product_sales_share")).over(month),
                       "dominant_product_share": F.max("product_sales_share").over(month)})
    f = f.withColumn("sales_per_customer", ratio_or("total_sales", "unique_customers")).withColumn(
        "sales_per_product", ratio_or("_portfolio_sales", "unique_products")).drop("_portfolio_sales")
    have = set(f.columns)
    ratios = {
        "sales_per_call": ("total_sales", "total_calls"), "calls_per_working_day": ("total_calls", "working_days"),
        "calls_per_customer": ("total_calls", "unique_customers_contacted"), "travel_per_customer": ("travel_distance_km", "unique_customers_contacted"),
        "incentive_to_sales_ratio": ("actual_incentive_paid", "total_sales"), "incentive_per_customer": ("actual_incentive_paid", "unique_customers"),
        "incentive_per_call": ("actual_incentive_paid", "total_calls"), "incentive_to_target_ratio": ("actual_incentive_paid", "target_incentive"),
        "market_potential_adjusted_sales": ("total_sales", "territory_market_potential"),
    }
    f = f.withColumns({n: ratio_or(a, b) for n, (a, b) in ratios.items() if {a, b} <= have})
    if {"total_calls", "digital_engagements"} <= have:
        f = f.withColumn("activity_efficiency", ratio_or("total_sales", F.col("total_calls") + F.col("digital_engagements")))
    if {"total_calls", "rep_capacity", "assigned_customer_portfolio"} <= have:
        f = f.withColumn("workload_index", 0.55 * ratio_or("total_calls", "rep_capacity") + 0.45 * ratio_or("assigned_customer_portfolio", "rep_capacity"))
    if {"actual_incentive_paid", "calculated_incentive"} <= have:
        f = f.withColumn("incentive_variance", F.col("actual_incentive_paid") - F.col("calculated_incentive"))
        f = f.withColumn("incentive_variance_pct", ratio_or("incentive_variance", F.abs(F.col("calculated_incentive"))))
    if "opportunity_index_raw" in have:
        from quotalens.operators.ranking import with_scalars
        raw = f.withColumn("_raw", F.coalesce("opportunity_index_raw", F.lit(0.0)))
        raw = with_scalars(raw, quantiles(raw, [], "_raw", {"_lo": 0.01, "_hi": 0.99}))
        scaled = (F.col("_raw") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
        f = raw.withColumn("opportunity_index", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_raw", "_lo", "_hi")
    for value, prefix in (("total_sales", "sales"), ("actual_incentive_paid", "incentive"), ("total_calls", "activity")):
        if value in have:
            f = with_peer_means(f, data, value, LEGACY_LEVELS, minimum_peers)
            center = F.col("_peer_median")
            f = f.withColumns({f"{prefix}_peer_median": center, f"{prefix}_vs_peer_median": ratio_or(F.col(value).cast("double") - center, F.abs(center)),
                               f"{prefix}_zscore_within_peer": F.col("_peer_z")}).drop("_peer_median", "_peer_mean", "_peer_std", "_peer_z")
    return f.select("row_id", *[c for c in f.columns if c != "row_id"])


# --- model feature choice -------------------------------------------------------------------

def feature_allowlist(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Numeric columns that are neither keys, context nor labels."""
    from quotalens.operators.quality import label_columns
    banned = set(excluded) | set(label_columns(df))
    return [n for n, t in df.dtypes if n not in banned and (t in ("double", "float", "bigint", "int", "smallint", "tinyint") or t.startswith("decimal"))]


def check_model_features(df: DataFrame, features: Sequence[str]) -> None:
    """Missing, repeated, label-like or non-numeric feature names are errors."""
    from quotalens.operators.quality import LEAK_WORDS
    if len(set(features)) != len(list(features)):
        raise ValueError("repeated feature names")
    types = dict(df.dtypes)
    missing = [c for c in features if c not in types]
    leaked = [c for c in features if any(w in c.lower() for w in LEAK_WORDS) or c in ("injected_anomaly_flag", "anomaly_severity")]
    text = [c for c in features if c in types and types[c] in ("string", "date", "boolean", "timestamp")]
    if missing or leaked or text:
        raise ValueError(f"missing={missing} labels={leaked} not numeric={text}")


def usable_features(train: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> list[str]:
    """Features with more than one distinct training value, plus named exceptions (one aggregate row)."""
    row = train.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(features)], *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(features)]).first()
    varied = [c for i, c in enumerate(features) if row[f"lo_{i}"] is not None and row[f"lo_{i}"] != row[f"hi_{i}"]]
    return varied + [c for c in features if c in keep and c not in varied]
