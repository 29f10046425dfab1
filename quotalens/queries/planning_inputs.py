"""Shared inputs of the incentive, capacity and planning queries (no queries of its own)."""

import datetime as dt

from pyspark.sql import functions as F

from quotalens.operators.incentives import policy_rules
from quotalens.operators.orders import order_arithmetic
from quotalens.queries.base import LEDGER, ledger, read
from quotalens.session import checkpointed

D = dt.date
VERSIONS = [
    {"policy_id": "P1", "policy_version": "1", "start": D(1995, 1, 1), "end": D(1997, 12, 31), "base_rate": 0.02, "maximum_payout": 6000.0, "payout_delay_days": 15},
    {"policy_id": "P1", "policy_version": "2", "start": D(1998, 1, 1), "end": D(2001, 12, 31), "base_rate": 0.03, "maximum_payout": 8000.0, "payout_delay_days": 20},
]
TIERS = [{"lower": 0.0, "upper": 0.5, "accelerator": 0.0, "decelerator": 0.5}, {"lower": 0.5, "upper": 1.0, "accelerator": 0.0, "decelerator": 0.8},
         {"lower": 1.0, "upper": 1.5, "accelerator": 0.5, "decelerator": 1.0}, {"lower": 1.5, "upper": 5.0, "accelerator": 1.0, "decelerator": 1.0}]
ORDERS_SQL = LEDGER + """
, o AS (SELECT *, abs(gross_sales) * discount_pct AS discount_amount, gross_sales - sign(gross_sales) * (abs(gross_sales) * discount_pct) AS net_sales FROM ledger)"""


def orders(spark, sf):
    led = ledger(spark, sf).withColumn("order_line_id", F.concat_ws("-", "order_id", "line_number", "product_id", "rep_id")).withColumn("territory_id", F.col("city"))
    return order_arithmetic(led).withColumn("unit_list_price", F.col("price"))


def products(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), (F.col("p_type") != "ECONOMY").alias("incentive_eligible_flag"), F.when(F.col("p_size") > 40, 1.2).otherwise(1.0).alias("incentive_weight"))


def targets(spark, sf):
    q = ledger(spark, sf).groupBy("rep_id", "period").agg(F.sum("quantity").alias("q"))
    return q.select("rep_id", "period", (F.col("q") * 500.0).alias("target_sales"))


def returns(spark, sf):
    day = F.greatest("ship_date", "order_date")
    return orders(spark, sf).filter("return_flag").select(
        F.col("order_line_id").alias("return_id"), "order_line_id", "rep_id", "customer_id", "product_id", F.col("period").alias("payout_period"), day.alias("return_date"),
        F.abs("net_sales").alias("return_amount"), (F.col("quantity") > 45).alias("cancellation_flag"), (day > F.date_add(F.last_day("period"), 15)).alias("after_incentive_payout_flag"))


def rules(spark):
    return policy_rules(spark, VERSIONS, TIERS)


def reps(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("rep_id"), F.col("r_name").alias("team_id"), F.col("n_name").alias("manager_id"), F.col("n_name").alias("territory_id"))


def visits(spark, sf, tx=None):
    return (ledger(spark, sf) if tx is None else tx).select(
        "rep_id", "customer_id", F.col("ship_date").alias("visit_date"), F.trunc("ship_date", "MM").alias("period"), F.col("city").alias("territory_id"),
        F.col("quantity").alias("visit_duration_minutes"), (F.col("discount_pct") * 100).alias("estimated_travel_km"), (~F.col("return_flag")).cast("string").alias("visit_completed_flag"))


def customers(spark, sf, tx=None):
    """All customers; those of one segment, and those without an order, have no owner of their own."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    active = (ledger(spark, sf) if tx is None else tx).groupBy("customer_id").agg(F.min("rep_id").alias("primary_rep_id"))
    priority = F.when(F.col("c_acctbal") > 6000, "high").when(F.col("c_acctbal") > 2000, "medium").otherwise("low")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("territory_id"), "c_mktsegment", priority.alias("customer_priority"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "monthly").otherwise(F.lit(None).cast("string")).alias("required_visit_frequency")).join(active, ["customer_id"], "left").withColumn(
        "primary_rep_id", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("primary_rep_id")))


def transactions(spark, sf, more=()):
    """The normalised transactions as one materialised table, read by every later step; only columns that one of them reads."""
    led = ledger(spark, sf).select("rep_id", "period", "customer_id", "city", "product_id", "distributor", "ship_date", "quantity", "discount_pct", "return_flag", *more)
    return checkpointed(led.withColumn("territory_id", F.col("city")))


def calculated_tables(spark, sf):
    """The relational layer of the rep × month review, derived from the ledger."""
    from quotalens.operators.capacity import CapacityRules, capacity_calendar
    from quotalens.operators.incentives import calculate_incentives, prior_informed_targets
    tx = transactions(spark, sf, ("channel", "price"))
    o = checkpointed(orders(spark, sf))
    rep = reps(spark, sf)
    hired = rep.join(o.groupBy("rep_id").agg(F.min("period").alias("hire_date")), ["rep_id"], "left")
    tgt = checkpointed(prior_informed_targets(o, products(spark, sf), hired, 90000, 200)).select("rep_id", "period", "target_sales", "target_units", "quota_difficulty_index")
    disc = o.select("order_line_id", "rep_id", "period", "discount_pct", (F.col("discount_pct") <= 0.07).alias("approved_flag"))
    ret = checkpointed(returns(spark, sf))
    vis = visits(spark, sf, tx).withColumn("visit_completed_flag", F.col("visit_completed_flag") == "true")
    crm = tx.select("rep_id", F.trunc("ship_date", "MM").alias("period"), F.col("price").alias("sentiment_or_interest_score"))
    exp = tx.select("rep_id", "period", F.col("customer_id").alias("visit_id"), F.col("city").alias("expense_category"), F.col("price").alias("claimed_distance_km"), F.col("quantity").alias("estimated_distance_km"),
                    F.col("quantity").alias("claimed_amount"), (F.col("quantity") * 2).alias("expected_amount"), (~F.col("return_flag")).alias("receipt_available_flag"))
    paid = checkpointed(calculate_incentives(o, disc, ret, tgt, products(spark, sf), rep.select("rep_id", "manager_id", "team_id", "territory_id"), rules(spark)))
    cal = checkpointed(capacity_calendar(tx, rep, customers(spark, sf, tx), visits(spark, sf, tx), CapacityRules())[0])
    keep = ["rep_id", "period", "available_field_hours", "required_total_hours", "utilization_pct", "required_fte", "available_fte", "fte_gap", "priority_customer_coverage_gap", "planned_travel_hours"]
    territory = rep.select("territory_id").distinct().withColumn("travel_complexity_index", F.length("territory_id") / 3.0)
    return {"orders": o, "product_master": products(spark, sf), "customer_master": tx.select("customer_id", "channel").distinct(), "discount_detail": disc, "returns_cancellations": ret, "field_visits": vis,
            "crm_interactions": crm, "travel_expenses": exp, "incentive_calculations": paid, "rep_targets_quotas": tgt, "capacity_calendar": cal.select(*keep),
            "rep_master": hired.select("rep_id", "team_id", "manager_id", "territory_id", "hire_date"), "territory_master": territory}
