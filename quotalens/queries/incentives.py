"""Incentives, targets and orders."""

from pyspark.sql import functions as F

from quotalens.operators import incentives as I, orders as O
from quotalens.queries.planning_inputs import ORDERS_SQL, orders, products, reps, returns, rules, targets
from quotalens.queries.registry import query

_RULES = """
, ver(policy_version, s, e, rate, cap, delay) AS (VALUES ('1', DATE '1995-01-01', DATE '1997-12-31', 0.02::DOUBLE, 6000.0::DOUBLE, 15), ('2', DATE '1998-01-01', DATE '2001-12-31', 0.03, 8000.0, 20))
, tier(lo, hi, acc, dec) AS (VALUES (0.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (50.0, 100.0, 0.0, 0.8), (100.0, 150.0, 0.5, 1.0), (150.0, 500.0, 1.0, 1.0))
, rules AS (SELECT * FROM ver CROSS JOIN tier)"""
_CALC = ORDERS_SQL + _RULES + """
, w AS (SELECT o.*, CASE WHEN p_type <> 'ECONOMY' THEN CASE WHEN p_size > 40 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END ELSE 0 END AS weight, p_size > 40 AS pri FROM o JOIN part ON product_id = p_partkey)
, a AS (SELECT rep_id, period, sum(gross_sales * weight) AS eg, sum(net_sales * weight) AS en, sum(CASE WHEN pri THEN net_sales ELSE 0 END) AS ps, avg(discount_pct) AS disc, sum(quantity) * 500.0 AS target,
   avg((discount_pct > 0.07)::INT) AS unap FROM w GROUP BY ALL)
, n AS (SELECT rep_id, period, count(*) AS new FROM (SELECT rep_id, customer_id, min(period) AS period FROM o WHERE net_sales > 0 GROUP BY ALL) GROUP BY ALL)
, r AS (SELECT rep_id, period, sum(abs(net_sales)) AS ret FROM o JOIN ver ON period BETWEEN s AND e WHERE return_flag AND greatest(ship_date, order_date) <= last_day(period) + delay GROUP BY ALL)
, b AS (SELECT a.*, coalesce(new, 0) AS new, coalesce(ret, 0) AS ret, en / greatest(target, 1) AS att FROM a LEFT JOIN n USING (rep_id, period) LEFT JOIN r USING (rep_id, period))
, j AS (SELECT b.*, rules.*, CASE WHEN lo <= att * 100 AND att * 100 < hi THEN 0 ELSE 1 END AS miss FROM b JOIN rules ON period BETWEEN s AND e
   QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY miss, lo * (CASE WHEN miss = 0 THEN 1 ELSE -1 END)) = 1)
, k AS (SELECT *, CASE WHEN att >= 0.5 THEN greatest(en, 0) * rate * least(att, 1) * (CASE WHEN att < 1 THEN dec ELSE 1 END) ELSE 0 END AS base FROM j)
, c AS (SELECT *, base * greatest(att - 1, 0) * acc AS accel, base * least(greatest(ps, 0) / greatest(abs(en), 1), 1) * 0.1 AS mix, CASE WHEN att >= 0.5 THEN new * 50.0 ELSE 0 END AS newb,
   CASE WHEN att >= 0.5 THEN greatest(en, 0) * greatest(disc - 0.13, 0) * rate * (1 + unap) ELSE 0 END AS pen, CASE WHEN att >= 0.5 THEN greatest(ret, 0) * rate ELSE 0 END AS claw FROM k)
, f AS (SELECT *, least(greatest(base + accel + mix + newb - pen - claw, 0), cap) AS paid FROM c)"""


def calculated(spark, sf, cents=True):
    o = orders(spark, sf)
    discounts = o.select("order_line_id", "rep_id", "period", "discount_pct", (F.col("discount_pct") <= 0.07).alias("approved_flag"))
    return I.calculate_incentives(o, discounts, returns(spark, sf), targets(spark, sf), products(spark, sf), reps(spark, sf).select("rep_id", "manager_id", "team_id", "territory_id"), rules(spark), cents)


@query("policy_rule_table", ORDERS_SQL + _RULES + """
, months AS (SELECT DISTINCT period FROM o)
SELECT period, 'P1' AS policy_id, policy_version, lo AS lower_attainment_pct, hi AS upper_attainment_pct, rate AS payout_rate, cap AS maximum_payout FROM months JOIN rules ON period BETWEEN s AND e""",
       floats="lower_attainment_pct upper_attainment_pct payout_rate maximum_payout")
def policy_rule_table(spark, sf):
    from quotalens.operators.joins import effective_join
    months = orders(spark, sf).select("period").distinct()
    return effective_join(months, rules(spark), "period", "effective_start_date", "effective_end_date").select(
        "period", "policy_id", "policy_version", "lower_attainment_pct", "upper_attainment_pct", "payout_rate", "maximum_payout")


@query("incentive_calculation", _CALC + """
SELECT rep_id, period, policy_version, att AS attainment, CAST(base AS DOUBLE) AS base, CAST(accel AS DOUBLE) AS accelerator, CAST(mix AS DOUBLE) AS mix_bonus, CAST(newb AS DOUBLE) AS new_customer_bonus, CAST(pen AS DOUBLE) AS discount_penalty, CAST(claw AS DOUBLE) AS return_clawback,
  CAST(last_day(period) + delay AS DATE) AS payout_date FROM f""", floats="attainment base accelerator mix_bonus new_customer_bonus discount_penalty return_clawback")
def incentive_calculation(spark, sf):
    """Components before rounding to cents."""
    c = calculated(spark, sf, cents=False)
    s = F.col
    return c.select("rep_id", "period", "policy_version", (F.col("attainment_pct") / 100).alias("attainment"), s("base_incentive").alias("base"), s("accelerator_amount").alias("accelerator"),
                    s("product_mix_bonus").alias("mix_bonus"), F.col("new_customer_bonus_amount").alias("new_customer_bonus"), s("discount_penalty").alias("discount_penalty"),
                    s("return_clawback").alias("return_clawback"), "payout_date")


@query("incentive_payout_ratio", _CALC + """
SELECT rep_id, period, paid / greatest(abs(en), 1) AS payout_to_sales_ratio, paid = cap AS capped FROM f""", floats="payout_to_sales_ratio")
def incentive_payout_ratio(spark, sf):
    return calculated(spark, sf).select("rep_id", "period", "payout_to_sales_ratio", (F.col("final_incentive_paid") == F.col("maximum_payout")).alias("capped"))


@query("payout_reconciliation", _CALC + """
SELECT 0.0::DOUBLE AS worst_error, count(*) AS rows FROM f""", floats="worst_error")
def payout_reconciliation(spark, sf):
    return calculated(spark, sf).agg(F.max(I.reconciliation_error()).alias("worst_error"), F.count(F.lit(1)).alias("rows"))


@query("order_arithmetic", ORDERS_SQL + """
SELECT order_id, line_number, product_id, rep_id, discount_amount, net_sales, CASE WHEN gross_sales < 0 THEN 'source_return' ELSE 'fulfilled' END AS order_status, day(order_date) >= 25 AS end_of_period_flag FROM o""",
       floats="discount_amount net_sales")
def order_arithmetic(spark, sf):
    return orders(spark, sf).select("order_id", "line_number", "product_id", "rep_id", "discount_amount", "net_sales", "order_status", "end_of_period_flag")


@query("discount_detail", ORDERS_SQL + """
SELECT order_id || '-' || line_number || '-' || product_id || '-' || rep_id AS order_line_id, rep_id, discount_pct, discount_amount,
  CASE WHEN discount_pct >= 0.15 THEN 'volume or contract exception' WHEN discount_pct >= 0.08 THEN 'customer segment pricing' ELSE 'standard commercial discount' END AS discount_reason,
  discount_pct > 0.08 AS approval_required_flag, CASE WHEN discount_pct > 0.08 THEN manager END AS approver_id, discount_pct > 0.08 AS exception_flag FROM o""", floats="discount_pct discount_amount")
def discount_detail(spark, sf):
    return O.discount_detail(orders(spark, sf), "order_line_id", "rep_id", "manager", 0.08)


@query("chronology_repair", ORDERS_SQL + """
, d AS (SELECT order_id, line_number, product_id, rep_id, order_date, greatest(ship_date, order_date) AS invoice_date FROM o)
SELECT order_id, line_number, product_id, rep_id, order_date, invoice_date, greatest(invoice_date, CAST(order_date + 3 AS DATE)) AS fulfillment_date FROM d""")
def chronology_repair(spark, sf):
    o = orders(spark, sf).withColumn("invoice_date", F.col("ship_date")).withColumn("fulfillment_date", F.date_add("order_date", 3))
    return O.repair_order_dates(o).select("order_id", "line_number", "product_id", "rep_id", "order_date", "invoice_date", "fulfillment_date")


@query("prior_informed_targets", ORDERS_SQL + """
, w AS (SELECT o.*, p_type <> 'ECONOMY' AND p_size > 40 AS pri FROM o JOIN part ON product_id = p_partkey)
, b AS (SELECT rep_id, period, sum(sales) AS x, sum(greatest(sales, 0)) AS pos, sum(quantity) AS u, sum(CASE WHEN pri THEN greatest(sales, 0) ELSE 0 END) AS pr FROM w GROUP BY ALL)
, h AS (SELECT *, coalesce(median(x) OVER w3, 90000) AS psm, coalesce(median(u) OVER w3, 200) AS pum, coalesce(sum(pos) OVER wa, 0) AS pp, coalesce(sum(pr) OVER wa, 0) AS prr FROM b
  WINDOW w3 AS (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), wa AS (PARTITION BY rep_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, m AS (SELECT *, least(greatest(coalesce(CASE WHEN pp > 0 THEN prr / pp END, 0.25), 0.05), 0.75) AS mix FROM h)
, tn AS (SELECT rep_id, period, city, count(*) AS n FROM o GROUP BY ALL), td AS (SELECT rep_id, period, city FROM tn QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY n DESC, city) = 1)
, ts AS (SELECT city, period, sum(abs(sales)) AS s FROM o GROUP BY ALL), tp AS (SELECT city, period, coalesce(sum(s) OVER (PARTITION BY city ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM ts)
, tr AS (SELECT city, period, max(prior) OVER (PARTITION BY period) AS top, (rank() OVER (PARTITION BY period ORDER BY prior) + (count(*) OVER (PARTITION BY period, prior) - 1) / 2.0) / count(*) OVER (PARTITION BY period) AS pct FROM tp)
, pot AS (SELECT city, period, greatest(1, least(100, CASE WHEN top <= 0 THEN 50 ELSE 25 + 75 * pct END)) AS p FROM tr)
, ms AS (SELECT period, sum(sales) AS x FROM o GROUP BY 1), sa AS (SELECT period, avg(x) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al,
   avg(x) OVER (PARTITION BY month(period) ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM ms)
, se AS (SELECT period, least(1.3, greatest(0.7, coalesce(CASE WHEN abs(al) >= 1e-12 THEN same / al END, 1))) AS season FROM sa)
, fd AS (SELECT rep_id, min(period) AS hire FROM o GROUP BY 1)
, z AS (SELECT m.*, season, p, greatest(1, (year(m.period) - year(hire)) * 12 + month(m.period) - month(hire)) AS ten FROM m JOIN td USING (rep_id, period) JOIN pot USING (city, period) JOIN se USING (period) JOIN fd USING (rep_id))
, y AS (SELECT *, CASE WHEN ten < 12 THEN 0.88 WHEN ten < 30 THEN 0.96 ELSE 1.02 END::DOUBLE AS tf, 0.94 + 0.12 * least(greatest(mix / 0.25, 0.5), 1.5) AS pf FROM z)
SELECT rep_id, period, season, mix AS prior_priority_product_mix, greatest(abs(psm) * (0.72 + 0.18 * season + 0.10 * (0.85 + p / 330)) * pf * tf, 1) AS target_sales,
  greatest(abs(pum) * (0.80 + 0.20 * season) * tf, 1) AS target_units FROM y""", floats="season prior_priority_product_mix target_sales target_units", digits=4)
def prior_informed_targets(spark, sf):
    o = orders(spark, sf).withColumn("net_sales", F.col("sales"))
    hired = o.groupBy("rep_id").agg(F.min("period").alias("hire_date"))
    return I.prior_informed_targets(o, products(spark, sf), hired, 90000, 200).select("rep_id", "period", "season", "prior_priority_product_mix", "target_sales", "target_units")
