"""Joins (J1–J14, J17–J19)."""

from pyspark.sql import functions as F

from quotalens.operators import joins as J, ranking as R
from quotalens.queries.base import CLASS_MONTH, LEDGER, REP_MONTH, SCORES, class_month, ledger, read, rep_month, scores
from quotalens.queries.registry import query
from quotalens.session import checkpointed


@query("checked_many_to_one_join", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, p_brand, p_retailprice
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""", floats="l_quantity p_retailprice")
def checked_many_to_one_join(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return J.checked_left_join(lines, part, ["l_partkey"])


@query("checked_one_to_one_join", REP_MONTH + """
, r AS (SELECT rep_id, period, sum(sales) AS returned FROM ledger WHERE return_flag GROUP BY ALL)
SELECT rep_id, period, total_sales, returned FROM rep_month LEFT JOIN r USING (rep_id, period)""", floats="total_sales returned")
def checked_one_to_one_join(spark, sf):
    returned = ledger(spark, sf).filter("return_flag").groupBy("rep_id", "period").agg(F.sum("sales").alias("returned"))
    return J.checked_left_join(rep_month(spark, sf).select("rep_id", "period", "total_sales"), returned, ["rep_id", "period"], "one_to_one")


@query("multi_fact_assembly", REP_MONTH + """
, a AS (SELECT rep_id, period, sum(-sales) AS return_amount, count(*) AS return_count FROM ledger WHERE return_flag GROUP BY ALL)
, b AS (SELECT rep_id, period, avg(discount_pct) AS average_discount, max(discount_pct) AS maximum_discount FROM ledger GROUP BY ALL)
, c AS (SELECT rep_id, period, count(DISTINCT customer_id) AS active_customers FROM ledger GROUP BY ALL)
SELECT rep_id, period, total_sales, return_amount, return_count, average_discount, maximum_discount, active_customers
FROM rep_month LEFT JOIN a USING (rep_id, period) LEFT JOIN b USING (rep_id, period) LEFT JOIN c USING (rep_id, period)""",
       floats="total_sales return_amount average_discount maximum_discount")
def multi_fact_assembly(spark, sf):
    led = ledger(spark, sf)
    key = ["rep_id", "period"]
    a = led.filter("return_flag").groupBy(*key).agg(F.sum(-F.col("sales")).alias("return_amount"), F.count(F.lit(1)).alias("return_count"))
    b = led.groupBy(*key).agg(F.avg("discount_pct").alias("average_discount"), F.max("discount_pct").alias("maximum_discount"))
    c = led.groupBy(*key).agg(F.count_distinct("customer_id").alias("active_customers"))
    return J.assemble(rep_month(spark, sf).select(*key, "total_sales"), [a, b, c], key)


@query("dimension_lookup", """
SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark, sf):
    return (read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("c_custkey", "c_mktsegment", "n_name", "r_name"))


@query("outer_join_of_activity_facts", LEDGER + """
, a AS (SELECT rep_id, period, count(*) AS returns FROM ledger WHERE return_flag GROUP BY ALL)
, b AS (SELECT rep_id, CAST(date_trunc('month', ship_date) AS DATE) AS period, count(*) AS shipments FROM ledger GROUP BY ALL)
SELECT coalesce(a.rep_id, b.rep_id) AS rep_id, coalesce(a.period, b.period) AS period, coalesce(returns, 0) AS returns,
  coalesce(shipments, 0) AS shipments FROM a FULL JOIN b ON a.rep_id = b.rep_id AND a.period = b.period""")
def outer_join_of_activity_facts(spark, sf):
    led = ledger(spark, sf)
    a = led.filter("return_flag").groupBy("rep_id", "period").agg(F.count(F.lit(1)).alias("returns"))
    b = led.groupBy("rep_id", F.trunc("ship_date", "MM").alias("period")).agg(F.count(F.lit(1)).alias("shipments"))
    return J.outer_facts(a, b, ["rep_id", "period"], 0)


@query("visit_then_sale_conversion", LEDGER + """
, v AS (SELECT DISTINCT rep_id, customer_id, CAST(date_trunc('month', ship_date) AS DATE) AS period FROM ledger)
, s AS (SELECT rep_id, customer_id, period FROM ledger GROUP BY ALL HAVING sum(sales) > 0)
SELECT rep_id, period, count(*) AS converted_customers FROM v SEMI JOIN s USING (rep_id, customer_id, period) GROUP BY ALL""")
def visit_then_sale_conversion(spark, sf):
    led = ledger(spark, sf)
    visits = led.select("rep_id", "customer_id", F.trunc("ship_date", "MM").alias("period")).distinct()
    sold = led.groupBy("rep_id", "customer_id", "period").agg(F.sum("sales").alias("s")).filter("s > 0")
    return visits.join(sold, ["rep_id", "customer_id", "period"], "left_semi").groupBy("rep_id", "period").agg(
        F.count(F.lit(1)).alias("converted_customers"))


@query("semi_join_composite_key", REP_MONTH + """
SELECT order_id, line_number, l.rep_id, l.period, sales FROM ledger l
SEMI JOIN (SELECT rep_id, period FROM rep_month WHERE total_sales < 0) k ON l.rep_id = k.rep_id AND l.period = k.period""", floats="sales")
def semi_join_composite_key(spark, sf):
    weak = rep_month(spark, sf).filter("total_sales < 0")
    return ledger(spark, sf).join(weak, ["rep_id", "period"], "left_semi").select("order_id", "line_number", "rep_id", "period", "sales")


@query("anti_join_fallback_rows", REP_MONTH + """
, f AS (SELECT rep_id, period, team AS territory, transaction_count / 1.0 AS share FROM rep_month WHERE total_sales > 0)
SELECT rep_id, period, territory, share FROM f UNION ALL
SELECT rep_id, period, team, 1.0 FROM rep_month ANTI JOIN f USING (rep_id, period)""", floats="share")
def anti_join_fallback_rows(spark, sf):
    rm = rep_month(spark, sf)
    found = rm.filter("total_sales > 0").select("rep_id", "period", F.col("team").alias("territory"), F.col("transaction_count").cast("double").alias("share"))
    wanted = rm.select("rep_id", "period", F.col("team").alias("territory"), F.lit(1.0).alias("share"))
    return J.with_fallback(found, wanted, ["rep_id", "period"])


@query("entity_month_grid", LEDGER + """
, s AS (SELECT customer_id, min(period) AS start FROM ledger GROUP BY 1)
, m AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM ledger)
SELECT customer_id, period FROM s JOIN m ON period >= start""")
def entity_month_grid(spark, sf):
    led = ledger(spark, sf)
    starts = led.groupBy("customer_id").agg(F.min("period").alias("start"))
    return J.month_grid(starts, led, "period", "start").select("customer_id", "period")


_RULES = """
, rules(policy_id, start_date, end_date, lower_pct, upper_pct, payout_rate) AS (VALUES
  ('A', DATE '1995-01-01', DATE '1997-12-31', 0.0::DOUBLE, 50.0::DOUBLE, 0.01::DOUBLE), ('A', DATE '1995-01-01', DATE '1997-12-31', 50.0, 120.0, 0.02),
  ('B', DATE '1998-01-01', DATE '2001-12-31', 0.0, 80.0, 0.015), ('B', DATE '1998-01-01', DATE '2001-12-31', 80.0, 150.0, 0.03))"""


def _rules(spark):
    import datetime as dt
    a, b, c, d = dt.date(1995, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1), dt.date(2001, 12, 31)
    return spark.createDataFrame(
        [("A", a, b, 0.0, 50.0, 0.01), ("A", a, b, 50.0, 120.0, 0.02), ("B", c, d, 0.0, 80.0, 0.015), ("B", c, d, 80.0, 150.0, 0.03)],
        "policy_id string, start_date date, end_date date, lower_pct double, upper_pct double, payout_rate double")


@query("effective_dated_rule_join", REP_MONTH + _RULES + """
SELECT rep_id, period, policy_id, lower_pct, payout_rate FROM rep_month JOIN rules ON period BETWEEN start_date AND end_date""", floats="lower_pct payout_rate")
def effective_dated_rule_join(spark, sf):
    return J.effective_join(rep_month(spark, sf), _rules(spark), "period", "start_date", "end_date").select(
        "rep_id", "period", "policy_id", "lower_pct", "payout_rate")


@query("tier_range_join", REP_MONTH + _RULES + """
, c AS (SELECT rep_id, period, transaction_count * 10.0 AS attainment, policy_id, lower_pct, payout_rate,
   CASE WHEN lower_pct <= transaction_count * 10.0 AND transaction_count * 10.0 < upper_pct THEN 0 ELSE 1 END AS miss
   FROM rep_month JOIN rules ON period BETWEEN start_date AND end_date)
SELECT rep_id, period, attainment::DOUBLE AS attainment, policy_id, lower_pct, payout_rate FROM c
QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY miss, lower_pct * (CASE WHEN miss = 0 THEN 1 ELSE -1 END)) = 1""",
       floats="attainment lower_pct payout_rate")
def tier_range_join(spark, sf):
    df = rep_month(spark, sf).select("rep_id", "period", (F.col("transaction_count") * 10.0).alias("attainment"))
    return J.tier_join(df, ["rep_id", "period"], _rules(spark), "period", "start_date", "end_date", F.col("attainment"),
                       "lower_pct", "upper_pct").select("rep_id", "period", "attainment", "policy_id", "lower_pct", "payout_rate")


_LINKS = LEDGER + """
, k AS (SELECT *, order_id * 100000000 + product_id * 10 + line_number AS line_key FROM ledger)
, pos AS (SELECT rep_id, customer_id, product_id, order_date, line_key FROM k WHERE gross_sales > 0)
, neg AS (SELECT * FROM k WHERE gross_sales < 0)
, d1 AS (SELECT customer_id, product_id, order_date, max(line_key) AS line_key FROM pos GROUP BY ALL)
, d2 AS (SELECT customer_id, order_date, max(line_key) AS line_key FROM pos GROUP BY ALL)
, d3 AS (SELECT rep_id, order_date, max(line_key) AS line_key FROM pos GROUP BY ALL)
, a1 AS (SELECT neg.*, d1.line_key AS k1, d1.order_date AS t1 FROM neg ASOF LEFT JOIN d1
         ON neg.customer_id = d1.customer_id AND neg.product_id = d1.product_id AND neg.order_date >= d1.order_date)
, a2 AS (SELECT a1.*, d2.line_key AS k2, d2.order_date AS t2 FROM a1 ASOF LEFT JOIN d2 ON a1.customer_id = d2.customer_id AND a1.order_date >= d2.order_date)
, a3 AS (SELECT a2.*, d3.line_key AS k3, d3.order_date AS t3 FROM a2 ASOF LEFT JOIN d3 ON a2.rep_id = d3.rep_id AND a2.order_date >= d3.order_date)"""


def keyed_lines(spark, sf, *more):
    """The ledger's lines with a key of their own, written once: every step of the linkage reads them."""
    key = F.col("order_id") * 100000000 + F.col("product_id") * 10 + F.col("line_number")
    return checkpointed(ledger(spark, sf).select(key.alias("line_key"), "rep_id", "customer_id", "product_id", "period", "order_date", "quantity", "gross_sales", *more))


@query("return_linkage_as_of", _LINKS + """
SELECT line_key, rep_id, quantity, order_date, coalesce(k1, k2, k3, line_key) AS linked_line, coalesce(t1, t2, t3, order_date) AS linked_date,
  CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 2 WHEN k3 IS NOT NULL THEN 3 ELSE 0 END AS match_level,
  CAST(order_date - coalesce(t1, t2, t3, order_date) AS INTEGER) AS days_after_order FROM a3""", floats="quantity")
def return_linkage_as_of(spark, sf):
    from quotalens.operators.orders import link_returns
    led = keyed_lines(spark, sf)
    return link_returns(led, "gross_sales", "order_date", "line_key").select(
        "line_key", "rep_id", "quantity", "order_date", F.col("linked_line_key").alias("linked_line"),
        F.col("linked_order_date").alias("linked_date"), "match_level", "days_after_order")


@query("return_date_repair", _LINKS + """
, ln AS (SELECT line_key AS return_line, rep_id, coalesce(k1, k2, k3, line_key) AS order_line_id, order_date AS return_date, CAST(date_trunc('month', coalesce(t1, t2, t3, order_date)) AS DATE) AS payout_period FROM a3)
, mv AS (SELECT line_key, max(CASE WHEN discount_pct >= 0.08 THEN last_day(order_date) ELSE order_date END) AS order_date FROM k GROUP BY 1)
, j AS (SELECT ln.* EXCLUDE (return_date), mv.order_date AS original_order_date, CASE WHEN return_date < mv.order_date THEN CAST(mv.order_date + 1 AS DATE) ELSE return_date END AS return_date FROM ln LEFT JOIN mv ON line_key = order_line_id)
SELECT return_line, rep_id, order_line_id, payout_period, original_order_date, return_date, CAST(return_date - original_order_date AS INTEGER) AS days_after_order,
  coalesce(return_date > CAST(last_day(payout_period) + 15 AS DATE) AND (rep_id, payout_period) IN (SELECT (rep_id, period) FROM ledger), false) AS after_incentive_payout_flag FROM j""")
def return_date_repair(spark, sf):
    """Returns after strongly discounted orders have moved to their month's end."""
    from quotalens.operators.orders import link_returns, move_to_period_end, repair_order_dates, repair_return_dates
    led = keyed_lines(spark, sf, "ship_date", "discount_pct")
    returns = link_returns(led, "gross_sales", "order_date", "line_key").select(
        F.col("line_key").alias("return_line"), "rep_id", F.col("linked_line_key").alias("order_line_id"), F.col("order_date").alias("return_date"),
        F.trunc("linked_order_date", "month").alias("payout_period"), F.col("linked_order_date").alias("original_order_date"), "days_after_order", F.lit(False).alias("after_incentive_payout_flag"))
    orders = led.select(F.col("line_key").alias("order_line_id"), "period", "order_date", F.col("ship_date").alias("invoice_date"), F.date_add("ship_date", 3).alias("fulfillment_date"), (F.col("discount_pct") >= 0.08).alias("late"))
    payouts = led.select("rep_id", F.col("period").alias("payout_period")).distinct().withColumn("payout_date", F.date_add(F.last_day("payout_period"), 15))
    return repair_return_dates(returns, repair_order_dates(move_to_period_end(orders, "late")), payouts, "order_line_id")


@query("calendar_shift_self_join", REP_MONTH + """
SELECT a.rep_id, a.period, a.total_sales, b.total_sales AS next_sales, c.total_sales AS prior_sales FROM rep_month a
LEFT JOIN rep_month b ON a.rep_id = b.rep_id AND b.period = CAST(a.period + INTERVAL 1 MONTH AS DATE)
LEFT JOIN rep_month c ON a.rep_id = c.rep_id AND c.period = CAST(a.period - INTERVAL 1 MONTH AS DATE)""", floats="total_sales next_sales prior_sales")
def calendar_shift_self_join(spark, sf):
    df = rep_month(spark, sf).select("rep_id", "period", "total_sales")
    both = J.shifted(df, ["rep_id"], "period", 1, {"total_sales": "next_sales"})
    prior = J.shifted(df, ["rep_id"], "period", -1, {"total_sales": "prior_sales"}).drop("total_sales")
    return both.join(prior, ["rep_id", "period"])


@query("coverage_check_join", LEDGER + """
, a AS (SELECT DISTINCT rep_id, period FROM ledger WHERE return_flag), b AS (SELECT DISTINCT rep_id, period FROM ledger WHERE NOT return_flag)
SELECT count(*) FILTER (b.rep_id IS NULL) AS left_only, count(*) FILTER (a.rep_id IS NULL) AS right_only,
  count(*) FILTER (a.rep_id IS NOT NULL AND b.rep_id IS NOT NULL) AS both FROM a FULL JOIN b ON a.rep_id = b.rep_id AND a.period = b.period""")
def coverage_check_join(spark, sf):
    led = ledger(spark, sf)
    return J.coverage_check(led.filter("return_flag"), led.filter("NOT return_flag"), ["rep_id", "period"])


@query("donor_receiver_pairing", REP_MONTH + """
, a AS (SELECT team, period, rep_id, transaction_count, row_number() OVER (PARTITION BY team, period ORDER BY transaction_count DESC, rep_id) AS pair
        FROM rep_month WHERE transaction_count >= 9)
, b AS (SELECT team, period, rep_id, -transaction_count AS spare, row_number() OVER (PARTITION BY team, period ORDER BY transaction_count, rep_id) AS pair
        FROM rep_month WHERE transaction_count <= 6)
SELECT a.team, a.period, a.pair, a.rep_id AS receiver, a.transaction_count AS receiver_score, b.rep_id AS donor, b.spare AS donor_score
FROM a JOIN b USING (team, period, pair)""")
def donor_receiver_pairing(spark, sf):
    rm = rep_month(spark, sf)
    a = rm.filter("transaction_count >= 9")
    b = rm.filter("transaction_count <= 6").withColumn("spare", -F.col("transaction_count"))
    return J.pair_by_rank(a, "transaction_count", b, "spare", ["team", "period"], "rep_id")


@query("interpolated_lookup", SCORES + """
, ref AS (SELECT x, (cum - n * 0.5) / (total + 1) AS y FROM (SELECT fine_score AS x, count(*) AS n, sum(count(*)) OVER (ORDER BY fine_score) AS cum,
    sum(count(*)) OVER () AS total FROM scores WHERE NOT label GROUP BY 1))
, p AS (SELECT observation_id, fine_score AS x FROM scores WHERE label)
, lo AS (SELECT p.*, r.x AS x0, r.y AS y0 FROM p ASOF LEFT JOIN ref r ON p.x >= r.x)
, hi AS (SELECT lo.*, r.x AS x1, r.y AS y1 FROM lo ASOF LEFT JOIN ref r ON lo.x <= r.x)
SELECT observation_id, x, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS y FROM hi""",
       floats="x y")
def interpolated_lookup(spark, sf):
    s = scores(spark, sf).withColumnRenamed("fine_score", "x")
    ref = R.positions(s.filter("NOT label"), [], "x").select(
        "x", ((F.col("n_below") + F.col("n_equal") * 0.5) / (F.col("n_total") + 1)).alias("y"))
    return J.interpolate(s.filter("label").select("observation_id", "x"), ref, [], "x", "y", "y")


@query("truth_resolution_ladder", REP_MONTH + """
, rec AS (SELECT rep_id, period, team AS territory, CAST(rep_id AS VARCHAR) || '-' || strftime(period, '%Y-%m') AS record_id FROM rep_month)
, truth AS (SELECT order_id AS truth_id, any_value(o_orderstatus) AS kind, max(period) AS period, min(rep_id) AS rep, max(country) AS territory
   FROM ledger JOIN orders ON order_id = o_orderkey GROUP BY 1)
SELECT truth_id, record_id, 'record' AS basis FROM truth JOIN rec ON CAST(rep AS VARCHAR) || '-' || strftime(truth.period, '%Y-%m') = record_id WHERE kind = 'F' UNION ALL
SELECT truth_id, record_id, 'period+rep_id' FROM truth JOIN rec ON rec.rep_id = truth.rep AND rec.period = truth.period WHERE kind = 'O' UNION ALL
SELECT truth_id, record_id, 'period+territory' FROM truth JOIN rec ON rec.territory = truth.territory AND rec.period = truth.period WHERE kind = 'P'""")
def truth_resolution_ladder(spark, sf):
    label = lambda rep: F.concat(F.col(rep).cast("string"), F.lit("-"), F.date_format("period", "yyyy-MM"))
    rec = rep_month(spark, sf).select("rep_id", "period", F.col("team").alias("territory"), label("rep_id").alias("record_id"))
    per_order = ledger(spark, sf).groupBy(F.col("order_id").alias("truth_id")).agg(
        F.max("period").alias("period"), F.min("rep_id").alias("rep"), F.max("country").alias("territory"))
    status = read(spark, sf, "orders").select(F.col("o_orderkey").alias("truth_id"), F.col("o_orderstatus").alias("kind"))
    truth = per_order.join(status, "truth_id").select(
        "truth_id", "period", "territory", F.when(F.col("kind") == "F", F.array(label("rep"))).alias("ids"),
        F.when(F.col("kind") == "O", F.col("rep")).alias("rep_id"))
    return J.resolve_by_ladder(truth, "truth_id", rec, "record_id", "ids", [["period", "rep_id"], ["period", "territory"]])


@query("customer_rep_assignment", LEDGER + """
, c AS (SELECT DISTINCT team, manager, city, customer_id FROM ledger)
SELECT team, manager, city, customer_id, team || '/' || manager || '/' || city || '/' || CAST(
  CAST('0x' || substr(sha256('42|' || team || '|' || manager || '|' || city || '|' || customer_id), 1, 15) AS BIGINT) % 3 AS VARCHAR) AS assigned_rep FROM c""")
def customer_rep_assignment(spark, sf):
    out = J.assign_representatives(ledger(spark, sf), ["team", "manager", "city"], "customer_id", 3, 42)
    return out.select("team", "manager", "city", "customer_id", "assigned_rep").distinct()
