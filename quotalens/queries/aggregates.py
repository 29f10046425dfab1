"""Aggregations and set operations."""

from pyspark.sql import functions as F

from quotalens.operators import aggregates as A, features as X, ranking as R
from quotalens.queries.base import CLASS_MONTH, LEDGER, REP_MONTH, SCORES, class_month, ledger, read, rep_month, scores
from quotalens.queries.registry import query

DISTINCT = {"distinct_customers": "customer_id", "distinct_products": "product_id", "distinct_cities": "city", "distributor_count": "distributor", "active_reps": "rep_id"}
_GRAIN = """SELECT {g}, sum(sales) AS total_sales, sum(quantity) AS total_quantity, count(*) AS transaction_count, avg(price) AS average_price,
  median(price) AS median_price, count(DISTINCT customer_id) AS distinct_customers, count(DISTINCT product_id) AS distinct_products,
  count(DISTINCT city) AS distinct_cities, count(DISTINCT distributor) AS distributor_count, count(DISTINCT rep_id) AS active_reps{extra}
FROM ledger GROUP BY ALL"""
_FLOATS = "total_sales total_quantity average_price median_price"


@query("sales_grain_aggregate", LEDGER + _GRAIN.format(
    g="rep_id, product_class, period", extra=", stddev_samp(quantity) AS quantity_dispersion, stddev_samp(discount_pct) AS discount_dispersion"),
       floats=_FLOATS + " quantity_dispersion discount_dispersion")
def sales_grain_aggregate(spark, sf):
    led = ledger(spark, sf)
    return A.sales_grain(led, ["rep_id", "product_class", "period"], {k: v for k, v in DISTINCT.items() if k != "active_reps"},
                         dispersion={"quantity_dispersion": "quantity", "discount_dispersion": "discount_pct"}).withColumn("active_reps", F.lit(1).cast("long"))


@query("rollup_rep_month", LEDGER + _GRAIN.format(g="rep_id, period", extra=""), floats=_FLOATS)
def rollup_rep_month(spark, sf):
    return A.rollups(ledger(spark, sf), {"rep": ["rep_id", "period"]}, {k: v for k, v in DISTINCT.items() if k != "active_reps"})["rep"].withColumn(
        "active_reps", F.lit(1).cast("long"))


@query("rollup_market_view", LEDGER + _GRAIN.format(g="product_class, country, period", extra=""), floats=_FLOATS)
def rollup_market_view(spark, sf):
    return A.sales_grain(ledger(spark, sf), ["product_class", "country", "period"], DISTINCT)


@query("rollup_planning_view", LEDGER + _GRAIN.format(g="team, country, product_class, period", extra=""), floats=_FLOATS)
def rollup_planning_view(spark, sf):
    return A.sales_grain(ledger(spark, sf), ["team", "country", "product_class", "period"], DISTINCT)


@query("grouping_sets_rollup", LEDGER + """
SELECT team, country, product_class, sum(sales) AS sales, count(*) AS lines,
  CASE grouping(team, country, product_class) WHEN 3 THEN 'team' WHEN 5 THEN 'country' WHEN 0 THEN 'team+country+product_class' ELSE 'all' END AS "grouping"
FROM ledger GROUP BY GROUPING SETS ((team), (country), (team, country, product_class), ())""", floats="sales")
def grouping_sets_rollup(spark, sf):
    return A.grouping_sets(ledger(spark, sf), ["team", "country", "product_class"], [F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("lines")],
                           [["team"], ["country"], ["team", "country", "product_class"], []])


@query("grain_comparison", LEDGER + """
, a AS (SELECT count(*) AS n FROM ledger GROUP BY rep_id, product_class, period), b AS (SELECT count(*) AS n FROM ledger GROUP BY rep_id, product_class, country, period)
, c AS (SELECT count(*) AS n FROM ledger GROUP BY rep_id, period)
SELECT 'rep_id x product_class x period' AS grain, count(*) AS observations, median(n) AS median_rows, avg((n = 1)::INT) * 100 AS single_row_pct FROM a UNION ALL
SELECT 'rep_id x product_class x country x period', count(*), median(n), avg((n = 1)::INT) * 100 FROM b UNION ALL
SELECT 'rep_id x period', count(*), median(n), avg((n = 1)::INT) * 100 FROM c""", floats="median_rows single_row_pct")
def grain_comparison(spark, sf):
    return A.grain_comparison(ledger(spark, sf), [["rep_id", "product_class", "period"], ["rep_id", "product_class", "country", "period"], ["rep_id", "period"]])


@query("conditional_sums", LEDGER + """
SELECT rep_id, period, sum(CASE WHEN day(order_date) >= 25 THEN sales ELSE 0 END) AS period_end_sales,
  sum(CASE WHEN product_class = 'PROMO' THEN sales ELSE 0 END) AS promo_sales FROM ledger GROUP BY ALL""", floats="period_end_sales promo_sales")
def conditional_sums(spark, sf):
    return A.conditional_sums(ledger(spark, sf), ["rep_id", "period"], {
        "period_end_sales": (F.dayofmonth("order_date") >= 25, "sales"), "promo_sales": (F.col("product_class") == "PROMO", "sales")})


@query("rate_aggregates", LEDGER + """
SELECT rep_id, period, 1 - avg(return_flag::INT) AS kept_rate, avg((quantity < 10)::INT) AS small_line_rate FROM ledger GROUP BY ALL""", floats="kept_rate small_line_rate")
def rate_aggregates(spark, sf):
    return ledger(spark, sf).groupBy("rep_id", "period").agg((1 - A.rate(F.col("return_flag"))).alias("kept_rate"), A.rate(F.col("quantity") < 10).alias("small_line_rate"))


@query("duplicate_signal", LEDGER + """
, k AS (SELECT rep_id, period, count(*) OVER (PARTITION BY rep_id, period, customer_id, order_date) > 1 AS dup FROM ledger)
SELECT rep_id, period, avg(dup::INT) AS duplicate_share FROM k GROUP BY ALL""", floats="duplicate_share")
def duplicate_signal(spark, sf):
    return A.duplicate_share(ledger(spark, sf), ["rep_id", "period"], ["customer_id", "order_date"], "duplicate_share")


_ORDERS = LEDGER + """
, o AS (SELECT *, abs(gross_sales) * discount_pct AS discount_amount, gross_sales - sign(gross_sales) * abs(gross_sales) * discount_pct AS net_sales,
   day(order_date) >= 25 AS end_flag FROM ledger)"""


@query("order_facts", _ORDERS + """
SELECT rep_id, period, sum(gross_sales) AS gross_sales, sum(net_sales) AS net_sales, sum(quantity) AS total_quantity, count(*) AS order_count,
  avg(net_sales) AS average_order_value, max(abs(net_sales)) AS maximum_order_value, CAST(sum(end_flag::INT) AS BIGINT) AS end_period_order_count,
  sum(CASE WHEN end_flag THEN net_sales ELSE 0 END) AS end_period_sales,
  CASE WHEN abs(sum(net_sales)) > 1e-12 THEN sum(CASE WHEN end_flag THEN net_sales ELSE 0 END) / abs(sum(net_sales)) ELSE 0 END AS end_of_period_sales_share,
  count(*) / 21.0 AS order_frequency, sum(end_flag::INT) / count(*) AS unusual_order_timing_score
FROM o GROUP BY ALL""", floats="gross_sales net_sales total_quantity average_order_value maximum_order_value end_period_sales end_of_period_sales_share order_frequency unusual_order_timing_score")
def order_facts(spark, sf):
    from quotalens.operators.orders import order_arithmetic
    out = X.order_facts(order_arithmetic(ledger(spark, sf)), ["rep_id", "period"])
    return out.drop("average_selling_price")


@query("return_facts", LEDGER + """
, r AS (SELECT rep_id, CAST(date_trunc('month', greatest(ship_date, order_date)) AS DATE) AS period, period AS payout_period, abs(sales) AS amount,
   quantity > 25 AS cancelled, greatest(ship_date, order_date) > last_day(period) + 15 AS late FROM ledger WHERE return_flag)
, a AS (SELECT rep_id, period, sum(amount) AS return_amount, count(*) AS return_count, CAST(sum(cancelled::INT) AS BIGINT) AS cancellation_count FROM r GROUP BY ALL)
, b AS (SELECT rep_id, payout_period AS period, sum(amount) AS post FROM r WHERE late GROUP BY ALL)
SELECT coalesce(a.rep_id, b.rep_id) AS rep_id, coalesce(a.period, b.period) AS period, coalesce(return_amount, 0) AS return_amount, coalesce(return_count, 0) AS return_count,
  coalesce(cancellation_count, 0) AS cancellation_count, coalesce(post, 0) AS post_payout_return_amount FROM a FULL JOIN b ON a.rep_id = b.rep_id AND a.period = b.period""",
       floats="return_amount post_payout_return_amount")
def return_facts(spark, sf):
    day = F.greatest("ship_date", "order_date")
    r = ledger(spark, sf).filter("return_flag").select(
        "rep_id", day.alias("return_date"), F.col("period").alias("payout_period"), F.abs("sales").alias("return_amount"),
        (F.col("quantity") > 25).alias("cancellation_flag"), (day > F.date_add(F.last_day("period"), 15)).alias("after_incentive_payout_flag"))
    return X.return_facts(r)


_VISITS = LEDGER + """
, v AS (SELECT rep_id, customer_id, CAST(date_trunc('month', ship_date) AS DATE) AS period, ship_date AS visit_date, quantity AS minutes, discount_pct * 100 AS km,
   NOT return_flag AS done FROM ledger)"""


def visits(spark, sf):
    return ledger(spark, sf).select(
        "rep_id", "customer_id", F.trunc("ship_date", "MM").alias("period"), F.col("ship_date").alias("visit_date"), F.col("quantity").alias("visit_duration_minutes"),
        (F.col("discount_pct") * 100).alias("estimated_travel_km"), (~F.col("return_flag")).alias("visit_completed_flag"), "city")


@query("visit_facts", _VISITS + """
, s AS (SELECT rep_id, customer_id, period FROM ledger GROUP BY ALL HAVING sum(sales) > 0)
, c AS (SELECT rep_id, period, count(*) AS n FROM (SELECT DISTINCT rep_id, period, customer_id FROM v WHERE done) m SEMI JOIN s USING (rep_id, period, customer_id) GROUP BY ALL)
, a AS (SELECT rep_id, period, CAST(sum(done::INT) AS BIGINT) AS completed_visit_count, avg(minutes) AS average_visit_duration, avg((minutes < 10)::INT) AS extremely_short_visit_rate,
   sum(km) AS estimated_visit_travel_km FROM v GROUP BY ALL)
SELECT a.*, coalesce(n, 0) AS visit_converted_customer_count FROM a LEFT JOIN c USING (rep_id, period)""",
       floats="average_visit_duration extremely_short_visit_rate estimated_visit_travel_km")
def visit_facts(spark, sf):
    return X.visit_facts(visits(spark, sf), ledger(spark, sf), ["rep_id", "period"], "customer_id", "sales")


@query("interaction_facts", """
SELECT user_id AS rep_id, CAST(ts AS DATE) AS period, count(*) AS crm_interaction_count, avg(value) AS average_interest_score FROM events GROUP BY ALL""", floats="average_interest_score")
def interaction_facts(spark, sf):
    crm = read(spark, sf, "events").select(F.col("user_id").alias("rep_id"), F.to_date("ts").alias("period"), F.col("value").alias("sentiment_or_interest_score"))
    return X.interaction_facts(crm, ["rep_id", "period"])


@query("expense_facts", LEDGER + """
, e AS (SELECT rep_id, period, customer_id, city, price, quantity, sales, return_flag, count(*) OVER (PARTITION BY rep_id, period, customer_id, city, quantity) > 1 AS dup FROM ledger)
SELECT rep_id, period, sum(price) AS claimed_distance_km, sum(sales) AS estimated_distance_km, sum(quantity) AS claimed_expense_amount, sum(quantity * 2) AS expected_expense_amount,
  1 - avg((NOT return_flag)::INT) AS missing_receipt_rate, avg(dup::INT) AS duplicate_expense_signal FROM e GROUP BY ALL""",
       floats="claimed_distance_km estimated_distance_km claimed_expense_amount expected_expense_amount missing_receipt_rate duplicate_expense_signal")
def expense_facts(spark, sf):
    e = ledger(spark, sf).select(
        "rep_id", "period", F.col("customer_id").alias("visit_id"), F.col("city").alias("expense_category"), F.col("price").alias("claimed_distance_km"),
        F.col("sales").alias("estimated_distance_km"), F.col("quantity").alias("claimed_amount"), (F.col("quantity") * 2).alias("expected_amount"),
        (~F.col("return_flag")).alias("receipt_available_flag"))
    return X.expense_facts(e, ["rep_id", "period"])


@query("entity_masters_frozen", LEDGER + """
, t AS (SELECT *, order_id * 100000000 + product_id * 10 + line_number AS k FROM ledger)
, f AS (SELECT customer_id, min(order_date) AS first FROM t GROUP BY 1)
, r AS (SELECT t.*, first, row_number() OVER (PARTITION BY t.customer_id ORDER BY order_date, k) AS rn FROM t JOIN f ON t.customer_id = f.customer_id)
, kept AS (SELECT * FROM r WHERE (first <= DATE '1998-12-31' AND order_date <= DATE '1998-12-31') OR (first > DATE '1998-12-31' AND k = (SELECT min(k) FROM r r2 WHERE r2.customer_id = r.customer_id AND r2.order_date = r.first)))
, c AS (SELECT customer_id, product_class, count(*) AS n FROM kept GROUP BY ALL)
, m AS (SELECT customer_id, product_class AS usual_class FROM c QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_class) = 1)
SELECT customer_id, min(first) AS first_seen, sum(sales) AS sales, count(*) AS lines, any_value(usual_class) AS usual_class FROM kept JOIN m USING (customer_id) GROUP BY 1""", floats="sales")
def entity_masters_frozen(spark, sf):
    led = ledger(spark, sf).withColumn("k", F.col("order_id") * 100000000 + F.col("product_id") * 10 + F.col("line_number"))
    return X.entity_master(led, "customer_id", "order_date", "k", "1998-12-31", {"usual_class": "product_class"}, {"sales": F.sum("sales"), "lines": F.count(F.lit(1))})


@query("legacy_enriched_grain", LEDGER + """
, g AS (SELECT rep_id, product_class AS product_name, city AS territory_id, period AS date, sum(sales) AS total_sales, sum(quantity) AS total_quantity, avg(price) AS average_price,
   count(DISTINCT customer_id) AS unique_customers, count(*) AS transaction_count FROM ledger GROUP BY ALL)
, n AS (SELECT rep_id, product_class AS product_name, city AS territory_id, period AS date, channel, count(*) AS n, sum(sales) AS v FROM ledger GROUP BY ALL)
, m AS (SELECT rep_id, product_name, territory_id, date, channel FROM n QUALIFY row_number() OVER (PARTITION BY rep_id, product_name, territory_id, date ORDER BY n DESC, channel) = 1)
, h AS (SELECT rep_id, product_name, territory_id, date, CASE WHEN abs(sum(v)) > 1e-12 THEN sum(v * v) / sum(v) / sum(v) ELSE 0 END AS channel_mix FROM n GROUP BY ALL)
, p AS (SELECT rep_id, count(DISTINCT customer_id) AS assigned_customer_portfolio FROM ledger GROUP BY 1)
, t AS (SELECT city AS territory_id, count(DISTINCT customer_id) AS territory_customer_count,
   count(DISTINCT customer_id) / greatest(1, (1 + coalesce(stddev_samp(quantity), 0) * 111.0) * (1 + coalesce(stddev_samp(discount_pct), 0) * 85.0)) AS territory_customer_density FROM ledger GROUP BY 1)
SELECT g.*, channel, channel_mix, assigned_customer_portfolio, territory_customer_count, territory_customer_density
FROM g JOIN m USING (rep_id, product_name, territory_id, date) JOIN h USING (rep_id, product_name, territory_id, date) JOIN p USING (rep_id) JOIN t USING (territory_id)""",
       floats="total_sales total_quantity average_price channel_mix territory_customer_density", digits=4)
def legacy_enriched_grain(spark, sf):
    led = ledger(spark, sf).select(
        "rep_id", F.col("product_class").alias("product_name"), F.col("city").alias("territory_id"), F.col("period").alias("date"), F.col("customer_id").alias("customer"),
        "sales", "quantity", "price", F.col("quantity").alias("latitude"), F.col("discount_pct").alias("longitude"), "country", "city", "product_class", "channel",
        F.col("channel").alias("subchannel"), F.col("manager").alias("sales_manager"), F.col("team").alias("sales_team"))
    return X.legacy_grain(led).select("rep_id", "product_name", "territory_id", "date", "total_sales", "total_quantity", "average_price", "unique_customers", "transaction_count",
                                      "channel", "channel_mix", "assigned_customer_portfolio", "territory_customer_count", "territory_customer_density")


@query("sorted_token_join", LEDGER + """
SELECT rep_id, period, string_agg(DISTINCT country, '|' ORDER BY country) AS countries FROM ledger GROUP BY ALL""")
def sorted_token_join(spark, sf):
    return ledger(spark, sf).groupBy("rep_id", "period").agg(A.token_join("country").alias("countries"))


@query("truth_rollup", """
WITH d AS (SELECT source, lang, toxic = 1 AS y, CASE WHEN quality = 0 THEN 'low_quality' ELSE 'none' END AS kind, CASE WHEN toxic = 1 THEN lang END AS severity
  FROM documents JOIN labels USING (doc_id))
SELECT source, lang, max(y) AS ground_truth_label, CASE WHEN max((kind = 'low_quality')::INT) = 1 THEN 'low_quality' ELSE 'none' END AS anomaly_type,
  coalesce(max(severity), 'none') AS severity FROM d GROUP BY ALL""")
def truth_rollup(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        "source", "lang", F.col("toxic").alias("y"), F.when(F.col("quality") == 0, "low_quality").otherwise("none").alias("anomaly_type"),
        F.when(F.col("toxic") == 1, F.col("lang")).alias("severity"))
    return A.truth_rollup(d, ["source", "lang"], "y", ["anomaly_type", "severity"])


@query("lineage_precedence", LEDGER + """
, l AS (SELECT rep_id, period, CASE WHEN return_flag AND discount_pct >= 0.09 THEN 'synthetic_injected' WHEN quantity > 25 THEN 'source_observed' ELSE 'synthetic_derived' END AS lineage FROM ledger)
, n AS (SELECT rep_id, period, lineage, count(*) AS n FROM l GROUP BY ALL)
SELECT rep_id, period, CASE WHEN max((lineage = 'synthetic_injected')::INT) = 1 THEN 'synthetic_injected' ELSE arg_max(lineage, n * 10 - (lineage = 'synthetic_derived')::INT) END AS data_lineage
FROM n GROUP BY ALL""")
def lineage_precedence(spark, sf):
    kind = F.when(F.col("return_flag") & (F.col("discount_pct") >= 0.09), "synthetic_injected").when(F.col("quantity") > 25, "source_observed").otherwise("synthetic_derived")
    return A.lineage_precedence(ledger(spark, sf).withColumn("data_lineage", kind), ["rep_id", "period"])


@query("entity_risk_summary", CLASS_MONTH + """
, t AS (SELECT rep_id, product_class, period, total_sales, transaction_count, total_sales < -50000 AS flag FROM class_month)
, top AS (SELECT rep_id, product_class, period, transaction_count FROM t QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY transaction_count DESC, product_class || strftime(period, '%Y%m')) = 1)
, a AS (SELECT rep_id, sum(total_sales) AS sales, CAST(sum(flag::INT) AS BIGINT) AS flagged_observations, count(*) AS observations FROM t GROUP BY 1)
SELECT top.*, sales, flagged_observations, observations, flagged_observations / observations AS flagged_observation_rate FROM top JOIN a USING (rep_id)""", floats="sales flagged_observation_rate")
def entity_risk_summary(spark, sf):
    t = class_month(spark, sf).withColumn("flag", F.col("total_sales") < -50000).withColumn("tie", F.concat("product_class", F.date_format("period", "yyyyMM")))
    return A.entity_risk_summary(t, "rep_id", "transaction_count", "flag", "tie", {"sales": "total_sales"}, ["product_class", "period"]).drop("tie")


@query("cluster_profiles", LEDGER + """
, r AS (SELECT rep_id, period, any_value(team) AS team, sum(sales) AS total_sales, sum(quantity) AS total_quantity, count(*) >= 10 AS flag,
   CASE WHEN count(*) <= 4 THEN -1 WHEN count(*) <= 8 THEN 0 ELSE 1 END AS cluster FROM ledger GROUP BY ALL)
, a AS (SELECT count(*) AS n, avg(total_sales) AS s, median(total_sales) AS ms, avg(total_quantity) AS q, median(total_quantity) AS mq FROM r)
, t AS (SELECT cluster, team, count(*) AS n FROM r GROUP BY ALL)
, m AS (SELECT cluster, team AS dominant_team FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, team) = 1)
SELECT cluster, count(*) AS population, count(*) / any_value(n) * 100 AS population_pct, sum(total_sales) AS total_sales_sum, avg(flag::INT) AS anomaly_rate, any_value(dominant_team) AS dominant_team,
  avg(total_sales) AS mean_total_sales, median(total_sales) AS median_total_sales, (avg(total_sales) - any_value(s)) / greatest(abs(any_value(s)), 1e-9) * 100 AS total_sales_vs_population_mean_pct,
  (median(total_sales) - any_value(ms)) / greatest(abs(any_value(ms)), 1e-9) * 100 AS total_sales_vs_population_median_pct,
  avg(total_quantity) AS mean_total_quantity, median(total_quantity) AS median_total_quantity
FROM r JOIN m USING (cluster) CROSS JOIN a GROUP BY cluster""",
       floats="population_pct total_sales_sum anomaly_rate mean_total_sales median_total_sales total_sales_vs_population_mean_pct total_sales_vs_population_median_pct mean_total_quantity median_total_quantity", digits=4)
def cluster_profiles(spark, sf):
    r = ledger(spark, sf).groupBy("rep_id", "period").agg(F.max("team").alias("team"), F.sum("sales").alias("total_sales"), F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("n"))
    r = r.withColumn("flag", F.col("n") >= 10).withColumn("cluster", F.when(F.col("n") <= 4, -1).when(F.col("n") <= 8, 0).otherwise(1))
    out = A.cluster_profiles(r, "cluster", {"total_sales": "sales", "total_quantity": "quantity"}, "flag", {"dominant_team": "team"}, "total_sales")
    return out.drop("business_interpretation", "total_quantity_vs_population_mean_pct", "total_quantity_vs_population_median_pct")


@query("organisation_summary", REP_MONTH + """
SELECT manager, count(*) AS observations, count(DISTINCT rep_id) AS representatives, CAST(sum((transaction_count >= 10)::INT) AS BIGINT) AS review_candidates,
  avg((transaction_count >= 10)::INT) AS flag_rate, sum(total_sales) AS total_sales_total, avg(total_quantity) AS total_quantity_mean FROM rep_month GROUP BY 1 ORDER BY flag_rate DESC""",
       floats="flag_rate total_sales_total total_quantity_mean")
def organisation_summary(spark, sf):
    df = rep_month(spark, sf).withColumn("flag", F.col("transaction_count") >= 10)
    return A.organisation_summary(df, "manager", "rep_id", "flag", ["total_sales"], ["total_quantity"]).orderBy(F.col("flag_rate").desc())


@query("geography_breakdown", LEDGER + """
SELECT country, city, sum(sales) AS sales, count(*) AS lines, avg(return_flag::INT) AS return_rate, avg(discount_pct) AS average_discount FROM ledger GROUP BY ALL""",
       floats="sales return_rate average_discount")
def geography_breakdown(spark, sf):
    return ledger(spark, sf).groupBy("country", "city").agg(F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("lines"), A.rate(F.col("return_flag")).alias("return_rate"),
                                                            F.avg("discount_pct").alias("average_discount"))


@query("category_comparison_top_decile", SCORES + """
, c AS (SELECT source, fine_score, fine_score >= (SELECT quantile_cont(fine_score, 0.9) FROM scores) AS flag FROM scores)
SELECT source, count(*) AS observations, avg(flag::INT) AS anomaly_rate, avg(fine_score) AS average_score FROM c GROUP BY 1 ORDER BY observations DESC, source LIMIT 15""",
       floats="anomaly_rate average_score")
def category_comparison_top_decile(spark, sf):
    return A.category_comparison(scores(spark, sf), "source", "fine_score")


@query("pivot_flag_rate", LEDGER + """
SELECT product_class, avg(return_flag::INT) FILTER (country = 'AFRICA') AS "AFRICA", avg(return_flag::INT) FILTER (country = 'AMERICA') AS "AMERICA",
  avg(return_flag::INT) FILTER (country = 'ASIA') AS "ASIA", avg(return_flag::INT) FILTER (country = 'EUROPE') AS "EUROPE" FROM ledger GROUP BY 1""", floats="AFRICA AMERICA ASIA EUROPE")
def pivot_flag_rate(spark, sf):
    return A.pivot_rate(ledger(spark, sf), "product_class", "country", ["AFRICA", "AMERICA", "ASIA", "EUROPE"], "return_flag")


@query("unpivot_metrics", REP_MONTH + """
SELECT rep_id, period, 'total_sales' AS metric, total_sales AS value FROM rep_month UNION ALL SELECT rep_id, period, 'total_quantity', total_quantity FROM rep_month""", floats="value")
def unpivot_metrics(spark, sf):
    return R.unpivot(rep_month(spark, sf), ["rep_id", "period"], ["total_sales", "total_quantity"], "metric", "value")


@query("score_histogram", SCORES + """
, s AS (SELECT lang, fine_score, fine_score / (SELECT max(fine_score) FROM scores) AS x FROM scores)
, g AS (SELECT lang, b, count(*) AS n FROM s CROSS JOIN range(10) t(b) GROUP BY ALL)
, c AS (SELECT lang, least(floor(x * 10), 9) AS b, count(*) AS n, avg(fine_score) AS r, avg(x) AS m FROM s GROUP BY ALL)
SELECT g.lang, CAST(g.b + 1 AS INTEGER) AS bin, g.b / 10.0::DOUBLE AS score_lower, (g.b + 1) / 10.0::DOUBLE AS score_upper, coalesce(c.n, 0) AS count, coalesce(c.n, 0) / g.n AS share,
  r AS mean_raw_score, m AS mean_score FROM g LEFT JOIN c ON g.lang = c.lang AND g.b = c.b""", floats="score_lower score_upper share mean_raw_score mean_score")
def score_histogram(spark, sf):
    s = scores(spark, sf)
    s = R.with_scalars(s, s.agg(F.max("fine_score").alias("top"))).withColumn("x", F.col("fine_score") / F.col("top"))
    return A.score_histogram(s, ["lang"], "x", "fine_score", 10)


@query("pearson_matrix", LEDGER + """
SELECT 'quantity' AS left_column, 'quantity' AS right_column, corr(quantity, quantity) AS correlation FROM ledger UNION ALL SELECT 'quantity', 'price', corr(quantity, price) FROM ledger UNION ALL
SELECT 'price', 'quantity', corr(price, quantity) FROM ledger UNION ALL SELECT 'price', 'price', corr(price, price) FROM ledger""", floats="correlation", digits=8)
def pearson_matrix(spark, sf):
    return A.pearson_matrix(ledger(spark, sf), ["quantity", "price"])


@query("spearman_correlation", REP_MONTH + """
, r AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY total_sales) + (count(*) OVER (PARTITION BY period, total_sales) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY period ORDER BY transaction_count) + (count(*) OVER (PARTITION BY period, transaction_count) - 1) / 2.0 AS b FROM rep_month)
SELECT period, corr(a, b) AS spearman FROM r GROUP BY 1""", floats="spearman")
def spearman_correlation(spark, sf):
    return A.spearman(rep_month(spark, sf), "total_sales", "transaction_count", ["period"])


@query("column_profile", """
WITH c AS (SELECT 'c_acctbal' AS column_name, 'double' AS dtype, CAST(c_acctbal AS VARCHAR) AS t, c_acctbal AS v FROM customer UNION ALL
  SELECT 'c_nationkey', 'int', CAST(c_nationkey AS VARCHAR), c_nationkey FROM customer UNION ALL SELECT 'c_mktsegment', 'string', c_mktsegment, NULL FROM customer)
, w AS (SELECT column_name, t, count(*) AS n FROM c WHERE v IS NULL GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, t) = 1)
SELECT column_name, dtype, count(t) AS non_null_count, count(*) - count(t) AS missing_count, (count(*) - count(t)) / count(*) * 100 AS missing_pct, count(DISTINCT t) AS cardinality,
  min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.25) AS p25, median(v) AS median, quantile_cont(v, 0.75) AS p75,
  (SELECT t FROM w WHERE w.column_name = c.column_name) AS most_common_value, (SELECT n FROM w WHERE w.column_name = c.column_name) AS most_common_count FROM c GROUP BY ALL""".replace(
    "GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, t) = 1", "GROUP BY column_name, t QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, t) = 1").replace(
    "FROM c GROUP BY ALL", "FROM c GROUP BY column_name, dtype"), floats="missing_pct min max mean std p25 median p75", digits=4)
def column_profile(spark, sf):
    return A.column_profile(read(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment"))


@query("missing_rate_checks", """
WITH j AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT 'missing_rate__doc_id' AS check_name, avg((doc_id IS NULL)::INT) AS value FROM j UNION ALL
  SELECT 'missing_rate__quality', avg((quality IS NULL)::INT) FROM j UNION ALL SELECT 'missing_rate__toxic', avg((toxic IS NULL)::INT) FROM j)
SELECT check_name, CASE WHEN value > 0 THEN 'warning' ELSE 'pass' END AS status, value FROM r""", floats="value")
def missing_rate_checks(spark, sf):
    return A.missing_rates(read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic"))


@query("forecast_error_metrics", REP_MONTH + """
, f AS (SELECT rep_id, CAST(total_quantity AS DOUBLE) AS y, lag(total_quantity) OVER (PARTITION BY rep_id ORDER BY period) AS p FROM rep_month)
SELECT rep_id, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, sum(abs(p - y)) / greatest(sum(abs(y)), 1) AS wape,
  avg(2 * abs(p - y) / greatest(abs(p) + abs(y), 1)) AS smape, avg(p - y) AS bias FROM f WHERE p IS NOT NULL GROUP BY 1""", floats="mae rmse wape smape bias")
def forecast_error_metrics(spark, sf):
    from pyspark.sql import Window as W
    f = rep_month(spark, sf).withColumn("p", F.lag("total_quantity").over(W.partitionBy("rep_id").orderBy("period"))).filter("p IS NOT NULL")
    return A.forecast_errors(f, ["rep_id"], "total_quantity", "p")


@query("kpi_row", LEDGER + """
, r AS (SELECT rep_id, sum(sales) AS s, count(*) >= 8 AS flag FROM ledger GROUP BY rep_id, period)
SELECT sum(s) AS total_sales, CAST(sum(flag::INT) AS BIGINT) AS candidates, count(DISTINCT CASE WHEN flag THEN rep_id END) AS flagged_reps, avg(flag::INT) AS review_rate,
  sum(greatest(-s, 0)) AS positive_gap FROM r""", floats="total_sales review_rate positive_gap")
def kpi_row(spark, sf):
    r = rep_month(spark, sf).withColumn("flag", F.col("transaction_count") >= 8)
    return r.agg(F.sum("total_sales").alias("total_sales"), F.sum(F.col("flag").cast("long")).alias("candidates"), F.count_distinct(F.when(F.col("flag"), F.col("rep_id"))).alias("flagged_reps"),
                 A.rate(F.col("flag")).alias("review_rate"), F.sum(F.greatest(-F.col("total_sales"), F.lit(0.0))).alias("positive_gap"))


@query("country_coverage", LEDGER + """
SELECT country, min(order_date) AS start, max(order_date) AS "end", count(*) AS rows FROM ledger GROUP BY 1""")
def country_coverage(spark, sf):
    return A.coverage(ledger(spark, sf), ["country"], "order_date")


@query("value_counts", """
SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1""")
def value_counts(spark, sf):
    return A.value_counts(read(spark, sf, "orders"), "o_orderpriority")


@query("union_by_name", LEDGER + """
, a AS (SELECT rep_id, period, sum(sales) AS sales FROM ledger WHERE return_flag GROUP BY ALL), b AS (SELECT rep_id, period, count(*) AS lines FROM ledger WHERE NOT return_flag GROUP BY ALL)
SELECT rep_id, period, sales, CAST(NULL AS BIGINT) AS lines FROM a UNION ALL SELECT rep_id, period, NULL, lines FROM b""", floats="sales")
def union_by_name(spark, sf):
    led = ledger(spark, sf)
    a = led.filter("return_flag").groupBy("rep_id", "period").agg(F.sum("sales").alias("sales"))
    return a.unionByName(led.filter("NOT return_flag").groupBy("rep_id", "period").agg(F.count(F.lit(1)).alias("lines")), allowMissingColumns=True)


@query("exact_duplicates", LEDGER + """
, g AS (SELECT customer_id, period, product_class, count(*) AS n FROM ledger GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicates FROM g""")
def exact_duplicates(spark, sf):
    g = ledger(spark, sf).groupBy("customer_id", "period", "product_class").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("distinct_key_union", LEDGER + """
SELECT rep_id, period, city FROM ledger UNION SELECT rep_id, CAST(date_trunc('month', ship_date) AS DATE), city FROM ledger""")
def distinct_key_union(spark, sf):
    led = ledger(spark, sf)
    return led.select("rep_id", "period", "city").unionByName(led.select("rep_id", F.trunc("ship_date", "MM").alias("period"), "city")).distinct()


@query("key_set_difference", LEDGER + """
, a AS (SELECT DISTINCT rep_id, period FROM ledger WHERE return_flag), b AS (SELECT DISTINCT rep_id, period FROM ledger WHERE NOT return_flag)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_set_difference(spark, sf):
    led = ledger(spark, sf)
    a, b = (led.filter(c).select("rep_id", "period").distinct() for c in ("return_flag", "NOT return_flag"))
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


