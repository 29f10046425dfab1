"""Ranks, budgets, top-k."""

from pyspark.sql import Window as W, functions as F

from quotalens.operators import ranking as R
from quotalens.queries.base import CLASS_MONTH, LEDGER, REP_MONTH, SCORES, class_month, ledger, rep_month, scores
from quotalens.queries.registry import query


@query("percent_rank_average_ties", CLASS_MONTH + """
SELECT rep_id, product_class, period, transaction_count,
  (rank() OVER (PARTITION BY product_class, period ORDER BY transaction_count)
   + (count(*) OVER (PARTITION BY product_class, period, transaction_count) - 1) / 2.0)
   / count(*) OVER (PARTITION BY product_class, period) AS pct_rank
FROM class_month""", floats="pct_rank")
def percent_rank_average_ties(spark, sf):
    df = class_month(spark, sf).select("rep_id", "product_class", "period", "transaction_count")
    return R.percent_rank_average(df, ["product_class", "period"], "transaction_count", "pct_rank")


@query("average_rank_descending", REP_MONTH + """
SELECT rep_id, period, transaction_count,
  rank() OVER (PARTITION BY period ORDER BY transaction_count DESC)
   + (count(*) OVER (PARTITION BY period, transaction_count) - 1) / 2.0 AS avg_rank
FROM rep_month""", floats="avg_rank")
def average_rank_descending(spark, sf):
    df = rep_month(spark, sf).select("rep_id", "period", "transaction_count")
    return R.average_rank(df, ["period"], "transaction_count", "avg_rank")


@query("top_fraction_review_flags", SCORES + """
SELECT observation_id, score,
  row_number() OVER (ORDER BY score DESC, observation_id) <= greatest(1, ceil(count(*) OVER () * 0.05)) AS review_flag
FROM scores""", floats="score")
def top_fraction_review_flags(spark, sf):
    return R.top_fraction(scores(spark, sf).select("observation_id", "score"), "score", "observation_id", 0.05, "review_flag")


@query("top_fraction_per_split", REP_MONTH + """
SELECT rep_id, period, transaction_count,
  row_number() OVER (PARTITION BY period ORDER BY transaction_count DESC, rep_id)
    <= greatest(1, ceil(count(*) OVER (PARTITION BY period) * 0.1 - 1e-9)) AS review_flag
FROM rep_month""")
def top_fraction_per_split(spark, sf):
    df = rep_month(spark, sf).select("rep_id", "period", "transaction_count")
    return R.top_fraction(df, "transaction_count", "rep_id", 0.1, "review_flag", ["period"])


@query("frozen_review_threshold", SCORES + """
, ranked AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM scores)
SELECT min(score) AS threshold, max(rn) AS review_count FROM ranked WHERE rn <= greatest(1, ceil(n * 0.05))""", floats="threshold")
def frozen_review_threshold(spark, sf):
    return R.budget_threshold(scores(spark, sf), "score", 0.05).select("threshold", "review_count")


@query("top_n_per_group", LEDGER + """
, c AS (SELECT rep_id, customer_id, sum(sales) AS sales FROM ledger GROUP BY ALL)
SELECT rep_id, customer_id, sales, row_number() OVER (PARTITION BY rep_id ORDER BY sales DESC, customer_id) AS rank
FROM c QUALIFY rank <= 3""", floats="sales")
def top_n_per_group(spark, sf):
    c = ledger(spark, sf).groupBy("rep_id", "customer_id").agg(F.sum("sales").alias("sales"))
    top = R.top_n_per_group(c, ["rep_id"], [F.col("sales").desc(), F.col("customer_id")], 3)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("first_row_per_key", CLASS_MONTH + """
SELECT rep_id, product_class, period, total_sales FROM class_month
QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY total_sales DESC, period, product_class) = 1""", floats="total_sales")
def first_row_per_key(spark, sf):
    df = class_month(spark, sf).select("rep_id", "product_class", "period", "total_sales")
    return R.best_row(df, ["rep_id"], [-F.col("total_sales"), F.col("period"), F.col("product_class")])


@query("global_review_rank", REP_MONTH + """
SELECT rep_id, period, transaction_count,
  row_number() OVER (ORDER BY transaction_count DESC, rep_id * 1000000 + year(period) * 100 + month(period)) AS review_rank
FROM rep_month""")
def global_review_rank(spark, sf):
    df = rep_month(spark, sf).select("rep_id", "period", "transaction_count")
    df = df.withColumn("row_key", F.col("rep_id") * 1000000 + F.year("period") * 100 + F.month("period"))
    return R.row_numbers(df, "transaction_count", "row_key", "review_rank").drop("row_key")


@query("largest_groups", LEDGER + """
SELECT distributor, sum(sales) AS sales FROM ledger GROUP BY 1 ORDER BY sales DESC, distributor LIMIT 15""", floats="sales")
def largest_groups(spark, sf):
    return (ledger(spark, sf).groupBy("distributor").agg(F.sum("sales").alias("sales"))
            .orderBy(F.col("sales").desc(), "distributor").limit(15))


@query("stable_sorted_output", REP_MONTH + """
SELECT period, rep_id, total_sales FROM rep_month ORDER BY period, rep_id""", floats="total_sales")
def stable_sorted_output(spark, sf):
    return rep_month(spark, sf).select("period", "rep_id", "total_sales").orderBy("period", "rep_id")


@query("partition_row_number", REP_MONTH + """
SELECT rep_id, period, row_number() OVER (PARTITION BY rep_id ORDER BY period) AS month_number FROM rep_month""")
def partition_row_number(spark, sf):
    w = W.partitionBy("rep_id").orderBy("period")  # at most one row per calendar month
    return rep_month(spark, sf).select("rep_id", "period", F.row_number().over(w).cast("long").alias("month_number"))


@query("rank_change_vs_prior_month", REP_MONTH + """
, r AS (SELECT rep_id, period, rank() OVER (PARTITION BY period ORDER BY total_sales DESC)
          + (count(*) OVER (PARTITION BY period, total_sales) - 1) / 2.0 AS sales_rank FROM rep_month)
SELECT a.rep_id, a.period, a.sales_rank, a.sales_rank - b.sales_rank AS rank_change
FROM r a LEFT JOIN r b ON a.rep_id = b.rep_id AND b.period = CAST(a.period - INTERVAL 1 MONTH AS DATE)""",
       floats="sales_rank rank_change")
def rank_change_vs_prior_month(spark, sf):
    from quotalens.operators.history import calendar_lag
    df = R.average_rank(rep_month(spark, sf), ["period"], "total_sales", "sales_rank").select("rep_id", "period", "sales_rank")
    return (df.withColumn("rank_change", F.col("sales_rank") - calendar_lag("sales_rank", 1, ["rep_id"], "period")))
