"""Past-only windows."""

from pyspark.sql import functions as F

from quotalens.operators import history as H, ranking as R
from quotalens.queries.base import CLASS_MONTH, LEDGER, REP_MONTH, class_month, ledger, rep_month
from quotalens.queries.registry import query

KEY = ["rep_id"]
# A month number lets SQL state the same calendar frames as RANGE windows.
NUMBERED = REP_MONTH + """
, t AS (SELECT rep_id, period, total_sales AS x, CAST(total_quantity AS DOUBLE) AS q, year(period) * 12 + month(period) AS m FROM rep_month)"""


def series(spark, sf):
    return rep_month(spark, sf).select("rep_id", "period", F.col("total_sales").alias("x"), F.col("total_quantity").alias("q"))


@query("calendar_lags", NUMBERED + """
SELECT a.rep_id, a.period, l1.x AS lag_1, l2.x AS lag_2, l3.x AS lag_3, l6.x AS lag_6, l12.x AS lag_12 FROM t a
LEFT JOIN t l1 ON l1.rep_id = a.rep_id AND l1.m = a.m - 1 LEFT JOIN t l2 ON l2.rep_id = a.rep_id AND l2.m = a.m - 2
LEFT JOIN t l3 ON l3.rep_id = a.rep_id AND l3.m = a.m - 3 LEFT JOIN t l6 ON l6.rep_id = a.rep_id AND l6.m = a.m - 6
LEFT JOIN t l12 ON l12.rep_id = a.rep_id AND l12.m = a.m - 12""", floats="lag_1 lag_2 lag_3 lag_6 lag_12")
def calendar_lags(spark, sf):
    return series(spark, sf).select("rep_id", "period", *[
        H.calendar_lag("x", n, KEY, "period").alias(f"lag_{n}") for n in (1, 2, 3, 6, 12)])


@query("calendar_rolling_statistics", NUMBERED + """
SELECT rep_id, period, avg(x) OVER w3 AS mean_3, avg(x) OVER w6 AS mean_6,
  CASE WHEN count(x) OVER w6 >= 2 THEN median(x) OVER w6 END AS median_6,
  CASE WHEN count(x) OVER w6 >= 2 THEN stddev_samp(x) OVER w6 END AS std_6 FROM t
WINDOW w3 AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w6 AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)""", floats="mean_3 mean_6 median_6 std_6", digits=4)
def calendar_rolling_statistics(spark, sf):
    c = lambda n, s, k=1: H.calendar_prior("x", n, s, KEY, "period", k)
    return series(spark, sf).select("rep_id", "period", c(3, "mean").alias("mean_3"), c(6, "mean").alias("mean_6"),
                                    c(6, "median", 2).alias("median_6"), c(6, "std", 2).alias("std_6"))


@query("calendar_rolling_mad", NUMBERED + """
, w AS (SELECT rep_id, period, list(x) OVER w6 AS h FROM t
  WINDOW w6 AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT rep_id, period, CASE WHEN len(h) >= 3 THEN list_median(list_transform(h, lambda v: abs(v - list_median(h)))) END AS mad FROM w""",
       floats="mad")
def calendar_rolling_mad(spark, sf):
    return series(spark, sf).select("rep_id", "period", H.calendar_prior_mad("x", 6, KEY, "period").alias("mad"))


@query("growth_trend_acceleration", NUMBERED + """
, l AS (SELECT a.rep_id, a.period, a.x, l1.x AS x1, l2.x AS x2, l3.x AS x3, l12.x AS x12 FROM t a
  LEFT JOIN t l1 ON l1.rep_id = a.rep_id AND l1.m = a.m - 1 LEFT JOIN t l2 ON l2.rep_id = a.rep_id AND l2.m = a.m - 2
  LEFT JOIN t l3 ON l3.rep_id = a.rep_id AND l3.m = a.m - 3 LEFT JOIN t l12 ON l12.rep_id = a.rep_id AND l12.m = a.m - 12)
SELECT rep_id, period, (x - x1) / greatest(abs(x1), 1) AS mom, (x - x12) / greatest(abs(x12), 1) AS yoy,
  (x1 - x3) / greatest(abs(x3), 1) AS trend,
  (x - x1) / greatest(abs(x1), 1) - (x1 - x2) / greatest(abs(x2), 1) AS acceleration FROM l""", floats="mom yoy trend acceleration")
def growth_trend_acceleration(spark, sf):
    df = H.metric_history(series(spark, sf), "x", KEY, "period")
    return df.select("rep_id", "period", F.col("x_month_over_month_growth").alias("mom"), F.col("x_year_over_year_growth").alias("yoy"),
                     F.col("x_trend").alias("trend"), F.col("x_acceleration").alias("acceleration"))


@query("history_deviation", NUMBERED + """
, w AS (SELECT rep_id, period, x, list(x) OVER w6 AS h FROM t
  WINDOW w6 AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING))
, d AS (SELECT *, CASE WHEN len(h) >= 2 THEN list_median(h) END AS med,
  CASE WHEN len(h) >= 3 THEN list_median(list_transform(h, lambda v: abs(v - list_median(h)))) END AS mad FROM w)
SELECT rep_id, period, CASE WHEN mad IS NOT NULL THEN (x - med) / greatest(abs(greatest(1.4826 * mad, abs(med) * 0.1)), 1) END AS deviation FROM d""",
       floats="deviation")
def history_deviation(spark, sf):
    df = H.metric_history(series(spark, sf), "x", KEY, "period")
    return df.select("rep_id", "period", F.col("x_history_deviation").alias("deviation"))


@query("row_rolling_prior", NUMBERED + """
SELECT rep_id, period, avg(x) OVER w3 AS mean_3, stddev_samp(x) OVER w6 AS std_6 FROM t
WINDOW w3 AS (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w6 AS (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""", floats="mean_3 std_6", digits=4)
def row_rolling_prior(spark, sf):
    return series(spark, sf).select("rep_id", "period", H.row_prior("x", 3, "mean", KEY, "period").alias("mean_3"),
                                    H.row_prior("x", 6, "std", KEY, "period", 2).alias("std_6"))


@query("percent_change_clipped", NUMBERED + """
, p AS (SELECT rep_id, period, x, lag(x) OVER (PARTITION BY rep_id ORDER BY period) AS y FROM t)
SELECT rep_id, period, greatest(least(coalesce(CASE WHEN y <> 0 THEN (x - y) / y END, 0), 10), -10) AS change FROM p""", floats="change")
def percent_change_clipped(spark, sf):
    return series(spark, sf).select("rep_id", "period", H.percent_change("x", KEY, "period").alias("change"))


@query("prior_cumulative_sum", NUMBERED + """
SELECT rep_id, period, coalesce(sum(x) OVER (PARTITION BY rep_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM t""",
       floats="prior")
def prior_cumulative_sum(spark, sf):
    return series(spark, sf).select("rep_id", "period", H.prior_total("x", KEY, "period").alias("prior"))


@query("prior_expanding_median_price", LEDGER + """
, m AS (SELECT product_id, period, median(price) AS price FROM ledger GROUP BY ALL)
SELECT product_id, period, price, median(price) OVER (PARTITION BY product_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS norm FROM m""",
       floats="price norm")
def prior_expanding_median_price(spark, sf):
    m = R.quantiles(ledger(spark, sf), ["product_id", "period"], "price", {"price": 0.5})
    return m.select("product_id", "period", "price", H.prior_expanding_median("price", ["product_id"], "period").alias("norm"))


@query("customer_potential_as_of", LEDGER + """
, h AS (SELECT customer_id, period, sum(abs(sales)) AS s FROM ledger GROUP BY ALL)
, p AS (SELECT customer_id, period, coalesce(sum(s) OVER (PARTITION BY customer_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM h)
, r AS (SELECT customer_id, period, max(prior) OVER (PARTITION BY period) AS top, (rank() OVER (PARTITION BY period ORDER BY prior)
   + (count(*) OVER (PARTITION BY period, prior) - 1) / 2.0) / count(*) OVER (PARTITION BY period) AS pct FROM p)
, q AS (SELECT customer_id, period, greatest(1, least(100, CASE WHEN top <= 0 THEN 50.0 ELSE 10.0 + 90.0 * pct END)) AS potential FROM r)
SELECT customer_id, period, potential, CASE WHEN potential >= 75 THEN 'high' WHEN potential >= 40 THEN 'medium' ELSE 'low' END AS priority FROM q""",
       floats="potential")
def customer_potential_as_of(spark, sf):
    from quotalens.operators.features import customer_context
    return customer_context(ledger(spark, sf), "customer_id", "period", "sales")


@query("territory_potential_as_of", LEDGER + """
, s AS (SELECT city, period, sum(abs(sales)) AS s FROM ledger GROUP BY ALL)
, f AS (SELECT city, period, count(*) AS n FROM (SELECT city, customer_id, min(period) AS period FROM ledger GROUP BY ALL) GROUP BY ALL)
, h AS (SELECT city, period, s, coalesce(n, 0) AS n FROM s LEFT JOIN f USING (city, period))
, p AS (SELECT city, period, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM h
   WINDOW w AS (PARTITION BY city ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, r AS (SELECT city, period, max(ps) OVER (PARTITION BY period) AS top,
   (rank() OVER (PARTITION BY period ORDER BY ps) + (count(*) OVER (PARTITION BY period, ps) - 1) / 2.0) / count(*) OVER (PARTITION BY period) AS a,
   (rank() OVER (PARTITION BY period ORDER BY pn) + (count(*) OVER (PARTITION BY period, pn) - 1) / 2.0) / count(*) OVER (PARTITION BY period) AS b FROM p)
SELECT city, period, greatest(1, least(100, CASE WHEN top <= 0 THEN 50.0 ELSE 50.0 + 25.0 * (a + b - 1) END)) AS potential FROM r""", floats="potential")
def territory_potential_as_of(spark, sf):
    from quotalens.operators.features import territory_context
    return territory_context(ledger(spark, sf), "city", "customer_id", "period", "sales")


@query("seasonal_index_prior_only", LEDGER + """
, s AS (SELECT period, sum(sales) AS x FROM ledger GROUP BY 1)
, a AS (SELECT period, avg(x) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al,
   avg(x) OVER (PARTITION BY month(period) ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM s)
SELECT period, least(1.3, greatest(0.7, coalesce(CASE WHEN abs(al) >= 1e-12 THEN same / al END, 1))) AS season FROM a""", floats="season")
def seasonal_index_prior_only(spark, sf):
    monthly = ledger(spark, sf).groupBy("period").agg(F.sum("sales").alias("x")).withColumn("_one", F.lit(1))
    return monthly.select("period", H.seasonal_index("x", "period", ["_one"]).alias("season"))


@query("repeated_prior_flags", REP_MONTH + """
SELECT rep_id, period, CAST(coalesce(sum((total_sales < 0)::INT) OVER (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS repeats
FROM rep_month""")
def repeated_prior_flags(spark, sf):
    df = rep_month(spark, sf).withColumn("flag", F.col("total_sales") < 0)
    return df.select("rep_id", "period", H.repeated_flags("flag", 3, KEY, "period").cast("long").alias("repeats"))


@query("overlapping_intervals", """
WITH v AS (SELECT event_id, user_id, ts, ts + to_microseconds(CAST(floor(value * 60) AS BIGINT) * 1000000) AS te FROM events)
, o AS (SELECT event_id, user_id, ts, max(te) OVER (PARTITION BY user_id ORDER BY ts, te, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy,
   count(*) OVER (PARTITION BY user_id, ts) AS same_start FROM v)
SELECT event_id, user_id, coalesce(ts < busy, false) AS overlap, same_start > 1 AS duplicate_start FROM o""")
def overlapping_intervals(spark, sf):
    from quotalens.operators.quality import overlaps
    from quotalens.queries.base import read
    ev = read(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("start"),
                                          F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60) * 1000000).alias("end"))
    return overlaps(ev, ["user_id"], "start", "end", "event_id").select("event_id", "user_id", "overlap", "duplicate_start")


@query("exact_three_month_sums", NUMBERED + """
, w AS (SELECT rep_id, period, CASE WHEN count(x) OVER a = 3 THEN sum(x) OVER a END AS recent,
   CASE WHEN count(x) OVER b = 3 THEN sum(x) OVER b END AS before FROM t
   WINDOW a AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),
     b AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING))
SELECT rep_id, period, recent, before, CASE WHEN before <> 0 THEN (recent - before) / abs(before) END AS growth FROM w""", floats="recent before growth")
def exact_three_month_sums(spark, sf):
    df = series(spark, sf).select("rep_id", "period", H.exact_window_sum("x", 3, KEY, "period").alias("recent"),
                                  H.exact_window_sum("x", 3, KEY, "period", -3).alias("before"))
    return df.withColumn("growth", F.when(F.col("before") != 0, (F.col("recent") - F.col("before")) / F.abs("before")))


@query("six_month_workload_growth", NUMBERED + """
, w AS (SELECT rep_id, period, count(q) OVER a AS na, count(q) OVER b AS nb, sum(q) OVER a AS recent, sum(q) OVER b AS before FROM t
   WINDOW a AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),
     b AS (PARTITION BY rep_id ORDER BY m RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING))
SELECT rep_id, period, CASE WHEN na = 3 AND nb = 3 AND before > 0 THEN recent / before - 1 END AS growth FROM w""", floats="growth")
def six_month_workload_growth(spark, sf):
    return series(spark, sf).select("rep_id", "period", H.recent_growth("q", 3, KEY, "period").alias("growth"))


@query("period_over_period_change", LEDGER + """
, s AS (SELECT team, period, avg(sales) AS mean_sale FROM ledger GROUP BY ALL)
SELECT team, period, mean_sale - lag(mean_sale) OVER (PARTITION BY team ORDER BY period) AS change FROM s""", floats="change", digits=4)
def period_over_period_change(spark, sf):
    s = ledger(spark, sf).groupBy("team", "period").agg(F.avg("sales").alias("mean_sale"))
    return s.select("team", "period", H.change_from_previous("mean_sale", ["team"], "period").alias("change"))


@query("selected_overlap_previous_period", REP_MONTH + """
, sel AS (SELECT rep_id, period FROM rep_month WHERE transaction_count >= 10)
, p AS (SELECT DISTINCT period, CAST(period - INTERVAL 1 MONTH AS DATE) AS prev FROM rep_month)
SELECT p.period, count(a.rep_id) / greatest(1, (SELECT count(*) FROM sel s WHERE s.period = p.prev)) AS overlap
FROM p JOIN (SELECT DISTINCT period FROM rep_month) x ON x.period = p.prev
LEFT JOIN sel a ON a.period = p.period AND EXISTS (SELECT 1 FROM sel b WHERE b.period = p.prev AND b.rep_id = a.rep_id)
GROUP BY p.period, p.prev""", floats="overlap")
def selected_overlap_previous_period(spark, sf):
    from quotalens.operators.metrics import selection_overlap
    df = rep_month(spark, sf).withColumn("selected", F.col("transaction_count") >= 10)
    return selection_overlap(df, [], "period", "rep_id", "selected").filter(F.col("overlap").isNotNull())


@query("peak_on_every_row", CLASS_MONTH + """
, b AS (SELECT rep_id, period, max(total_sales) AS best FROM class_month GROUP BY ALL)
SELECT rep_id, product_class, period, total_sales, best FROM class_month JOIN b USING (rep_id, period)""", floats="total_sales best")
def peak_on_every_row(spark, sf):
    return R.with_totals(class_month(spark, sf).select("rep_id", "product_class", "period", "total_sales"),
                         ["rep_id", "period"], best=F.max("total_sales"))

