"""Peers and detectors."""

from pyspark.sql import functions as F

from quotalens.operators import detectors as D, peers as P, ranking as R
from quotalens.queries.base import CLASS_MONTH, REP_MONTH, class_month, rep_month
from quotalens.queries.registry import query
from quotalens.session import checkpointed

LEVELS = {"class_country_team": ["product_class", "peer_country", "team", "period"], "class_country": ["product_class", "peer_country", "period"],
          "class": ["product_class", "period"], "date": ["period"]}


def peer_rows(spark, sf):
    df = class_month(spark, sf).withColumn("observation_id", F.concat_ws("|", F.col("rep_id").cast("string"), "product_class", F.date_format("period", "yyyy-MM")))
    return df


def _peer_sql(metrics):
    """Cohort by cohort in SQL: four window levels, first large enough one wins."""
    keys = ["product_class, peer_country, team, period", "product_class, peer_country, period", "product_class, period", "period"]
    names = list(LEVELS)
    parts = ["""
, o AS (SELECT CAST(rep_id AS VARCHAR) || '|' || product_class || '|' || strftime(period, '%Y-%m') AS observation_id, * FROM class_month)"""]
    selects = []
    for m in metrics:
        cols = ", ".join(f"median({m}) OVER (PARTITION BY {k}) AS m{i}, count(*) OVER (PARTITION BY {k}) AS n{i}, (rank() OVER (PARTITION BY {k} ORDER BY {m}) + "
                         f"(count(*) OVER (PARTITION BY {k}, {m}) - 1) / 2.0) / count(*) OVER (PARTITION BY {k}) AS r{i}" for i, k in enumerate(keys))
        devs = ", ".join(f"median(abs({m} - m{i})) OVER (PARTITION BY {k}) AS d{i}" for i, k in enumerate(keys))
        pick = lambda c: "CASE " + " ".join(f"WHEN n{i} >= 4 THEN {c}{i}" for i in range(4))
        name = "CASE " + " ".join(f"WHEN n{i} >= 4 THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'date_sparse' END"
        selects.append(f"""SELECT observation_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {pick('m')} ELSE m3 END AS peer_median, {pick('d')} ELSE 0 END AS peer_mad,
  {pick('r')} ELSE 0.5 END AS peer_percentile, {name} AS cohort FROM (SELECT *, {devs} FROM (SELECT *, {cols} FROM o))""")
    return "".join(parts) + ", p AS (" + " UNION ALL ".join(selects) + """)
SELECT *, (value - peer_median) / greatest(1.4826 * peer_mad, abs(peer_median) * 0.1, 1) AS robust_z FROM p"""


@query("peer_statistics_with_fallback", CLASS_MONTH + _peer_sql(["total_sales", "total_quantity"]), floats="value peer_median peer_mad peer_percentile robust_z")
def peer_statistics_with_fallback(spark, sf):
    return P.peer_statistics(peer_rows(spark, sf), "observation_id", ["total_sales", "total_quantity"], LEVELS, 4)


@query("peer_review_queue", CLASS_MONTH + _peer_sql(["total_sales"]).replace("SELECT *, (value", ", z AS (SELECT *, (value", 1) + """)
SELECT observation_id, value AS total_sales, peer_median, robust_z, cohort, row_number() OVER (ORDER BY abs(robust_z) DESC, observation_id) <= ceil(count(*) OVER () * 0.05 - 1e-9) AS review_flag FROM z""",
       floats="total_sales peer_median robust_z")
def peer_review_queue(spark, sf):
    """Flagship: scan, join, aggregate, peer cohorts with fallback, exact review budget."""
    z = P.peer_statistics(peer_rows(spark, sf), "observation_id", ["total_sales"], LEVELS, 4)
    z = z.withColumn("size", F.abs("robust_z"))
    flagged = R.top_fraction(z, "size", "observation_id", 0.05, "review_flag")
    return flagged.select("observation_id", F.col("value").alias("total_sales"), "peer_median", "robust_z", "cohort", "review_flag")


@query("peer_means_with_fallback", CLASS_MONTH + """
, a AS (SELECT *, median(total_sales) OVER x AS m0, avg(total_sales) OVER x AS a0, stddev_samp(total_sales) OVER x AS s0, count(*) OVER x AS n0, median(total_sales) OVER y AS m1,
   avg(total_sales) OVER y AS a1, stddev_samp(total_sales) OVER y AS s1, count(*) OVER y AS n1, median(total_sales) OVER () AS m2, avg(total_sales) OVER () AS a2, stddev_samp(total_sales) OVER () AS s2
   FROM class_month WINDOW x AS (PARTITION BY product_class, team, period), y AS (PARTITION BY product_class, period))
, c AS (SELECT rep_id, product_class, period, total_sales, CASE WHEN n0 >= 3 THEN m0 WHEN n1 >= 3 THEN m1 ELSE m2 END AS peer_median, CASE WHEN n0 >= 3 THEN a0 WHEN n1 >= 3 THEN a1 ELSE a2 END AS peer_mean,
   coalesce(nullif(CASE WHEN n0 >= 3 THEN s0 WHEN n1 >= 3 THEN s1 ELSE s2 END, 0), nullif(s2, 0), 1) AS peer_std FROM a)
SELECT CAST(rep_id AS VARCHAR) || '|' || product_class || '|' || strftime(period, '%Y-%m') AS observation_id, peer_median, peer_mean, peer_std, (total_sales - peer_mean) / peer_std AS z FROM c""",
       floats="peer_median peer_mean peer_std z", digits=4)
def peer_means_with_fallback(spark, sf):
    levels = {"class_team": ["product_class", "team", "period"], "class": ["product_class", "period"]}
    return P.peer_means(checkpointed(peer_rows(spark, sf)), "observation_id", "total_sales", levels, 3).drop("value")


@query("cohort_relative_measures", CLASS_MONTH + """
, a AS (SELECT CAST(rep_id AS VARCHAR) || '|' || product_class || '|' || strftime(period, '%Y-%m') AS observation_id, total_sales AS v, median(total_sales) OVER (PARTITION BY team, period) AS t,
  median(total_sales) OVER (PARTITION BY product_class, period) AS c FROM class_month)
SELECT observation_id, 'total_sales' AS metric, 'team' AS cohort, (v - t) / greatest(abs(t), 1) AS relative FROM a UNION ALL SELECT observation_id, 'total_sales', 'product_class', (v - c) / greatest(abs(c), 1) FROM a""",
       floats="relative")
def cohort_relative_measures(spark, sf):
    return P.cohort_relative(checkpointed(peer_rows(spark, sf)), "observation_id", ["total_sales"], {"team": ["team", "period"], "product_class": ["product_class", "period"]})


_SERIES = REP_MONTH + """
, t AS (SELECT CAST(rep_id AS VARCHAR) || '|' || strftime(period, '%Y-%m') AS observation_id, rep_id, period, year(period) * 12 + month(period) AS m, 'total_sales' AS metric, total_sales AS x FROM rep_month
  UNION ALL SELECT CAST(rep_id AS VARCHAR) || '|' || strftime(period, '%Y-%m'), rep_id, period, year(period) * 12 + month(period), 'transaction_count', transaction_count FROM rep_month)
, h AS (SELECT *, list(x) OVER w6 AS h, list(x) OVER wall AS past, count(*) OVER wall AS n, min(x) OVER w12 AS seasonal FROM t
  WINDOW w6 AS (PARTITION BY rep_id, metric ORDER BY m ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), wall AS (PARTITION BY rep_id, metric ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w12 AS (PARTITION BY rep_id, metric ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING))
, e AS (SELECT *, list_median(h) AS expected, list_median(list_transform(h, lambda v: abs(v - list_median(h)))) AS mad, coalesce(len(h), 0) >= 3 AS enough,
   CASE WHEN n > 0 THEN list_reduce(past, lambda a, b: 0.7 * a + 0.3 * b) END AS ewma FROM h)
, s AS (SELECT *, CASE WHEN n > 0 THEN greatest(1.4826 * mad, abs(expected) * 0.1, 1) ELSE 1 END AS scale FROM e)
, r AS (SELECT *, CASE WHEN enough THEN (x - expected) / scale ELSE 0 END AS res, lag(x - expected) OVER (PARTITION BY rep_id, metric ORDER BY m) AS before FROM s)
, c AS (SELECT *, list_reduce(list_prepend(0::DOUBLE, list(CASE WHEN enough THEN res ELSE 0.5 END) OVER w), lambda a, b: greatest(0, a + b - 0.5)) AS up,
   list_reduce(list_prepend(0::DOUBLE, list(CASE WHEN enough THEN -res ELSE 0.5 END) OVER w), lambda a, b: greatest(0, a + b - 0.5)) AS down,
   CASE WHEN n > 3 THEN before / scale ELSE 0 END AS prev FROM r
   WINDOW w AS (PARTITION BY rep_id, metric ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, k AS (SELECT *, CASE WHEN res * prev > 0 AND abs(prev) > 1 THEN greatest(up, down) ELSE 0 END AS level,
   abs(CASE WHEN len(h) >= 6 THEN (list_avg(h[4:6]) - list_avg(h[1:3])) / scale ELSE 0 END) AS trend FROM c)"""


def details(spark, sf):
    df = rep_month(spark, sf).withColumn("observation_id", F.concat_ws("|", F.col("rep_id").cast("string"), F.date_format("period", "yyyy-MM")))
    return D.temporal_details(df, "observation_id", ["rep_id"], "period", ["total_sales", "transaction_count"])


@query("temporal_detector_details", _SERIES + """
, o AS (SELECT observation_id, metric, x AS observed, n AS history_length, 'Rolling Residual' AS model, expected, abs(res) AS score, scale, trend, enough FROM k UNION ALL
  SELECT observation_id, metric, x, n, 'EWMA Residual', ewma, CASE WHEN enough THEN abs(x - ewma) / scale ELSE 0 END, scale, trend, enough FROM k UNION ALL
  SELECT observation_id, metric, x, n, 'Seasonal Residual', seasonal, coalesce(abs(x - seasonal) / scale, 0), scale, trend, enough FROM k UNION ALL
  SELECT observation_id, metric, x, n, 'Change-Point / Level Shift', expected, level, scale, trend, enough FROM k)
SELECT observation_id, metric, observed, history_length, model, expected / (abs(observed) + 0.7) AS expected_ratio, (observed - expected) / scale AS normalized_residual,
  CASE WHEN observed > expected THEN 'up' ELSE 'down' END AS direction, score, trend AS trend_score, enough AND expected IS NOT NULL AS available FROM o""",
       floats="observed expected_ratio normalized_residual score trend_score")
def temporal_detector_details(spark, sf):
    d = details(spark, sf).withColumn("expected_ratio", F.col("expected") / (F.abs("observed") + 0.7))
    return d.drop("rep_id", "period", "anomaly_type", "expected", "residual")


@query("temporal_detector_scores", _SERIES + """
SELECT observation_id, 'Rolling Residual' AS model_name, max(abs(res)) AS raw_score FROM k GROUP BY 1 UNION ALL
SELECT observation_id, 'EWMA Residual', max(CASE WHEN enough THEN abs(x - ewma) / scale ELSE 0 END) FROM k GROUP BY 1 UNION ALL
SELECT observation_id, 'Seasonal Residual', max(coalesce(abs(x - seasonal) / scale, 0)) FROM k GROUP BY 1 UNION ALL
SELECT observation_id, 'Change-Point / Level Shift', max(level) FROM k GROUP BY 1""", floats="raw_score")
def temporal_detector_scores(spark, sf):
    return D.temporal_scores(details(spark, sf), "observation_id")


@query("robust_peer_scores", CLASS_MONTH + _peer_sql(["total_sales", "total_quantity"]).replace("SELECT *, (value", ", z AS (SELECT *, (value", 1) + """)
SELECT observation_id, 'Robust Peer Baseline' AS model_name, max(abs(robust_z)) AS raw_score FROM z GROUP BY 1""", floats="raw_score")
def robust_peer_scores(spark, sf):
    return D.robust_peer(peer_rows(spark, sf), "observation_id", ["total_sales", "total_quantity"], LEVELS)[0]


_RULES = REP_MONTH + """
, b AS (SELECT CAST(rep_id AS VARCHAR) || '|' || strftime(period, '%Y-%m') AS observation_id, rep_id, period, total_sales AS s, total_quantity AS q, transaction_count AS n,
   250.0 + 30.0 * transaction_count AS expected, CASE WHEN total_sales < 0 THEN 100.0 ELSE 0 END AS adj, lag(total_sales) OVER w AS ps, lag(transaction_count) OVER w AS pn FROM rep_month
   WINDOW w AS (PARTITION BY rep_id ORDER BY period))
, f AS (SELECT *, (s - ps) / greatest(abs(ps), 1) AS sg, (n - pn) / greatest(abs(pn), 1) AS cg, (n * 30.0 - pn * 30.0) / greatest(abs(250.0 + 30.0 * pn), 1) AS pg FROM b)
, v AS (SELECT observation_id, rep_id, period, [abs(100 * adj / greatest(abs(expected), 1)) / 25, abs(adj) / greatest(expected, 1) / 0.25, coalesce(greatest(pg, 0) * greatest(-sg, 0) / 0.1, 0) * (pg IS NOT NULL)::INT,
   greatest((expected + adj) / greatest(abs(s), 1) - 0.05, 0) / 0.05, CASE WHEN coalesce(cg, 0) <= 0 THEN greatest(q - 150, 0) / 100 ELSE 0 END,
   coalesce(greatest(sg, 0) * (1.0 / n) / 0.25, 0) * (sg IS NOT NULL)::INT, greatest(2.0 / n - 0.5, 0) / 0.5, coalesce(greatest(cg, 0) / 0.5, 0) * (cg IS NOT NULL)::INT] AS sev FROM f)
, w AS (SELECT *, list_max(list_transform(sev, lambda x: x / (1 + x))) AS score FROM v)
, r AS (SELECT *, coalesce(sum((score >= 0.5)::INT) OVER (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS rep FROM w)"""


def rule_frame(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("rep_id").orderBy("period")
    b = rep_month(spark, sf).withColumn("expected", 250.0 + 30.0 * F.col("transaction_count")).withColumn("adj", F.when(F.col("total_sales") < 0, 100.0).otherwise(0.0))
    growth = lambda c: (F.col(c) - F.lag(c).over(w)) / F.greatest(F.abs(F.lag(c).over(w)), F.lit(1.0))
    return b.select(
        F.concat_ws("|", F.col("rep_id").cast("string"), F.date_format("period", "yyyy-MM")).alias("observation_id"), "rep_id", "period",
        F.when(F.lag("period").over(w).isNotNull(), growth("total_sales")).alias("total_sales_month_over_month_growth"),
        F.when(F.lag("period").over(w).isNotNull(), growth("transaction_count")).alias("customer_growth"),
        F.when(F.lag("period").over(w).isNotNull(), growth("expected")).alias("simulated_actual_payout_month_over_month_growth"),
        (100 * F.col("adj") / F.greatest(F.abs("expected"), F.lit(1.0))).alias("simulated_payout_delta_pct"), F.col("adj").alias("simulated_adjustment"),
        F.col("expected").alias("simulated_expected_incentive"), ((F.col("expected") + F.col("adj")) / F.greatest(F.abs("total_sales"), F.lit(1.0))).alias("simulated_payout_to_sales_ratio"),
        F.col("total_quantity").alias("simulated_target_attainment_pct"), (1.0 / F.col("transaction_count")).alias("customer_concentration"),
        (2.0 / F.col("transaction_count")).alias("product_concentration"))


@query("business_rule_scores", _RULES + """
SELECT observation_id, 'Business Rules' AS model_name, greatest(score, rep / 3.0) AS raw_score FROM r""", floats="raw_score")
def business_rule_scores(spark, sf):
    return D.business_rules(rule_frame(spark, sf), "observation_id", ["rep_id"], "period")[0]


@query("business_rule_details", _RULES + """
, n AS (SELECT observation_id, unnest(['payout_above_expected', 'large_adjustment', 'payout_rising_sales_falling', 'payout_to_sales', 'attainment_without_coverage', 'single_customer_sales_spike',
   'product_concentration', 'coverage_expansion']) AS rule_name, unnest(sev) AS sev FROM r)
SELECT observation_id, rule_name, sev >= 1 AS flag, sev / (1 + sev) AS normalized_severity FROM n UNION ALL SELECT observation_id, 'repeated_unusual_periods', rep >= 2, rep / 3.0 FROM r""", floats="normalized_severity")
def business_rule_details(spark, sf):
    return D.business_rules(rule_frame(spark, sf), "observation_id", ["rep_id"], "period")[1].drop("explanation")


@query("score_contract", _RULES + """
, l AS (SELECT observation_id, period, CASE WHEN period <= DATE '1999-12-01' THEN 'train' WHEN period <= DATE '2000-12-01' THEN 'validation' ELSE 'test' END AS split, greatest(score, rep / 3.0) AS raw_score FROM r)
, t AS (SELECT raw_score AS x FROM l WHERE split = 'train'), e AS (SELECT min(x) AS lo, max(x) AS hi, greatest(stddev_pop(x), (max(x) - min(x)) * 0.1, 1e-8) AS tail, quantile_cont(x, 0.95) AS threshold FROM t)
, ref AS (SELECT x, (sum(count(*)) OVER (ORDER BY x) - count(*) * 0.5) / (sum(count(*)) OVER () + 1) AS y FROM t GROUP BY x), rims AS (SELECT min(y) AS ylo, max(y) AS yhi FROM ref)
, p AS (SELECT l.*, r.x AS x0, r.y AS y0 FROM l ASOF LEFT JOIN ref r ON l.raw_score >= r.x), h2 AS (SELECT p.*, r.x AS x1, r.y AS y1 FROM p ASOF LEFT JOIN ref r ON p.raw_score <= r.x)
SELECT observation_id, period, split, 'Business Rules' AS model_name, raw_score, CASE WHEN raw_score > hi THEN 1 - (1 - yhi) / (1 + (raw_score - hi) / tail) WHEN raw_score < lo THEN ylo / (1 + (lo - raw_score) / tail)
  WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (raw_score - x0) / (x1 - x0) END AS anomaly_score, raw_score > threshold AS threshold_flag FROM h2 CROSS JOIN e CROSS JOIN rims""", floats="raw_score anomaly_score", digits=7)
def score_contract(spark, sf):
    from quotalens.functions import split_label
    frame = checkpointed(rule_frame(spark, sf).withColumn("split", split_label("period", "1999-12-01", "2000-12-01")))
    raw = checkpointed(D.business_rules(frame, "observation_id", ["rep_id"], "period")[0])
    out = D.score_contract(raw, frame, "observation_id", "period", "split", "clean")
    return out.select("observation_id", "period", "split", "model_name", "raw_score", "anomaly_score", "threshold_flag")
