"""Detection metrics, calibration, ensembles, stability."""

from pyspark.sql import functions as F

from quotalens.operators import metrics as M, ranking as R
from quotalens.queries.base import LEDGER, REP_MONTH, SCORES, ledger, rep_month, scores
from quotalens.queries.registry import query
from quotalens.session import checkpointed

_FLAGGED = SCORES + """
, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, observation_id) <= greatest(1, ceil(count(*) OVER () * 0.05)) AS flag FROM scores)"""


@query("confusion_metrics", _FLAGGED + """
, c AS (SELECT lang, count(*) FILTER (label AND flag) AS tp, count(*) FILTER (NOT label AND flag) AS fp, count(*) FILTER (label AND NOT flag) AS fn, count(*) FILTER (NOT label AND NOT flag) AS tn FROM f GROUP BY 1)
, d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS s FROM c)
SELECT lang, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, p AS precision, r AS recall,
  CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END AS f1, CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END AS f2, s AS specificity,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (r + s) / 2 END AS balanced_accuracy, tp + fp AS predicted_anomalies, (tp + fp) / (tp + fp + fn + tn) * 100 AS predicted_anomaly_pct FROM d""",
       floats="precision recall f1 f2 specificity balanced_accuracy predicted_anomaly_pct")
def confusion_metrics(spark, sf):
    f = R.top_fraction(scores(spark, sf), "score", "observation_id", 0.05, "flag")
    return M.confusion_metrics(f, ["lang"], "label", "flag")


@query("roc_auc_tied_ranks", SCORES + """
, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM scores)
, g AS (SELECT lang, sum(CASE WHEN label THEN r END) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM r GROUP BY 1)
SELECT lang, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (p * n) END AS roc_auc FROM g""", floats="roc_auc")
def roc_auc_tied_ranks(spark, sf):
    return M.area_metrics(M.score_steps(scores(spark, sf), ["lang"], "label", "score"), ["lang"]).select("lang", "roc_auc")


@query("average_precision_step_sum", SCORES + """
, g AS (SELECT lang, score, count(*) AS n, count(*) FILTER (label) AS p FROM scores GROUP BY ALL)
, c AS (SELECT lang, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY lang) AS tp FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, CASE WHEN max(tp) > 0 THEN sum(p * (cp / cn)) / max(tp) END AS pr_auc FROM c GROUP BY 1""", floats="pr_auc")
def average_precision_step_sum(spark, sf):
    return M.area_metrics(M.score_steps(scores(spark, sf), ["lang"], "label", "score"), ["lang"]).select("lang", "pr_auc")


@query("topk_precision_recall_lift", SCORES + """
, c(cut) AS (VALUES (0.01), (0.05), (0.10)), r AS (SELECT label, row_number() OVER (ORDER BY score DESC, observation_id) AS rn, count(*) OVER () AS n, count(*) FILTER (label) OVER () AS p FROM scores)
, g AS (SELECT cut, max(n) AS n, max(p) AS p, count(*) FILTER (rn <= greatest(1, ceil(n * cut))) AS k, count(*) FILTER (rn <= greatest(1, ceil(n * cut)) AND label) AS tp FROM r CROSS JOIN c GROUP BY 1)
SELECT cut::DOUBLE AS review_fraction, k AS review_count, p AS positive_count, tp AS captured_count, tp / k AS precision, tp / p AS recall, (tp / k) / (p / n) AS lift FROM g""",
       floats="review_fraction precision recall lift")
def topk_precision_recall_lift(spark, sf):
    return M.ranking_metrics(scores(spark, sf), [], "label", "score", "observation_id")


@query("evaluation_row", _FLAGGED + """
, c AS (SELECT count(*) FILTER (label AND flag) AS tp, count(*) FILTER (NOT label AND flag) AS fp, count(*) FILTER (label AND NOT flag) AS fn FROM f)
SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 5 * tp / (5 * tp + 4 * fn + fp) AS f2 FROM c""", floats="precision recall f2")
def evaluation_row(spark, sf):
    return M.evaluate(scores(spark, sf), [], "label", "score", "observation_id").select("precision", "recall", "f2")


_STEPS = SCORES + """
, g AS (SELECT score, count(*) AS n, count(*) FILTER (label) AS p FROM scores GROUP BY 1)
, c AS (SELECT score AS threshold, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(p) OVER () AS tp FROM g)"""


@query("roc_curve", _STEPS + " SELECT threshold, cp / tp AS true_positive_rate, (cn - cp) / (tn - tp) AS false_positive_rate FROM c", floats="threshold true_positive_rate false_positive_rate")
def roc_curve(spark, sf):
    return M.roc_curve(M.score_steps(scores(spark, sf), [], "label", "score"), [])


@query("precision_recall_curve", _STEPS + " SELECT threshold, cp / cn AS precision, cp / tp AS recall FROM c", floats="threshold precision recall")
def precision_recall_curve(spark, sf):
    return M.pr_curve(M.score_steps(scores(spark, sf), [], "label", "score"), [])


@query("lift_curve", SCORES + """
, r AS (SELECT score, label, row_number() OVER w AS rn, sum(label::INT) OVER w AS cp, count(*) OVER () AS n, sum(label::INT) OVER () AS p FROM scores WINDOW w AS (ORDER BY score DESC, observation_id))
SELECT rn AS review_rank, rn / n AS review_fraction, score AS threshold, CAST(cp AS BIGINT) AS captured_count, cp / rn AS precision, cp / p AS recall, (cp / rn) / (p / n) AS lift FROM r""",
       floats="review_fraction threshold precision recall lift")
def lift_curve(spark, sf):
    return M.lift_curve(scores(spark, sf), "label", "score", "observation_id")


@query("ecdf_score", SCORES + """
, t AS (SELECT fine_score FROM scores WHERE lang = 'en')
SELECT observation_id, (SELECT count(*) FROM t WHERE t.fine_score <= s.fine_score) / (SELECT count(*) FROM t) AS ecdf FROM scores s""", floats="ecdf")
def ecdf_score(spark, sf):
    s = scores(spark, sf)
    return M.ecdf_score(s.select("observation_id", "fine_score"), s.filter("lang = 'en'"), [], "fine_score", "ecdf").select("observation_id", "ecdf")


@query("calibrated_percentile", SCORES + """
, t AS (SELECT fine_score AS x FROM scores WHERE NOT label), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, greatest(stddev_pop(x), (max(x) - min(x)) * 0.1, 1e-8) AS tail FROM t)
, ref AS (SELECT x, (sum(count(*)) OVER (ORDER BY x) - count(*) * 0.5) / (sum(count(*)) OVER () + 1) AS y FROM t GROUP BY x)
, b AS (SELECT min(y) AS ylo, max(y) AS yhi FROM ref)
, p AS (SELECT observation_id, fine_score * 1.25 - 40 AS x FROM scores)
, l AS (SELECT p.*, r.x AS x0, r.y AS y0 FROM p ASOF LEFT JOIN ref r ON p.x >= r.x), h AS (SELECT l.*, r.x AS x1, r.y AS y1 FROM l ASOF LEFT JOIN ref r ON l.x <= r.x)
SELECT observation_id, CASE WHEN x > hi THEN 1 - (1 - yhi) / (1 + (x - hi) / tail) WHEN x < lo THEN ylo / (1 + (lo - x) / tail)
  WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS percentile FROM h CROSS JOIN e CROSS JOIN b""", floats="percentile")
def calibrated_percentile(spark, sf):
    s = scores(spark, sf)
    cal = M.fit_calibrator(s.filter("NOT label").select(F.col("fine_score").alias("x")), [], "x")
    return M.calibrate(s.select("observation_id", (F.col("fine_score") * 1.25 - 40).alias("x")), cal, [], "x", "percentile").select("observation_id", "percentile")


# Three score vectors per representative-month, in the long contract (id, model, percentile, flag).
_LONG = REP_MONTH + """
, b AS (SELECT rep_id * 1000000 + year(period) * 100 + month(period) AS observation_id, total_sales AS s, total_quantity AS q, transaction_count AS n FROM rep_month)
, u AS (SELECT observation_id, 'quantity' AS model_name, CAST(q AS DOUBLE) AS raw FROM b UNION ALL SELECT observation_id, 'returns', -s FROM b UNION ALL SELECT observation_id, 'volume', n FROM b)
, long AS (SELECT *, (rank() OVER (PARTITION BY model_name ORDER BY raw) + (count(*) OVER (PARTITION BY model_name, raw) - 1) / 2.0) / count(*) OVER (PARTITION BY model_name) AS pct,
   row_number() OVER (PARTITION BY model_name ORDER BY raw DESC, observation_id) <= ceil(count(*) OVER (PARTITION BY model_name) * 0.05 - 1e-9) AS flag FROM u)"""
MODELS = ["quantity", "returns", "volume"]


def long_scores(spark, sf):
    b = rep_month(spark, sf).withColumn("observation_id", F.col("rep_id") * 1000000 + F.year("period") * 100 + F.month("period"))
    u = R.unpivot(b.select("observation_id", F.col("total_quantity").alias("quantity"), (-F.col("total_sales")).alias("returns"), F.col("transaction_count").alias("volume")),
                  ["observation_id"], MODELS, "model_name", "raw")
    ranked = R.top_fraction(R.percent_rank_average(u, ["model_name"], "raw", "pct"), "raw", "observation_id", 0.05, "flag", ["model_name"])
    return checkpointed(ranked)  # every consumer reads the finished score table


@query("ensemble_combinations", _LONG + """
SELECT observation_id, avg(pct) AS mean_score, sum((pct >= 0.95)::INT) + avg(pct) * 0.001 AS consensus, max(pct) AS maximum,
  sum(pct * CASE model_name WHEN 'quantity' THEN 0.5 WHEN 'returns' THEN 0.3 ELSE 0.2 END) AS weighted FROM long GROUP BY 1""", floats="mean_score consensus maximum weighted")
def ensemble_combinations(spark, sf):
    long = long_scores(spark, sf)
    w = {"quantity": 0.5, "returns": 0.3, "volume": 0.2}
    parts = [M.ensemble_scores(long, ["observation_id"], "model_name", "pct", w, kind, out) for kind, out in
             (("equal_percentile", "mean_score"), ("consensus", "consensus"), ("maximum", "maximum"), ("weighted", "weighted"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "observation_id")
    return out


@query("model_queue_overlap", _LONG + """
SELECT a.model_name AS model, b.model_name AS other, count(*) FILTER (a.flag AND b.flag) / count(*) FILTER (a.flag) AS overlap FROM long a JOIN long b USING (observation_id) GROUP BY ALL""", floats="overlap")
def model_queue_overlap(spark, sf):
    return M.overlap_matrix(long_scores(spark, sf), "model_name", "flag", "observation_id", MODELS)


@query("model_rank_correlation", _LONG + """
SELECT a.model_name AS model, b.model_name AS other, corr(a.pct, b.pct) AS correlation FROM long a JOIN long b USING (observation_id) GROUP BY ALL""", floats="correlation")
def model_rank_correlation(spark, sf):
    return M.spearman_matrix(long_scores(spark, sf), "model_name", "observation_id", "raw", MODELS)


@query("score_stability", _LONG + """
SELECT corr(a.pct, b.pct) AS score_correlation, count(*) FILTER (a.flag AND b.flag) / count(*) FILTER (a.flag) AS queue_overlap
FROM long a JOIN long b USING (observation_id) WHERE a.model_name = 'quantity' AND b.model_name = 'volume'""", floats="score_correlation queue_overlap")
def score_stability(spark, sf):
    long = long_scores(spark, sf)
    wide = long.groupBy("observation_id").agg(*[F.max(F.when(F.col("model_name") == m, F.col("raw"))).alias(m) for m in MODELS])
    return M.score_stability(wide, "quantity", "volume", "observation_id")


@query("walk_forward_metrics", _LONG + """
, m AS (SELECT model_name, observation_id % 1000000 AS month, raw, observation_id, observation_id IN (SELECT observation_id FROM b WHERE n >= 12) AS y FROM long)
, r AS (SELECT *, row_number() OVER (PARTITION BY model_name, month ORDER BY raw DESC, observation_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY model_name, month) * 0.05 - 1e-9)) AS f FROM m)
SELECT model_name, month, count(*) FILTER (y AND f) AS true_positives, count(*) FILTER (y) AS positives, CASE WHEN count(*) FILTER (f) > 0 THEN count(*) FILTER (y AND f) / count(*) FILTER (f) ELSE 0 END AS precision
FROM r GROUP BY ALL""", floats="precision")
def walk_forward_metrics(spark, sf):
    long = long_scores(spark, sf).withColumn("month", F.col("observation_id") % 1000000)
    volume = long.filter("model_name = 'volume'").select("observation_id", (F.col("raw") >= 12).alias("y"))
    long = R.top_fraction(long.join(volume, "observation_id"), "raw", "observation_id", 0.05, "f", ["model_name", "month"])
    c = M.confusion_metrics(long, ["model_name", "month"], "y", "f")
    return c.select("model_name", "month", "true_positives", (F.col("true_positives") + F.col("false_negatives")).alias("positives"), "precision")


@query("weighted_model_selection", REP_MONTH + """
, m AS (SELECT team AS model, avg(total_sales) AS recall, avg(transaction_count) AS davies_bouldin_score, stddev_samp(total_quantity) AS runtime_seconds FROM rep_month GROUP BY 1)
, l AS (SELECT model, 'recall' AS metric, recall AS v, 0.5 AS w FROM m UNION ALL SELECT model, 'davies_bouldin_score', davies_bouldin_score, 0.3 FROM m UNION ALL SELECT model, 'runtime_seconds', runtime_seconds, 0.2 FROM m)
, n AS (SELECT *, CASE WHEN max(v) OVER p - min(v) OVER p < 1e-12 THEN 0.5 ELSE (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) END AS x FROM l WINDOW p AS (PARTITION BY metric))
, k AS (SELECT *, CASE metric WHEN 'recall' THEN x WHEN 'davies_bouldin_score' THEN 1 - x ELSE 1 / (1 + v) END AS y FROM n)
SELECT model, metric, v AS raw_value, y AS normalised_value, w::DOUBLE AS weight, y * w AS weighted_contribution FROM k""", floats="raw_value normalised_value weight weighted_contribution", digits=4)
def weighted_model_selection(spark, sf):
    m = rep_month(spark, sf).groupBy(F.col("team").alias("model")).agg(
        F.avg("total_sales").alias("recall"), F.avg("transaction_count").alias("davies_bouldin_score"), F.stddev_samp("total_quantity").alias("runtime_seconds"))
    return M.weighted_selection(m, "model", {"recall": 0.5, "davies_bouldin_score": 0.3, "runtime_seconds": 0.2}, ["davies_bouldin_score"], ["runtime_seconds"])


@query("group_detection", SCORES + """
, f AS (SELECT *, fine_score >= 3000 AS flag, row_number() OVER (ORDER BY fine_score DESC, observation_id) <= ceil(count(*) OVER () * 0.05) AS top, lang || '|' || source AS kinds FROM scores)
, e AS (SELECT label, flag, top, unnest(string_split(kinds, '|')) AS v FROM f WHERE label)
SELECT v AS value, count(*) AS observations, count(*) FILTER (label) AS positive_support, count(*) FILTER (label AND flag) AS captured_at_threshold, count(*) FILTER (label AND top) AS captured_at_top5pct,
  'ground_truth' AS group_kind, count(*) FILTER (label AND flag) / count(*) FILTER (label) AS recall_at_threshold FROM e GROUP BY 1 UNION ALL
SELECT lang, count(*), count(*) FILTER (label), count(*) FILTER (label AND flag), count(*) FILTER (label AND top), 'organization', CASE WHEN count(*) FILTER (label) > 0 THEN count(*) FILTER (label AND flag) / count(*) FILTER (label) END FROM f GROUP BY 1""",
       floats="recall_at_threshold")
def group_detection(spark, sf):
    f = scores(spark, sf).withColumn("flag", F.col("fine_score") >= 3000).withColumn("kinds", F.concat("lang", F.lit("|"), "source"))
    f = R.top_fraction(f, "fine_score", "observation_id", 0.05, "top")
    return M.group_detection(f, "label", "flag", "top", ["kinds"], ["lang"]).select(
        "value", "observations", "positive_support", "captured_at_threshold", "captured_at_top5pct", "group_kind", "recall_at_threshold")


@query("family_recall", _FLAGGED + """
, m(kind, family) AS (SELECT DISTINCT lang, CASE WHEN lang IN ('en', 'de') THEN 'germanic' ELSE 'romance' END FROM scores UNION ALL SELECT DISTINCT lang, 'all' FROM scores)
SELECT family, count(*) AS support, count(*) FILTER (flag) AS captured, avg(flag::INT) AS recall FROM f JOIN m ON lang = kind WHERE label GROUP BY 1""", floats="recall")
def family_recall(spark, sf):
    s = scores(spark, sf)
    f = R.top_fraction(s, "score", "observation_id", 0.05, "flag").filter("label")
    families = F.array(F.when(F.col("lang").isin("en", "de"), "germanic").otherwise("romance"), F.lit("all"))
    return M.family_recall(f.where("lang IS NOT NULL"), [], "lang", "flag", families)


@query("period_stability", REP_MONTH + """
, t AS (SELECT team, period, rep_id, CAST(total_quantity AS DOUBLE) AS raw, transaction_count / 20.0 AS score, transaction_count >= 10 AS flag, total_sales < 0 AS y FROM rep_month)
, g AS (SELECT team, period, count(*) AS observations, avg(raw) AS mean_raw_score, median(raw) AS median_raw_score, stddev_pop(raw) AS std_raw_score, avg(score) AS mean_score, quantile_cont(score, 0.95) AS p95_score,
   avg(flag::INT) AS review_rate, avg(y::INT) AS prevalence, count(*) FILTER (y AND flag) / greatest(count(*) FILTER (flag), 1) AS precision,
   CASE WHEN count(*) FILTER (y) > 0 THEN count(*) FILTER (y AND flag) / count(*) FILTER (y) END AS recall FROM t GROUP BY ALL)
, p AS (SELECT *, lag(period) OVER (PARTITION BY team ORDER BY period) AS prev FROM g)
SELECT p.* EXCLUDE (prev), CASE WHEN prev IS NOT NULL THEN (SELECT count(*) FROM t a JOIN t b ON a.rep_id = b.rep_id AND b.period = p.prev AND b.team = p.team AND b.flag WHERE a.team = p.team AND a.period = p.period AND a.flag)
   / greatest(1, (SELECT count(*) FROM t b WHERE b.team = p.team AND b.period = p.prev AND b.flag)) END AS overlap,
  mean_score - lag(mean_score) OVER (PARTITION BY team ORDER BY period) AS mean_score_change FROM p""",
       floats="mean_raw_score median_raw_score std_raw_score mean_score p95_score review_rate prevalence precision recall overlap mean_score_change")
def period_stability(spark, sf):
    t = rep_month(spark, sf).withColumns({"raw": F.col("total_quantity"), "score": F.col("transaction_count") / 20.0, "flag": F.col("transaction_count") >= 10, "y": F.col("total_sales") < 0})
    return M.period_stability(t, "team", "period", "rep_id", "raw", "score", "flag", "y")


@query("false_positive_review", REP_MONTH + """
, f AS (SELECT manager, transaction_count AS s, CAST(rep_id AS VARCHAR) || '-' || strftime(period, '%Y%m') AS id FROM rep_month WHERE transaction_count >= 10 AND total_sales >= 0)
, r AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY s DESC, id) AS rn FROM f)
SELECT manager, count(*) AS false_positives, avg(s) AS mean_score, max(s) AS max_score, median(s) AS median_score, string_agg(CASE WHEN rn <= 5 THEN id END, '|' ORDER BY rn) AS examples FROM r GROUP BY 1""",
       floats="mean_score median_score")
def false_positive_review(spark, sf):
    f = rep_month(spark, sf).withColumns({"id": F.concat(F.col("rep_id").cast("string"), F.lit("-"), F.date_format("period", "yyyyMM")),
                                          "flag": F.col("transaction_count") >= 10, "y": F.col("total_sales") < 0})
    return M.false_positive_review(f, "y", "flag", "manager", "transaction_count", "id")


@query("adjusted_rand_index", LEDGER + """
, c AS (SELECT channel, country, count(*) AS n FROM ledger GROUP BY ALL), a AS (SELECT sum(n) AS n FROM c GROUP BY channel), b AS (SELECT sum(n) AS n FROM c GROUP BY country)
, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS x, (SELECT sum(n * (n - 1) / 2.0) FROM a) AS p, (SELECT sum(n * (n - 1) / 2.0) FROM b) AS q, (SELECT sum(n) FROM c) AS t)
SELECT (x - p * q / (t * (t - 1) / 2.0)) / ((p + q) / 2.0 - p * q / (t * (t - 1) / 2.0)) AS adjusted_rand FROM s""", floats="adjusted_rand", digits=9)
def adjusted_rand_index(spark, sf):
    return M.adjusted_rand(ledger(spark, sf), "channel", "country")
