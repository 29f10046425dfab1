"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from quotalens import functions as C
from quotalens.operators import features as X, quality as Q, ranking as R
from quotalens.queries.base import CLASS_MONTH, LEDGER, REP_MONTH, class_month, ledger, read, rep_month
from quotalens.queries.registry import query


@query("safe_divisions", CLASS_MONTH + """
SELECT rep_id, product_class, period,
  CASE WHEN abs(total_sales) > 1e-12 THEN total_quantity / total_sales ELSE 0 END AS zero_default,
  total_quantity / greatest(abs(total_sales), 1) AS floored,
  CASE WHEN total_sales > 0 THEN total_quantity / total_sales END AS null_default FROM class_month""",
       floats="zero_default floored null_default", digits=9)
def safe_divisions(spark, sf):
    return class_month(spark, sf).select(
        "rep_id", "product_class", "period", C.ratio_or("total_quantity", "total_sales").alias("zero_default"),
        C.ratio_floored("total_quantity", "total_sales").alias("floored"), C.ratio_or_null("total_quantity", "total_sales").alias("null_default"))


@query("numeric_coercion", """
SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number,
  CASE WHEN isfinite(try_cast(CASE WHEN event_type = 'error' THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS DOUBLE))
    THEN try_cast(CASE WHEN event_type = 'error' THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS DOUBLE) END AS finite_value FROM events""",
       floats="k not_a_number finite_value")
def numeric_coercion(spark, sf):
    e = read(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", "Infinity").otherwise(F.col("value").cast("string"))
    return e.select("event_id", C.number(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), C.number("event_type").alias("not_a_number"),
                    C.number(text).alias("finite_value"))


@query("month_text_to_date", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS from_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS from_abbreviation,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS from_number, CAST(NULL AS DATE) AS from_bad_text FROM orders""")
def month_text_to_date(spark, sf):
    o = read(spark, sf, "orders")
    y = F.year("o_orderdate").cast("string")
    return o.select(
        "o_orderkey", C.month_from_parts(y, F.concat(F.lit(" "), F.date_format("o_orderdate", "MMMM"))).alias("from_name"),
        C.month_from_parts(y, F.upper(F.date_format("o_orderdate", "MMM"))).alias("from_abbreviation"),
        C.month_from_parts(y, F.month("o_orderdate").cast("string")).alias("from_number"), C.month_from_parts(y, "o_orderpriority").alias("from_bad_text"))


@query("truncate_to_month", """
SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month, year(ts) * 12 + month(ts) AS month_number FROM events""")
def truncate_to_month(spark, sf):
    return read(spark, sf, "events").select("event_id", C.month_start("ts").alias("month"), C.month_index("ts").cast("long").alias("month_number"))


@query("invalid_row_filter", """
SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def invalid_row_filter(spark, sf):
    joined = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return C.complete_rows(joined, ["lang"], ["quality", "toxic"]).select("doc_id", "lang", "quality")


@query("text_cleaning", """
SELECT c_custkey, coalesce(trim(CASE WHEN c_mktsegment <> 'MACHINERY' THEN '  ' || c_mktsegment || ' ' END), 'Unknown') AS segment FROM customer""")
def text_cleaning(spark, sf):
    raw = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return read(spark, sf, "customer").select("c_custkey", C.clean_text(raw).alias("segment"))


@query("lenient_boolean", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS yes_no, l_linestatus = 'F' AS one_zero, NOT (l_returnflag = 'N' AND l_linestatus = 'O') AS unknown_word,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false ELSE l_linenumber <> 1 END AS word_or_number FROM lineitem""")
def lenient_boolean(spark, sf):
    li = read(spark, sf, "lineitem")
    word = F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "A", "cancelled").otherwise("N")
    digit = F.when(F.col("l_linestatus") == "F", "1").otherwise("0.0")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.lenient_bool(word).alias("yes_no"),
                     C.lenient_bool(digit).alias("one_zero"), C.lenient_bool(F.concat("l_returnflag", "l_linestatus"), True).alias("unknown_word"),
                     C.numeric_bool(F.when(F.col("l_returnflag") == "R", " Yes").when(F.col("l_returnflag") == "A", "n").otherwise(((F.col("l_linenumber") - 1) / 2).cast("string"))).alias("word_or_number"))


@query("strict_boolean", """
SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels""")
def strict_boolean(spark, sf):
    return read(spark, sf, "labels").select("doc_id", C.strict_bool("quality").alias("quality"), C.strict_bool(F.col("toxic").cast("double")).alias("toxic"))


@query("infinities_and_clip", CLASS_MONTH + """
, r AS (SELECT rep_id, product_class, period, lag(total_sales) OVER (PARTITION BY rep_id, product_class ORDER BY period) AS p, total_sales AS s FROM class_month)
SELECT rep_id, product_class, period, greatest(-10, least(10, coalesce(CASE WHEN p <> 0 THEN s / p END, 0))) AS clipped FROM r""", floats="clipped")
def infinities_and_clip(spark, sf):
    from pyspark.sql import Window as W
    lag = F.lag("total_sales").over(W.partitionBy("rep_id", "product_class").orderBy("period"))
    ratio = F.when(lag == 0, float("inf")).otherwise(F.try_divide(F.col("total_sales"), lag))
    return class_month(spark, sf).select("rep_id", "product_class", "period", C.finite_or(ratio, 0.0, -10, 10).alias("clipped"))


@query("cold_start_indicator", REP_MONTH + """
SELECT rep_id, period, CASE WHEN avg(total_sales) OVER w IS NULL THEN 1 ELSE 0 END AS missing FROM rep_month
WINDOW w AS (PARTITION BY rep_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def cold_start_indicator(spark, sf):
    from quotalens.operators.history import row_prior
    df = rep_month(spark, sf).withColumn("m", row_prior("total_sales", 3, "mean", ["rep_id"], "period"))
    return df.select("rep_id", "period", C.missing_flag("m").alias("missing"))


@query("configured_formulas", REP_MONTH + """
, a AS (SELECT rep_id, period, greatest(100000.0 * (1 + 0.03), 1) AS target, total_sales FROM rep_month)
, b AS (SELECT *, 100 * greatest(total_sales, 0) / target AS attainment FROM a)
SELECT rep_id, period, target::DOUBLE AS target, attainment, 250.0 + 750.0 * least(attainment / 100, 2.0) + 500.0 * greatest(attainment / 100 - 1.0, 0) AS payout FROM b""",
       floats="target attainment payout")
def configured_formulas(spark, sf):
    out = C.with_formulas(
        rep_month(spark, sf),
        {"target": "greatest(base_target * (1 + growth), 1)", "attainment": "100 * greatest(total_sales, 0) / target",
         "payout": "base + part * least(attainment / 100, cap) + extra * greatest(attainment / 100 - threshold, 0)"},
        {"base_target": 100000.0, "growth": 0.03, "base": 250.0, "part": 750.0, "cap": 2.0, "extra": 500.0, "threshold": 1.0})
    return out.select("rep_id", "period", "target", "attainment", "payout")


@query("ordered_condition_bands", REP_MONTH + """
SELECT rep_id, period, CASE WHEN transaction_count >= 12 THEN 'critical' WHEN transaction_count >= 10 THEN 'high'
  WHEN transaction_count >= 8 THEN 'medium' ELSE 'low' END AS band FROM rep_month""")
def ordered_condition_bands(spark, sf):
    n = F.col("transaction_count")
    return rep_month(spark, sf).select("rep_id", "period", C.first_match([(n >= 12, "critical"), (n >= 10, "high"), (n >= 8, "medium")], "low").alias("band"))


@query("right_closed_bins", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS band FROM part""")
def right_closed_bins(spark, sf):
    return read(spark, sf, "part").select("p_partkey", C.right_closed_band("p_size", [10, 30], ["small", "medium", "large"]).alias("band"))


@query("quantile_bands_average_ties", """
WITH r AS (SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER () AS pct FROM part)
SELECT p_partkey, CASE WHEN pct >= 2 / 3.0 THEN 'high' WHEN pct >= 1 / 3.0 THEN 'medium' ELSE 'low' END AS band FROM r""")
def quantile_bands_average_ties(spark, sf):
    df = R.percent_rank_average(read(spark, sf, "part").select("p_partkey", "p_size"), [], "p_size", "pct")
    return df.select("p_partkey", C.first_match([(F.col("pct") >= 2 / 3.0, "high"), (F.col("pct") >= 1 / 3.0, "medium")], "low").alias("band"))


@query("payout_multiplier_by_attainment", REP_MONTH + """
, a AS (SELECT rep_id, period, transaction_count / 8.0 AS t FROM rep_month)
SELECT rep_id, period, CASE WHEN t < 0.70 THEN 0.20 * t / 0.70 WHEN t < 0.90 THEN 0.60 + 1.0 * (t - 0.70) WHEN t < 1.00 THEN 0.80 + 2.0 * (t - 0.90)
  WHEN t < 1.20 THEN 1.00 + 1.5 * (t - 1.00) ELSE least(2.0, 1.30 + 1.2 * (t - 1.20)) END AS multiplier FROM a""", floats="multiplier")
def payout_multiplier_by_attainment(spark, sf):
    return rep_month(spark, sf).select("rep_id", "period", C.payout_multiplier(F.col("transaction_count") / 8.0).alias("multiplier"))


@query("signed_log_compression", LEDGER + """
SELECT order_id, line_number, product_id, rep_id, sign(sales) * ln(1 + abs(sales)) AS compressed FROM ledger""", floats="compressed")
def signed_log_compression(spark, sf):
    return ledger(spark, sf).select("order_id", "line_number", "product_id", "rep_id", C.signed_log("sales").alias("compressed"))


@query("geographic_spread_and_distance", LEDGER + """
, s AS (SELECT rep_id, period, stddev_samp(quantity) AS a, stddev_samp(discount_pct) AS b, min(quantity) AS lat0, max(quantity) AS lat1, min(discount_pct) AS lon0,
   max(discount_pct) AS lon1 FROM ledger GROUP BY ALL)
SELECT rep_id, period, sqrt(coalesce(a, 0) * coalesce(a, 0) + coalesce(b, 0) * coalesce(b, 0)) AS spread,
  sqrt(power((lat0 - lat1) * 111.0, 2) + power((lon0 - lon1) * 111.0 * cos(radians((lat0 + lat1) / 2.0)), 2)) AS km FROM s""", floats="spread km")
def geographic_spread_and_distance(spark, sf):
    s = ledger(spark, sf).groupBy("rep_id", "period").agg(
        F.stddev_samp("quantity").alias("a"), F.stddev_samp("discount_pct").alias("b"), F.min("quantity").alias("lat0"), F.max("quantity").alias("lat1"),
        F.min("discount_pct").alias("lon0"), F.max("discount_pct").alias("lon1"))
    return s.select("rep_id", "period", C.spread("a", "b").alias("spread"), C.planar_km("lat0", "lon0", "lat1", "lon1").alias("km"))


@query("stable_surrogate_ids", """
SELECT c_custkey, 'CUST_' || substr(sha256(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment))), 1, 12) AS customer_id,
  'SRC_' || substr(sha256(c_name || '|' || c_custkey), 1, 16) AS source_row_id FROM customer""")
def stable_surrogate_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", C.stable_id("CUST", "c_name", "c_mktsegment").alias("customer_id"),
                                              C.exact_id("SRC", "c_name", "c_custkey").alias("source_row_id"))


@query("stable_hash_numbers", """
WITH h AS (SELECT c_custkey, CAST('0x' || substr(sha256('42|' || c_name), 1, 15) AS BIGINT) AS n,
  CAST('0x' || substr(sha256('42|leave_days|' || c_name), 1, 15) AS BIGINT) AS u FROM customer)
SELECT c_custkey, n % 27 AS day_slot, 2.0 + 5.0 * (CAST(u AS DOUBLE) / (CAST(16 AS DOUBLE) ** 15 - 1)) AS seeded_hours FROM h""", floats="seeded_hours", digits=9)
def stable_hash_numbers(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", C.stable_integer("c_name", 42, 27).alias("day_slot"),
                                              C.stable_uniform("c_name", 42, "leave_days", 2.0, 7.0).alias("seeded_hours"))


@query("value_or_seeded_fallback", """
WITH h AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal,
  CAST('0x' || substr(sha256('42|bal|' || c_name), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u FROM customer)
SELECT c_custkey, coalesce(bal, floor(0.0 + 3.0 * u + 1e-12)) AS bal FROM h""", floats="bal")
def value_or_seeded_fallback(spark, sf):
    df = read(spark, sf, "customer").withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return df.select("c_custkey", C.value_or_seeded(df, "bal", "c_name", 42, 0.0, 3.0, integers=True).alias("bal"))


@query("tenure_in_months", """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1)
SELECT o_orderkey, greatest(1, (year(o_orderdate) - year(first)) * 12 + month(o_orderdate) - month(first)) AS tenure FROM orders JOIN f USING (o_custkey)""")
def tenure_in_months(spark, sf):
    o = read(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return o.join(first, "o_custkey").select("o_orderkey", C.tenure_months("o_orderdate", "first").cast("long").alias("tenure"))


@query("month_end_payout_date", """
SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(last_day(CAST(o_orderdate AS DATE)) + 15 AS DATE) AS payout FROM orders""")
def month_end_payout_date(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.last_day("o_orderdate").alias("month_end"), C.payout_date("o_orderdate", 15).alias("payout"))


@query("visit_cadence", """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Weekly' WHEN 'MACHINERY' THEN '4' WHEN 'HOUSEHOLD' THEN 'quarterly' WHEN 'FURNITURE' THEN 'odd' END AS cadence,
  CASE WHEN c_acctbal > 5000 THEN 'High' WHEN c_acctbal > 0 THEN 'medium' ELSE 'other' END AS priority FROM customer)
SELECT c_custkey, CASE cadence WHEN 'Weekly' THEN 4.0::DOUBLE WHEN '4' THEN 2.5 WHEN 'quarterly' THEN 1 / 3.0::DOUBLE
  ELSE CASE priority WHEN 'High' THEN 2.0 ELSE 1.0 END END AS visits FROM c""", floats="visits")
def visit_cadence(spark, sf):
    m, b = F.col("c_mktsegment"), F.col("c_acctbal")
    cadence = F.when(m == "BUILDING", "Weekly").when(m == "MACHINERY", "4").when(m == "HOUSEHOLD", "quarterly").when(m == "FURNITURE", "odd")
    priority = F.when(b > 5000, "High").when(b > 0, "medium").otherwise("other")
    return read(spark, sf, "customer").select("c_custkey", C.visits_per_month(cadence, priority, 1.6).alias("visits"))


@query("share_tokens_to_rows", LEDGER + """
, n AS (SELECT rep_id, period, team AS t, city, count(*) AS n FROM ledger GROUP BY ALL)
SELECT rep_id, period, city AS territory, n / 100.0 AS share FROM n""", floats="share")
def share_tokens_to_rows(spark, sf):
    n = ledger(spark, sf).groupBy("rep_id", "period", "city").agg(F.count(F.lit(1)).alias("n"))
    token = F.concat(F.col("city"), F.lit(":"), F.format_string("%.8f", F.col("n") / 100.0))
    packed = n.groupBy("rep_id", "period").agg(F.concat_ws("|", F.array_sort(F.collect_list(token))).alias("allocation"))
    return packed.select("rep_id", "period", F.inline(C.share_tokens("allocation"))).withColumnRenamed("key", "territory")


@query("multi_label_membership", LEDGER + """
, l AS (SELECT DISTINCT rep_id, period, product_class FROM ledger)
SELECT rep_id, period, count(*) AS classes, max((product_class = 'PROMO')::INT) = 1 AS has_promo FROM l GROUP BY ALL""")
def multi_label_membership(spark, sf):
    from quotalens.operators.aggregates import token_join
    df = ledger(spark, sf).groupBy("rep_id", "period").agg(token_join("product_class").alias("labels"))
    return df.select("rep_id", "period", F.size(F.split("labels", r"\|")).cast("long").alias("classes"), C.has_label("labels", "PROMO").alias("has_promo"))


@query("feature_labels_and_actions", """
WITH f(feature) AS (SELECT DISTINCT lower(c_mktsegment) || x FROM customer, (VALUES ('_peer_z'), ('_discount_rate'), ('_visit_count'), ('_incentive'), ('_workload'), ('')) s(x))
SELECT feature, upper(substr(replace(feature, '_', ' '), 1, 1)) || lower(substr(replace(feature, '_', ' '), 2)) AS label, 'PCA_RECONSTRUCTION_' || upper(feature) AS code,
  CASE WHEN feature LIKE '%incentive%' THEN 'payout' WHEN feature LIKE '%discount%' THEN 'orders' WHEN feature LIKE '%visit%' THEN 'visits'
    WHEN feature LIKE '%workload%' THEN 'capacity' ELSE 'general' END AS action FROM f""")
def feature_labels_and_actions(spark, sf):
    from quotalens.functions import text as T
    seg = read(spark, sf, "customer").select(F.lower("c_mktsegment").alias("s")).distinct()
    parts = F.array(*[F.lit(x) for x in ("_peer_z", "_discount_rate", "_visit_count", "_incentive", "_workload", "")])
    f = seg.select("s", F.explode(parts).alias("x")).select(F.concat("s", "x").alias("feature"))
    return f.select("feature", T.plain_label("feature").alias("label"), T.reason_code("feature").alias("code"), T.action_topic("feature").alias("action"))


@query("integer_inference", LEDGER + """
, c AS (SELECT rep_id, period, count(DISTINCT customer_id) AS n, count(*) AS k, sum(return_flag::INT) AS r FROM ledger GROUP BY ALL)
SELECT rep_id, period, CAST(n AS BIGINT) AS customers, CASE WHEN r * n % k = 0 THEN CAST(r * n // k AS BIGINT) END AS maybe_whole FROM c""")
def integer_inference(spark, sf):
    c = ledger(spark, sf).groupBy("rep_id", "period").agg(
        F.count_distinct("customer_id").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("return_flag").cast("int")).alias("r"))
    return c.select("rep_id", "period", C.whole_count(F.col("n").cast("double")).alias("customers"), C.whole_count(F.col("r") / F.col("k") * F.col("n")).alias("maybe_whole"))


@query("label_safe_projection", """
SELECT doc_id, n_chars, source FROM documents JOIN labels USING (doc_id)""")
def label_safe_projection(spark, sf):
    df = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        "doc_id", "n_chars", "source", F.col("quality").alias("ground_truth_label"), F.col("toxic").alias("severity_code"))
    return Q.without_labels(df)


@query("category_filters", """
SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def category_filters(spark, sf):
    from quotalens.operators.review import category_filter
    df = read(spark, sf, "customer")
    return category_filter(df, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": None}).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("linked_filter", LEDGER + """
, a AS (SELECT DISTINCT rep_id, period, city FROM ledger WHERE country = 'ASIA')
SELECT r.rep_id, r.period, count(*) AS lines FROM ledger r SEMI JOIN a ON a.rep_id = r.rep_id AND a.period = r.period GROUP BY ALL""")
def linked_filter(spark, sf):
    from quotalens.operators.review import linked_filter as linked
    led = ledger(spark, sf)
    reps = led.groupBy("rep_id", "period").agg(F.count(F.lit(1)).alias("lines"))
    allocation = led.select("rep_id", "period", "city", "country").distinct()
    return linked(reps, allocation, {"country": ["ASIA"]}, ["rep_id", "period"])[0]


@query("chronological_split", REP_MONTH + """
SELECT rep_id, period, CASE WHEN period <= DATE '1999-12-01' THEN 'train' WHEN period <= DATE '2000-12-01' THEN 'validation' ELSE 'test' END AS split FROM rep_month""")
def chronological_split(spark, sf):
    return rep_month(spark, sf).select("rep_id", "period", C.split_label("period", "1999-12-01", "2000-12-01").alias("split"))


@query("feature_allowlist", """
SELECT unnest(['c_acctbal']) AS feature, CAST(count(*) AS BIGINT) AS rows FROM customer""")
def feature_allowlist(spark, sf):
    df = read(spark, sf, "customer").withColumn("severity", F.lit(1)).withColumn("injection_id", F.lit(2))
    names = X.feature_allowlist(df, ["c_custkey", "c_nationkey"])
    return df.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


@query("usable_features", """
SELECT unnest(['l_quantity', 'l_discount', 'constant_kept']) AS feature, CAST(count(*) AS BIGINT) AS rows FROM lineitem""")
def usable_features(spark, sf):
    df = read(spark, sf, "lineitem").select("l_quantity", "l_discount").withColumn("constant_kept", F.lit(0.0)).withColumn("constant_dropped", F.lit(0.0))
    names = X.usable_features(df, df.columns, keep=["constant_kept"])
    return df.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


@query("territory_fallback", LEDGER + """
, n AS (SELECT rep_id, period, city, count(*) AS n FROM ledger WHERE sales > 0 GROUP BY ALL)
, d AS (SELECT rep_id, period, city FROM n QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY n DESC, city) = 1)
, a AS (SELECT DISTINCT rep_id, period, manager FROM ledger)
SELECT rep_id, period, coalesce(city, manager) AS territory FROM a LEFT JOIN d USING (rep_id, period)""")
def territory_fallback(spark, sf):
    from quotalens.operators.shares import dominant_member
    led = ledger(spark, sf)
    active = led.select("rep_id", "period", "manager").distinct()
    dynamic = dominant_member(led.filter("sales > 0"), ["rep_id", "period"], "city", "city")
    return active.join(dynamic, ["rep_id", "period"], "left").select("rep_id", "period", F.coalesce("city", "manager").alias("territory"))


@query("key_inference", """
SELECT 'rep_id+period' AS keys, CAST(count(*) AS BIGINT) AS rows FROM lineitem""")
def key_inference(spark, sf):
    from quotalens.operators.review import infer_keys
    led = ledger(spark, sf)
    clean = rep_month(spark, sf)
    keys = infer_keys(clean, clean, clean.select("rep_id", "period"))
    return led.agg(F.lit("+".join(keys)).alias("keys"), F.count(F.lit(1)).alias("rows"))
