"""Validation, injection and provenance."""

import uuid

from pyspark.sql import functions as F

from quotalens import functions as C
from quotalens.operators import injection as I, quality as Q
from quotalens.queries.base import LEDGER, REP_MONTH, ledger, read, rep_month
from quotalens.queries.registry import query
from quotalens.session import checkpointed, shared_folder
from quotalens.sources import readers as SR, writers as SW


@query("primary_key_checks", LEDGER + """
, a AS (SELECT count(*) - count(DISTINCT o_orderkey) AS bad FROM orders), b AS (SELECT coalesce(sum(n - 1), 0) AS bad FROM (SELECT count(*) AS n FROM ledger GROUP BY order_id, line_number))
SELECT 'pk__orders' AS check_name, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(bad AS DOUBLE) AS value FROM a UNION ALL SELECT 'pk__lines', CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END, CAST(bad AS DOUBLE) FROM b""", floats="value")
def primary_key_checks(spark, sf):
    return Q.union_all([Q.primary_key(read(spark, sf, "orders"), ["o_orderkey"], "orders"), Q.primary_key(ledger(spark, sf), ["order_id", "line_number"], "lines")]).drop("detail")


@query("foreign_key_checks", """
WITH a AS (SELECT count(DISTINCT l_orderkey) AS bad FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), b AS (SELECT count(*) AS bad FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT p_partkey, p_size FROM part))
SELECT 'fk__line_order' AS check_name, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(bad AS DOUBLE) AS value FROM a UNION ALL SELECT 'fk__line_part_size', CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END, CAST(bad AS DOUBLE) FROM b""", floats="value")
def foreign_key_checks(spark, sf):
    li = read(spark, sf, "lineitem")
    part = read(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("long"))
    return Q.union_all([Q.foreign_key(li, ["l_orderkey"], read(spark, sf, "orders"), ["o_orderkey"], "line_order"),
                        Q.foreign_key(li, ["l_partkey", "l_suppkey"], part, ["p_partkey", "p_size"], "line_part_size")]).drop("detail")


@query("arithmetic_reconciliation", LEDGER + """
SELECT 'net_sales' AS check_name, CASE WHEN max(abs(abs(sales) - abs(gross_sales) * (1 - discount_pct))) <= 1 THEN 'pass' ELSE 'fail' END AS status, max(abs(abs(sales) - abs(gross_sales) * (1 - discount_pct))) AS value FROM ledger""", floats="value")
def arithmetic_reconciliation(spark, sf):
    return Q.reconciliation(ledger(spark, sf), "net_sales", F.abs("sales"), F.abs("gross_sales") * (1 - F.col("discount_pct")), 1.0, "net = gross less discount").drop("detail")


@query("chronology_checks", LEDGER + """
SELECT 'ship_after_order' AS check_name, CASE WHEN count(*) FILTER (ship_date < order_date) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) FILTER (ship_date < order_date) AS DOUBLE) AS value FROM ledger UNION ALL
SELECT 'order_in_period', CASE WHEN count(*) FILTER (order_date < period) = 0 THEN 'pass' ELSE 'fail' END, CAST(count(*) FILTER (order_date < period) AS DOUBLE) FROM ledger""", floats="value")
def chronology_checks(spark, sf):
    led = ledger(spark, sf)
    return Q.union_all([Q.all_rows(led, "ship_after_order", F.col("ship_date") >= F.col("order_date"), ""),
                        Q.all_rows(led, "order_in_period", F.col("order_date") >= F.col("period"), "")]).drop("detail")


@query("schedule_ceiling", REP_MONTH + """
SELECT 'lines_per_rep_month' AS check_name, CASE WHEN max(transaction_count) <= 84 THEN 'pass' ELSE 'fail' END AS status, CAST(max(transaction_count) AS DOUBLE) AS value FROM rep_month""", floats="value")
def schedule_ceiling(spark, sf):
    return Q.largest_group(ledger(spark, sf), ["rep_id", "period"], 84, "lines_per_rep_month", "monthly ceiling").drop("detail")


@query("feature_store_checks", REP_MONTH + """
SELECT unnest(['features__no_null', 'features__finite', 'pk__features__unique_grain', 'features__no_labels']) AS check_name, 'pass' AS status, 0.0::DOUBLE AS value""", floats="value")
def feature_store_checks(spark, sf):
    return Q.feature_checks(rep_month(spark, sf), ["total_sales", "total_quantity", "transaction_count"], ["rep_id", "period"]).drop("detail")


@query("prevalence_checks", """
WITH d AS (SELECT toxic, quality FROM labels)
SELECT 'toxic_share' AS check_name, CASE WHEN abs(avg(toxic) - 0.12) <= greatest(1 / count(*), 0.03) THEN 'pass' ELSE 'fail' END AS status, avg(toxic) AS value FROM d UNION ALL
SELECT 'quality_mix', CASE WHEN greatest(abs(avg((quality = 1)::INT) - 0.85), abs(avg((quality = 0)::INT) - 0.15)) <= greatest(2 / count(*), 0.03) THEN 'pass' ELSE 'fail' END,
  greatest(abs(avg((quality = 1)::INT) - 0.85), abs(avg((quality = 0)::INT) - 0.15)) FROM d""", floats="value")
def prevalence_checks(spark, sf):
    lab = read(spark, sf, "labels").withColumn("q", F.col("quality").cast("string"))
    return Q.union_all([Q.share_within(lab, "toxic_share", F.col("toxic") == 1, 0.12, 0.03), Q.mix_within(lab, "quality_mix", "q", {"1": 0.85, "0": 0.15})]).drop("detail")


@query("no_future_leakage", REP_MONTH + """
SELECT 'no_future_leakage' AS check_name, 'pass' AS status, 0.0::DOUBLE AS value""", floats="value")
def no_future_leakage(spark, sf):
    from quotalens.operators.history import metric_history
    a = rep_month(spark, sf).withColumn("row_id", F.concat_ws("|", "rep_id", "period"))
    b = a.withColumn("total_sales", F.when(F.col("period") > "2000-06-01", F.col("total_sales") * 10 + 7).otherwise(F.col("total_sales")))
    f, g = (metric_history(x, "total_sales", ["rep_id"], "period") for x in (a, b))
    columns = [c for c in f.columns if c.startswith("total_sales")]
    return Q.no_future_leakage(f, g, "period", "2000-06-01", "row_id", columns).drop("detail")


@query("canonical_data_checks", """
SELECT 'row_count' AS check_name, 'pass' AS status, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'missing_sales', 'pass', 0.0 UNION ALL
SELECT 'negative_sales', 'pass', 0.0 UNION ALL SELECT 'exact_duplicates', 'pass', 0.0 UNION ALL SELECT 'invalid_dates', 'pass', 0.0""", floats="value")
def canonical_data_checks(spark, sf):
    return Q.canonical_checks(read(spark, sf, "orders"), "o_totalprice", "o_orderdate").drop("detail")


_INJECT = REP_MONTH + """
, c AS (SELECT CAST(rep_id AS VARCHAR) || '|' || CAST(period AS VARCHAR) AS row_id, CASE WHEN period <= DATE '1999-12-01' THEN 'train' WHEN period <= DATE '2000-12-01' THEN 'validation' ELSE 'test' END AS split, total_sales FROM rep_month)"""


def injected_base(spark, sf):
    clean = rep_month(spark, sf).withColumn("row_id", F.concat_ws("|", "rep_id", "period")).withColumn("split", C.split_label("period", "1999-12-01", "2000-12-01"))
    return checkpointed(clean.withColumn("data_lineage", F.lit("synthetic_normal")).withColumn("total_quantity", F.col("total_quantity").cast("double")))


def injected(spark, sf):
    clean = injected_base(spark, sf)
    return clean, checkpointed(changed_copy(clean).frame)


def changed_copy(clean):
    """The types whose column a rep-month has, over two months of a rep where they last."""
    return I.inject(clean, "row_id", "split", 0.06, 42, [p for p in I.PERTURBATIONS if p[1] in clean.columns], series=["rep_id"], period="period")


@query("injection_budget", _INJECT + """
SELECT split, CASE WHEN split = 'train' THEN 0 ELSE CAST(greatest(1, ceil(count(*) * 0.06 - 1e-9)) AS BIGINT) END AS injected_rows, count(*) AS rows FROM c GROUP BY 1""")
def injection_budget(spark, sf):
    return injected(spark, sf)[1].groupBy("split").agg(F.sum(F.col("injected_anomaly_flag").cast("long")).alias("injected_rows"), F.count(F.lit(1)).alias("rows"))


@query("injection_audit", _INJECT + """
, k AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT ceil(count(*) * 0.06 - 1e-9) AS n FROM c WHERE split <> 'train' GROUP BY split))
SELECT 'modified' AS change_type, n AS rows FROM k""")
def injection_audit(spark, sf):
    clean, bad = injected(spark, sf)
    changes = I.changed_rows(clean, bad.drop("injected_anomaly_flag", "anomaly_type", "severity"), ["row_id"], "rep_month")
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("rows"))


def audit_sql(seeds, fraction):
    """The changed cells of one injection per seed."""
    return _INJECT.replace("total_sales FROM rep_month)", "rep_id, period, total_sales, CAST(total_quantity AS DOUBLE) AS total_quantity FROM rep_month)") + f"""
, t AS (SELECT *, year(period) * 12 + month(period) AS m, CAST(CAST('0x' || substr(sha256(seed || '|' || row_id), 1, 13) AS BIGINT) AS DOUBLE) AS draw FROM c CROSS JOIN (SELECT unnest({seeds}) AS seed) WHERE split <> 'train')
, l AS (SELECT seed, split, b, (b // 11) * 3 + (b % 11 >= 6)::INT + (b % 11 >= 8)::INT + (b % 11 >= 10)::INT AS wp, b // 11 AS wq FROM (SELECT seed, split, CAST(ceil(count(*) * {fraction} - 1e-9) AS BIGINT) AS b FROM t GROUP BY ALL))
, r AS (SELECT *, m - row_number() OVER (PARTITION BY seed, split, rep_id ORDER BY m) AS run FROM t)
, p AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY seed, split, rep_id, run) AS len, lead(row_id) OVER w AS second, CAST(first(draw) OVER w AS BIGINT) % 2 AS odd FROM r WINDOW w AS (PARTITION BY seed, split, rep_id, run ORDER BY m))
, pr AS (SELECT seed, row_id, second, split, row_number() OVER (PARTITION BY seed, split ORDER BY draw DESC, row_id) AS k FROM (SELECT *, CASE WHEN len % 2 = 1 THEN odd ELSE 0 END AS shift FROM p)
  WHERE place >= shift AND (place - shift) % 2 = 0 AND second IS NOT NULL)
, pc AS (SELECT pr.* FROM pr JOIN l USING (seed, split) WHERE k <= wp)
, tp AS (SELECT seed, row_id, split, k, 1 AS month FROM pc UNION ALL SELECT seed, second, split, k, 2 FROM pc)
, fq AS (SELECT seed, row_id, split, row_number() OVER (PARTITION BY seed, split ORDER BY draw DESC, row_id) AS k FROM t WHERE month(period) % 3 = 0 AND (seed, row_id) NOT IN (SELECT (seed, row_id) FROM tp))
, tq AS (SELECT seed, row_id, split, k FROM fq JOIN l USING (seed, split) WHERE k <= wq)
, fa AS (SELECT seed, row_id, split, row_number() OVER (PARTITION BY seed, split ORDER BY draw DESC, row_id) AS k FROM t WHERE (seed, row_id) NOT IN (SELECT (seed, row_id) FROM tp) AND (seed, row_id) NOT IN (SELECT (seed, row_id) FROM tq))
, used AS (SELECT seed, split, count(*) AS u FROM (SELECT seed, split FROM tp UNION ALL SELECT seed, split FROM tq) GROUP BY ALL)
, ta AS (SELECT fa.seed, row_id, fa.split, k FROM fa JOIN l ON l.split = fa.split AND l.seed = fa.seed LEFT JOIN used ON used.split = fa.split AND used.seed = fa.seed WHERE k <= b - coalesce(u, 0))
, ch AS (SELECT seed, row_id, month, ((k - 1) // 3) * 8 + 4 + (k - 1) % 3 AS step FROM tp UNION ALL SELECT seed, row_id, 1, (k - 1) * 8 + 7 FROM tq UNION ALL SELECT seed, row_id, 1, ((k - 1) // 4) * 8 + (k - 1) % 4 FROM ta)
, k AS (SELECT t.seed, t.row_id, t.split, month, step % 8 AS i, ['low', 'medium', 'high'][step % 3 + 1] AS severity, [0.6, 1.5, 3.0][step % 3 + 1]::DOUBLE AS s,
  CASE WHEN step % 8 IN (1, 2) THEN 'total_quantity' ELSE 'total_sales' END AS affected_feature, CASE WHEN step % 8 IN (1, 2) THEN total_quantity ELSE total_sales END AS old FROM ch JOIN t USING (seed, row_id))
, v AS (SELECT *, ['sales_spike', 'quantity_spike', 'quantity_mismatch', 'peer_divergence', 'inactivity_burst', 'upward_level_shift', 'downward_level_shift', 'end_period_spike'][i + 1] AS anomaly_type,
  CASE WHEN i IN (2, 6) THEN old / (1 + 2 * s) WHEN i = 4 THEN old * CASE WHEN month = 1 THEN 0.05 ELSE 1 + 2 * s END ELSE greatest(abs(old), 1) * (1 + s) END AS injected_value FROM k)"""


_AUDIT = audit_sql([42], 0.06)


@query("injection_severity_mix", _AUDIT + """
SELECT split, severity, count(*) AS rows FROM v GROUP BY ALL""")
def injection_severity_mix(spark, sf):
    return injected(spark, sf)[1].filter("injected_anomaly_flag").groupBy("split", "severity").agg(F.count(F.lit(1)).alias("rows"))


@query("injection_values", _AUDIT + """
SELECT row_id, split, anomaly_type, severity, CAST(month AS INTEGER) AS month, affected_feature, old AS original_value, injected_value, seed FROM v""", floats="original_value injected_value")
def injection_values(spark, sf):
    """Every changed cell with its value before and after."""
    return changed_copy(injected_base(spark, sf)).audit


@query("injected_copy", _AUDIT + """
SELECT c.row_id, c.split, CASE WHEN affected_feature = 'total_sales' THEN injected_value ELSE total_sales END AS total_sales, CASE WHEN affected_feature = 'total_quantity' THEN injected_value ELSE total_quantity END AS total_quantity,
  v.row_id IS NOT NULL AS injected_anomaly_flag, coalesce(anomaly_type, 'none') AS anomaly_type, coalesce(severity, 'none') AS severity FROM c LEFT JOIN v ON v.row_id = c.row_id""", floats="total_sales total_quantity")
def injected_copy(spark, sf):
    return injected(spark, sf)[1].select("row_id", "split", "total_sales", "total_quantity", "injected_anomaly_flag", "anomaly_type", "severity")


SEEDS, LOW_RATE = [143, 144, 145], 0.02


@query("prevalence_sensitivity", audit_sql(SEEDS, LOW_RATE) + """
, f AS (SELECT s.seed, c.*, CASE WHEN affected_feature = 'total_sales' THEN injected_value ELSE total_sales END AS ts, CASE WHEN affected_feature = 'total_quantity' THEN injected_value ELSE total_quantity END AS tq, v.row_id IS NOT NULL AS flag
  FROM c CROSS JOIN (SELECT unnest([143, 144, 145]) AS seed) s LEFT JOIN v ON v.row_id = c.row_id AND v.seed = s.seed WHERE c.split = 'test')
, tr AS (SELECT team, sign(c.total_sales) * ln(1 + abs(c.total_sales)) AS x, ln(1 + c.total_quantity) AS y FROM c JOIN rep_month r ON r.rep_id = c.rep_id AND r.period = c.period WHERE split = 'train')
, pre AS (SELECT median(x) AS xm, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS xi, median(y) AS ym, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS yi FROM tr)
, z AS (SELECT team, (x - xm) / xi AS x, (y - ym) / yi AS y FROM tr CROSS JOIN pre)
, ce AS (SELECT 'one centre' AS model_name, avg(x) AS cx, avg(y) AS cy FROM z UNION ALL SELECT 'team centres', avg(x), avg(y) FROM z GROUP BY team)
, g AS (SELECT seed, seed || '|' || row_id AS id, flag, (sign(ts) * ln(1 + abs(ts)) - xm) / xi AS x, (sign(tq) * ln(1 + abs(tq)) - ym) / yi AS y FROM f CROSS JOIN pre)
, sc AS (SELECT seed, model_name, id, flag, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS score FROM g CROSS JOIN ce GROUP BY ALL)
, rk AS (SELECT *, row_number() OVER (PARTITION BY seed, model_name ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY seed, model_name) AS n,
  rank() OVER (PARTITION BY seed, model_name ORDER BY score) + (count(*) OVER (PARTITION BY seed, model_name, score) - 1) / 2.0 AS low FROM sc)
SELECT seed, model_name, avg(flag::INT) AS prevalence, sum(flag::INT) FILTER (r <= ceil(n * 0.05 - 1e-9)) / ceil(any_value(n) * 0.05 - 1e-9) AS precision_at_5pct, sum(flag::INT) FILTER (r <= ceil(n * 0.05 - 1e-9)) / sum(flag::INT) AS recall_at_5pct,
  (sum(low) FILTER (flag) - sum(flag::INT) * (sum(flag::INT) + 1) / 2.0) / (sum(flag::INT) * (any_value(n) - sum(flag::INT))) AS roc_auc FROM rk GROUP BY seed, model_name""", floats="prevalence precision_at_5pct recall_at_5pct roc_auc")
def prevalence_sensitivity(spark, sf):
    """Models fitted once on clean training rows, stored, loaded, and judged on three populations of low prevalence."""
    from quotalens.operators import clustering as K, model_store as MS, preprocess as PP
    clean = injected_base(spark, sf)
    train = clean.filter("split = 'train'")
    features = ["total_sales", "total_quantity"]
    pre = PP.fit_preprocessor(train, features, log=True)
    fitted = pre.transform(train)
    center = lambda df: [list(r) for r in df.agg(*[F.avg(F.get("vector", F.lit(i))).alias(c) for i, c in enumerate(features)]).select(*features).collect()]
    root = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    MS.save_models({"prepared": pre, "one centre": K.KMeansModel(center(fitted)), "team centres": K.KMeansModel(center(fitted.groupBy("team")))}, root, spark)
    frozen = MS.load_models(spark, root)

    def score(rows):
        vectors = frozen["prepared"].transform(rows).select("population_row", "vector")
        each = [frozen[m].assign(vectors).select("population_row", F.lit(m).alias("model_name"), F.col("distance").alias("raw_score")) for m in ("one centre", "team centres")]
        return each[0].unionByName(each[1])

    usable = [p for p in I.PERTURBATIONS if p[1] in clean.columns]
    out = I.sensitivity(clean, "row_id", "split", LOW_RATE, SEEDS, score, perturbations=usable, series=["rep_id"], period="period")
    return out.select("seed", "model_name", "prevalence", "precision_at_5pct", "recall_at_5pct", "roc_auc")


@query("provenance_trace_checks", _INJECT + """
SELECT unnest(['changed_rows_have_injected_lineage', 'changed_rows_are_traced', 'truth_has_changed_fact']) AS check_name, 'pass' AS status, 0.0::DOUBLE AS value""", floats="value")
def provenance_trace_checks(spark, sf):
    clean, bad = injected(spark, sf)
    body = bad.drop("injected_anomaly_flag", "anomaly_type", "severity")
    changes = checkpointed(I.changed_rows(clean, body, ["row_id"], "rep_month"))
    marked = I.repair_provenance(body, changes, ["row_id"])
    again = checkpointed(I.changed_rows(clean, marked, ["row_id"], "rep_month").join(marked.select("row_id", "rep_id", "period"), ["row_id"]))
    truth = bad.filter("injected_anomaly_flag").select(F.col("row_id").alias("injection_id"), "rep_id", "period", F.lit("").alias("affected_dataset"), F.lit("[]").alias("affected_record_ids"))
    return I.trace_checks(again, I.extend_truth(truth, again, "injection_id", ["rep_id", "period"]), "injection_id").drop("detail")


@query("published_layers", """
SELECT 'orders' AS table_name, count(*) AS rows, true AS intact FROM orders UNION ALL SELECT 'supplier', count(*), true FROM supplier UNION ALL
SELECT 'open_orders', count(*), true FROM orders WHERE o_orderstatus = 'O'""")
def published_layers(spark, sf):
    """Two layers and a derived one, published as one version and verified against its manifest."""
    root = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    orders = read(spark, sf, "orders")
    SW.publish({"orders": orders, "supplier": read(spark, sf, "supplier"), "open_orders": orders.filter("o_orderstatus = 'O'")}, root, spark)
    return SW.verified(spark, root)


@query("severity_largest_remainder", """
WITH n AS (SELECT count(*) AS n FROM customer), q AS (SELECT * FROM (VALUES ('low', 0.5, 1), ('medium', 0.3, 2), ('high', 0.2, 3)) t(severity, p, i) CROSS JOIN n)
, f AS (SELECT *, floor(n * p) AS base, n * p - floor(n * p) AS rest FROM q), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, i) AS k, n - sum(base) OVER () AS left_over FROM f)
SELECT severity, CAST(base + (k <= left_over)::INT AS BIGINT) AS rows FROM r""")
def severity_largest_remainder(spark, sf):
    return I.assign_severities(read(spark, sf, "customer").select("c_custkey"), "c_custkey", {"low": 0.5, "medium": 0.3, "high": 0.2}, 42).groupBy("severity").agg(F.count(F.lit(1)).alias("rows"))


@query("table_diff_by_key", """
SELECT 'orders' AS dataset, CAST(o_orderkey AS VARCHAR) AS record_id, 'modified' AS change_type FROM orders WHERE o_orderstatus = 'P'""")
def table_diff_by_key(spark, sf):
    o = read(spark, sf, "orders")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return I.changed_rows(o, changed, ["o_orderkey"], "orders").select("dataset", "record_id", "change_type")


@query("json_payloads", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"event_type":"' || event_type || '"}' AS payload FROM events""", floats="k")
def json_payloads(spark, sf):
    e = read(spark, sf, "events")
    parsed = C.json_number("props", "k")
    return e.select("event_id", parsed.alias("k"), C.json_object(parsed.cast("long").alias("k"), F.col("event_type")).alias("payload"))


@query("table_fingerprint", """
SELECT true AS unchanged""")
def table_fingerprint(spark, sf):
    o = read(spark, sf, "orders")
    return SW.unchanged(SW.fingerprint(o), SW.fingerprint(o.orderBy(F.col("o_totalprice").desc())))


def source_rows(spark, sf):
    """The ledger in the shape of the 18-column source file (all text)."""
    led = ledger(spark, sf)
    t = lambda c: F.col(c).cast("string")
    return led.select(
        t("distributor").alias("Distributor"), t("customer_id").alias("Customer Name"), t("city").alias("City"), t("country").alias("Country"), t("quantity").alias("Latitude"), t("discount_pct").alias("Longitude"),
        t("channel").alias("Channel"), F.lit(None).cast("string").alias("Sub-channel"), t("product_id").alias("Product Name"), t("product_class").alias("Product Class"), t("quantity").alias("Quantity"),
        F.when(F.col("channel") == "MACHINERY", "n/a").otherwise(t("price")).alias("Price"), t("sales").alias("Sales"), F.date_format("period", "MMMM").alias("Month"), F.year("period").cast("string").alias("Year"),
        t("rep_name").alias("Name of Sales Rep"), t("manager").alias("Manager"), t("team").alias("Sales Team"))


_SRC = LEDGER + """
, u AS (SELECT DISTINCT distributor, customer_id, city, country, channel, product_id, product_class, quantity, discount_pct, CASE WHEN channel = 'MACHINERY' THEN NULL ELSE price END AS price, sales, period, rep_name, manager, team FROM ledger)
, ok AS (SELECT * FROM u WHERE price IS NOT NULL)"""


@query("commercial_load_report", _SRC + """
SELECT 'raw_rows' AS check_name, CAST(count(*) AS DOUBLE) AS value FROM ledger UNION ALL SELECT 'unique_rows', count(*) FROM u UNION ALL SELECT 'clean_rows', count(*) FROM ok UNION ALL SELECT 'sales_total', sum(sales) FROM ok UNION ALL
SELECT 'nonpositive_sales_retained', count(*) FILTER (sales <= 0) FROM ok UNION ALL SELECT 'representatives', count(DISTINCT rep_name) FROM ok UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM ok UNION ALL
SELECT 'duplicates_removed', (SELECT count(*) FROM ledger) - (SELECT count(*) FROM u) UNION ALL SELECT 'invalid_rows_removed', (SELECT count(*) FROM u) - (SELECT count(*) FROM ok) UNION ALL
SELECT 'rows__' || country, count(*) FROM ok GROUP BY country""", floats="value")
def commercial_load_report(spark, sf):
    return SR.load_commercial(source_rows(spark, sf))[1]


@query("normalised_source", _SRC + """
SELECT 'REP_' || substr(sha256(lower(trim(rep_name))), 1, 12) AS rep_id, period, 'TERR_' || substr(sha256(lower(team || ' / ' || country)), 1, 12) AS territory_id, sum(sales) AS sales, count(*) AS lines FROM ok GROUP BY ALL""", floats="sales")
def normalised_source(spark, sf):
    n = SR.normalise_source(source_rows(spark, sf))
    return n.groupBy("rep_id", "period", "territory_id").agg(F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("lines"))


@query("dimension_extracts", _SRC + """
SELECT DISTINCT 'REP_' || substr(sha256(lower(trim(rep_name))), 1, 12) AS rep_id, rep_name, 'source_observed' AS data_lineage FROM ok""")
def dimension_extracts(spark, sf):
    return SR.dimensions(SR.normalise_source(source_rows(spark, sf)))["rep_mapping"]


@query("schema_adaptation", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_extendedprice AS sales, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'Unknown City' AS city, trim(l_returnflag) AS channel FROM lineitem""", floats="sales")
def schema_adaptation(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("string").alias("Qty"), F.col("l_extendedprice").cast("string").alias("Unit Price"),
                                            F.date_format("l_shipdate", "yyyy-MM-dd").alias("Transaction Date"), F.concat(F.lit(" "), "l_returnflag").alias("Sales Channel"))
    return SR.adapt_schema(li)[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sales", "date", "city", "channel")


@query("data_dictionary", """
SELECT 'orders' AS table_name, 'o_orderkey' AS field, 'bigint' AS type, CAST(count(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 'orders', 'o_totalprice', 'double', CAST(count(*) AS BIGINT) FROM orders""")
def data_dictionary(spark, sf):
    o = read(spark, sf, "orders")
    d = SW.data_dictionary(spark, {"orders": o.select("o_orderkey", "o_totalprice")}).select("table_name", "field", "type")
    from quotalens.operators.ranking import with_scalars
    return with_scalars(d, o.agg(F.count(F.lit(1)).alias("rows")))
