"""Capacity (A18, D12–D25, P24, P25, V3)."""

from pyspark.sql import functions as F

from quotalens.operators import capacity as C
from quotalens.queries.base import LEDGER, ledger
from quotalens.queries.planning_inputs import customers, reps, transactions, visits
from quotalens.queries.registry import query
from quotalens.session import checkpointed

RULES = C.CapacityRules()
_V = LEDGER + """
, v AS (SELECT rep_id, CAST(date_trunc('month', ship_date) AS DATE) AS period, customer_id, city AS territory_id, count(*)::DOUBLE AS pc, sum((NOT return_flag)::INT)::DOUBLE AS cc, sum(quantity / 60.0) AS ph,
   sum(discount_pct * 100 / 42.0) AS th FROM ledger GROUP BY ALL)"""
_OWN = _V + """
, act AS (SELECT customer_id, period, rep_id, sum(n) AS n FROM (SELECT customer_id, period, rep_id, count(*) AS n FROM ledger GROUP BY ALL UNION ALL SELECT customer_id, period, rep_id, sum(pc) FROM v GROUP BY ALL) GROUP BY ALL)
, dyn AS (SELECT customer_id, period, rep_id FROM act QUALIFY row_number() OVER (PARTITION BY customer_id, period ORDER BY n DESC, rep_id) = 1)
, st AS (SELECT customer_id, min(period) AS start FROM act GROUP BY 1)
, tm AS (SELECT n_name AS terr, s_suppkey AS rep_id, row_number() OVER (PARTITION BY n_name ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS slot, count(*) OVER (PARTITION BY n_name) AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey)
, cm AS (SELECT c_custkey AS customer_id, cn.n_name AS territory_id, CASE WHEN c_acctbal > 6000 THEN 'high' WHEN c_acctbal > 2000 THEN 'medium' ELSE 'low' END AS pri, c_mktsegment AS seg,
   coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN (SELECT min(rep_id) FROM ledger l WHERE l.customer_id = c_custkey) END, tm.rep_id, (SELECT min(s_suppkey) FROM supplier)) AS owner
   FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN tm ON tm.terr = cn.n_name AND tm.slot = CAST('0x' || substr(sha256('42|' || c_custkey), 1, 15) AS BIGINT) % tm.size)
, mm AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT period FROM ledger UNION ALL SELECT period FROM v))
, own AS (SELECT cm.customer_id, mm.period, cm.territory_id, pri, CASE WHEN seg = 'BUILDING' THEN 1.0::DOUBLE ELSE CASE pri WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.5 END END AS req, coalesce(dyn.rep_id, cm.owner) AS rep_id
   FROM cm LEFT JOIN st USING (customer_id) JOIN mm ON st.start IS NULL OR mm.period >= st.start LEFT JOIN dyn ON dyn.customer_id = cm.customer_id AND dyn.period = mm.period)"""
_COV = _OWN + """
, seen AS (SELECT customer_id, period, count(DISTINCT rep_id)::DOUBLE AS sr, sum(pc) AS ov, sum(cc) AS oc, sum(ph) AS oh, sum(th) AS ot FROM v GROUP BY ALL)
, c0 AS (SELECT own.*, coalesce(sr, 0) AS sr, coalesce(ov, 0) AS ov, coalesce(oc, 0) AS oc, coalesce(oh, 0) AS oh, coalesce(ot, 0) AS ot, CASE WHEN ov > 0 THEN ot / ov END AS tr FROM own LEFT JOIN seen USING (customer_id, period))
, c1 AS (SELECT *, coalesce(tr, median(tr) OVER (PARTITION BY territory_id), 0.5) AS est, least(req, ov) AS plan, least(req, oc) AS done FROM c0)
, c2 AS (SELECT *, CASE WHEN ov > 0 THEN plan / ov ELSE 0 END AS sh FROM c1)
, cov AS (SELECT *, oh * sh AS plan_h, ot * sh AS plan_t, greatest(req - plan, 0) AS pgap, greatest(req - done, 0) AS cgap, greatest(req - plan, 0) * 0.70 + greatest(req - plan, 0) * est AS cov_h FROM c2)"""
_SERV = _COV + """
, sa AS (SELECT v.rep_id, v.period, v.territory_id, v.pc, v.cc, v.ph, v.th, CASE WHEN cov.ov > 0 THEN least(cov.req, cov.ov) / cov.ov ELSE 0 END AS ps, CASE WHEN cov.oc > 0 THEN least(cov.req, cov.oc) / cov.oc ELSE 0 END AS cs
   FROM v JOIN cov USING (customer_id, period))
, serv AS (SELECT rep_id, period, sum(pc * ps) AS pc, sum(cc * cs) AS cc, sum(ph * ps) AS ph, sum(th * ps) AS th, sum(greatest(ph - ph * ps, 0) + greatest(th - th * ps, 0)) AS xh FROM sa GROUP BY ALL)"""
_CAL = _SERV + """
, tk AS (SELECT s_suppkey AS rep_id, sn.n_name AS home, mm.period, CAST(s_suppkey AS VARCHAR) || '|' || strftime(mm.period, '%Y-%m') AS token FROM supplier JOIN nation sn ON s_nationkey = sn.n_nationkey
   CROSS JOIN (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM ledger) mm)
, hs AS (SELECT *, CAST('0x' || substr(sha256('42|leave_days|' || token), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u1, CAST('0x' || substr(sha256('42|holiday_days|' || token), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u2,
   CAST('0x' || substr(sha256('42|training_hours|' || token), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u3, CAST('0x' || substr(sha256('42|administrative_hours|' || token), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u4,
   CAST('0x' || substr(sha256('42|meeting_hours|' || token), 1, 15) AS BIGINT) / (CAST(16 AS DOUBLE) ** 15 - 1) AS u5 FROM tk)
, av AS (SELECT rep_id, period, home, greatest((20.0 - floor(2.999 * u1 + 1e-12) - floor(2.999 * u2 + 1e-12)) * 8.0 - (2.0 + 5.0 * u3) - (8.0 + 6.0 * u4) - (4.0 + 5.0 * u5), 0) AS avail FROM hs)
, ca AS (SELECT rep_id, period, sum(cov_h) AS cov_h, sum(cgap) AS cgap, sum(req) AS req FROM cov GROUP BY ALL)
, cal AS (SELECT av.*, coalesce(serv.ph, 0) + coalesce(serv.th, 0) + coalesce(ca.cov_h, 0) AS core, coalesce(ca.cgap, 0) AS cgap, coalesce(serv.xh, 0) AS xh FROM av LEFT JOIN serv USING (rep_id, period) LEFT JOIN ca USING (rep_id, period))
, cu AS (SELECT *, core * 1.08 AS total, CASE WHEN avail > 0 THEN core * 1.08 * 100 / avail WHEN core > 0 THEN 10000 ELSE 0 END AS util FROM cal)
, tc AS (SELECT rep_id, period, city, count(*) AS n FROM ledger GROUP BY ALL), td AS (SELECT rep_id, period, city FROM tc QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY n DESC, city) = 1)"""


def inputs(spark, sf):
    tx = transactions(spark, sf)
    return tx, reps(spark, sf), customers(spark, sf, tx), visits(spark, sf, tx)


def calendar(spark, sf):
    return C.capacity_calendar(*inputs(spark, sf), RULES)


@query("visit_workload", _V + """
SELECT rep_id, period, customer_id, territory_id, pc AS planned_visit_count, cc AS completed_visit_count, ph AS planned_visit_hours, th AS planned_travel_hours FROM v""",
       floats="planned_visit_count completed_visit_count planned_visit_hours planned_travel_hours")
def visit_workload(spark, sf):
    return C.prepare_visits(visits(spark, sf), RULES)


@query("normalized_workload_index", LEDGER + """
, l AS (SELECT rep_id, period, count(DISTINCT customer_id) AS a, count(*) AS b, count(DISTINCT city) AS c, count(DISTINCT product_id) AS d, count(DISTINCT distributor) AS e FROM ledger GROUP BY ALL)
, s AS (SELECT greatest(median(a), 1) AS a, greatest(median(b), 1) AS b, greatest(median(c), 1) AS c, greatest(median(d), 1) AS d, greatest(median(e), 1) AS e FROM l WHERE period <= DATE '1999-12-01')
, g AS (SELECT s_suppkey AS rep_id, CAST(m AS DATE) AS period FROM supplier CROSS JOIN (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS m FROM ledger))
SELECT rep_id, period, 0.4 * coalesce(l.a, 0) / s.a + 0.25 * coalesce(l.b, 0) / s.b + 0.15 * coalesce(l.c, 0) / s.c + 0.10 * coalesce(l.d, 0) / s.d + 0.10 * coalesce(l.e, 0) / s.e AS workload
FROM g LEFT JOIN l USING (rep_id, period) CROSS JOIN s""", floats="workload")
def normalized_workload_index(spark, sf):
    rules = C.CapacityRules(train_end="1999-12-01")
    return C.normalized_workload(ledger(spark, sf), reps(spark, sf), rules).select("rep_id", "period", F.col("normalized_workload_index").alias("workload"))


@query("period_territory", LEDGER + """
, n AS (SELECT rep_id, period, city, count(*) AS n, sum(count(*)) OVER (PARTITION BY rep_id, period) AS t FROM ledger GROUP BY rep_id, period, city)
SELECT rep_id, period, arg_min(city, (-n, city)) AS territory_id, max(n / t) AS dominant_territory_activity_share, count(*) AS active_territory_count,
  string_agg(city || ':' || printf('%.8f', n / t), '|' ORDER BY city) AS fractional_territory_allocation FROM n GROUP BY ALL""".replace("arg_min(city, (-n, city))", "first(city ORDER BY n DESC, city)"),
       floats="dominant_territory_activity_share")
def period_territory(spark, sf):
    return C.period_territory(ledger(spark, sf).withColumn("territory_id", F.col("city")))


@query("customer_ownership", _OWN + " SELECT customer_id, period, rep_id, pri AS customer_priority, req AS required_visit_count FROM own", floats="required_visit_count")
def customer_ownership(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    owned = C.customer_owners(tx, C.prepare_visits(visit, RULES), cust, rep, RULES)
    return owned.select("customer_id", "period", "rep_id", "customer_priority", "required_visit_count")


@query("coverage_drilldown", _COV + """
SELECT customer_id, period, rep_id, sr AS servicing_rep_count, plan AS planned_visit_count, done AS completed_visit_count, plan_h AS planned_visit_hours, greatest(oh - plan_h, 0) + greatest(ot - plan_t, 0) AS excess_service_hours,
  cgap AS customer_coverage_gap, cov_h AS required_customer_coverage_hours, CASE WHEN pri = 'high' THEN cgap ELSE 0 END AS priority_customer_coverage_gap,
  least(CASE WHEN req > 0 THEN done / req ELSE 1 END, 1) * 100 AS customer_coverage_pct, CASE WHEN cgap <= 1e-12 THEN 'Covered' WHEN pgap <= 1e-12 THEN 'Planned / not completed' ELSE 'Coverage gap' END AS coverage_status FROM cov""",
       floats="servicing_rep_count planned_visit_count completed_visit_count planned_visit_hours excess_service_hours customer_coverage_gap required_customer_coverage_hours priority_customer_coverage_gap customer_coverage_pct")
def coverage_drilldown(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    activity, v = C.customer_activity(tx, visit, RULES)
    d = C.coverage(C.customer_owners(tx, v, cust, rep, RULES, activity), v, RULES)
    return d.select("customer_id", "period", "rep_id", "servicing_rep_count", "planned_visit_count", "completed_visit_count", "planned_visit_hours", "excess_service_hours", "customer_coverage_gap",
                    "required_customer_coverage_hours", "priority_customer_coverage_gap", "customer_coverage_pct", "coverage_status")


@query("servicing_allocation", _SERV + """
SELECT rep_id, period, pc AS planned_visit_count, cc AS completed_visit_count, ph AS planned_visit_hours, th AS planned_travel_hours, xh AS excess_service_hours FROM serv""",
       floats="planned_visit_count completed_visit_count planned_visit_hours planned_travel_hours excess_service_hours")
def servicing_allocation(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    activity, v = C.customer_activity(tx, visit, RULES)
    covered = C.coverage(C.customer_owners(tx, v, cust, rep, RULES, activity), v, RULES)
    return C.servicing_allocation(v, covered).select("rep_id", "period", "planned_visit_count", "completed_visit_count", "planned_visit_hours", "planned_travel_hours", "excess_service_hours")


@query("capacity_calendar", _CAL + """
SELECT rep_id, period, coalesce(city, home) AS territory_id, avail AS available_field_hours, total AS required_total_hours, util AS utilization_pct, total / 160 AS required_fte, avail / 160 AS available_fte,
  total / 160 - avail / 160 AS fte_gap, cgap AS customer_coverage_gap, CASE WHEN util >= 120 THEN 'critical' WHEN util >= 100 THEN 'high' WHEN util >= 85 THEN 'medium' ELSE 'low' END AS capacity_risk_band
FROM cu LEFT JOIN td USING (rep_id, period)""", floats="available_field_hours required_total_hours utilization_pct required_fte available_fte fte_gap customer_coverage_gap")
def capacity_calendar(spark, sf):
    cal, _ = calendar(spark, sf)
    return cal.select("rep_id", "period", "territory_id", "available_field_hours", "required_total_hours", "utilization_pct", "required_fte", "available_fte", "fte_gap", "customer_coverage_gap", "capacity_risk_band")


@query("allocation_by_activity_share", _CAL + """
, sh AS (SELECT rep_id, period, city AS territory_id, n / sum(n) OVER (PARTITION BY rep_id, period) AS share FROM tc)
, al AS (SELECT * FROM sh UNION ALL SELECT rep_id, period, home, 1.0 FROM cu WHERE (rep_id, period) NOT IN (SELECT (rep_id, period) FROM tc))
SELECT al.rep_id, al.period, al.territory_id, share AS territory_allocation_share, total * share AS required_total_hours, avail * share AS available_field_hours FROM al JOIN cu ON cu.rep_id = al.rep_id AND cu.period = al.period""",
       floats="territory_allocation_share required_total_hours available_field_hours")
def allocation_by_activity_share(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    cal, _ = C.capacity_calendar(tx, rep, cust, visit, RULES)
    return C.territory_allocation(cal, tx).select("rep_id", "period", "territory_id", "territory_allocation_share", "required_total_hours", "available_field_hours")


@query("allocation_conserves_calendar", _CAL + """
SELECT rep_id, period, total AS required_total_hours, avail AS available_field_hours, total / 160 - avail / 160 AS fte_gap, 1.0::DOUBLE AS territory_allocation_share FROM cu""",
       floats="required_total_hours available_field_hours fte_gap territory_allocation_share")
def allocation_conserves_calendar(spark, sf):
    """The exact allocation, added up again, gives the calendar."""
    tx, rep, cust, visit = inputs(spark, sf)
    cal, covered = C.capacity_calendar(tx, rep, cust, visit, RULES)
    out = C.territory_allocation(cal, tx, visit, covered, RULES)
    return out.groupBy("rep_id", "period").agg(*[F.sum(c).alias(c) for c in ("required_total_hours", "available_field_hours", "fte_gap", "territory_allocation_share")])


@query("allocation_by_service", _CAL + """
, sv AS (SELECT rep_id, period, territory_id, sum(ph * ps) + sum(th * ps) AS h FROM sa GROUP BY ALL), cv AS (SELECT rep_id, period, territory_id, sum(cov_h) AS h FROM cov GROUP BY ALL)
, ky AS (SELECT rep_id, period, territory_id FROM sv UNION SELECT rep_id, period, territory_id FROM cv UNION SELECT rep_id, period, city FROM tc UNION SELECT rep_id, period, coalesce(city, home) FROM cu LEFT JOIN td USING (rep_id, period))
SELECT ky.rep_id, ky.period, ky.territory_id, coalesce(sv.h, 0) + coalesce(cv.h, 0) AS core_required_hours, (coalesce(sv.h, 0) + coalesce(cv.h, 0)) * 1.08 AS required_total_hours
FROM ky SEMI JOIN cu ON cu.rep_id = ky.rep_id AND cu.period = ky.period LEFT JOIN sv USING (rep_id, period, territory_id) LEFT JOIN cv USING (rep_id, period, territory_id)""", floats="core_required_hours required_total_hours")
def allocation_by_service(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    cal, covered = C.capacity_calendar(tx, rep, cust, visit, RULES)
    return C.territory_allocation(cal, tx, visit, covered, RULES).select("rep_id", "period", "territory_id", "core_required_hours", "required_total_hours")


@query("territory_summary", _CAL + """
, sh AS (SELECT rep_id, period, city AS territory_id, n / sum(n) OVER (PARTITION BY rep_id, period) AS share FROM tc)
, al AS (SELECT * FROM sh UNION ALL SELECT rep_id, period, home, 1.0 FROM cu WHERE (rep_id, period) NOT IN (SELECT (rep_id, period) FROM tc))
, g AS (SELECT al.territory_id, al.period, sum(total * share) AS r, sum(avail * share) AS a, count(DISTINCT al.rep_id) AS rep_count, sum(share) AS eq FROM al JOIN cu ON cu.rep_id = al.rep_id AND cu.period = al.period GROUP BY ALL)
SELECT territory_id, period, rep_count, eq AS fractional_rep_equivalent, r AS required_total_hours, CASE WHEN a > 0 THEN r * 100 / a ELSE 0 END AS utilization_pct, greatest(r / 160 - a / 160, 0) AS positive_fte_gap,
  CASE WHEN r * 100 / a >= 120 THEN 'critical' WHEN r * 100 / a >= 100 THEN 'high' WHEN r * 100 / a >= 85 THEN 'medium' ELSE 'low' END AS capacity_risk_band FROM g""",
       floats="fractional_rep_equivalent required_total_hours utilization_pct positive_fte_gap")
def territory_summary(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    cal, _ = C.capacity_calendar(tx, rep, cust, visit, RULES)
    return C.territory_summary(C.territory_allocation(cal, tx), RULES).select(
        "territory_id", "period", "rep_count", "fractional_rep_equivalent", "required_total_hours", "utilization_pct", "positive_fte_gap", "capacity_risk_band")


@query("capacity_evaluation", _CAL + """
, tr AS (SELECT DISTINCT rep_id, period FROM tc WHERE n >= 4), m AS (SELECT util >= 100 AS p, tr.rep_id IS NOT NULL AS y, total FROM cu LEFT JOIN tr USING (rep_id, period))
SELECT count(*) FILTER (y AND p) AS true_positives, count(*) FILTER (NOT y AND p) AS false_positives, count(*) FILTER (NOT y AND NOT p) AS true_negatives, count(*) FILTER (y AND NOT p) AS false_negatives,
  CASE WHEN count(*) FILTER (p) > 0 THEN count(*) FILTER (y AND p) / count(*) FILTER (p) ELSE 0 END AS overload_precision, count(*) FILTER (y AND p) / count(*) FILTER (y) AS overload_recall,
  avg(CASE WHEN y THEN abs(total - 10) END) AS workload_mae, count(*) FILTER (y) AS workload_mae_rows FROM m""", floats="overload_precision overload_recall workload_mae")
def capacity_evaluation(spark, sf):
    tx, rep, cust, visit = inputs(spark, sf)
    cal, _ = C.capacity_calendar(tx, rep, cust, visit, RULES)
    truth = tx.groupBy("rep_id", "period", "city").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("rep_id", "period").distinct()
    truth = truth.select(F.concat_ws("-", "rep_id", F.date_format("period", "yyyyMM")).alias("truth_id"), "rep_id", "period", F.lit(None).cast("array<string>").alias("record_ids"),
                         F.lit(None).cast("string").alias("territory_id"), F.lit(10.0).alias("required_total_hours_truth"))
    return C.evaluate_capacity(cal, truth)


@query("overload_threshold_sensitivity", _CAL + """
, t(x) AS (VALUES (85.0::DOUBLE), (100.0), (120.0))
SELECT x AS threshold_pct, CAST(sum((util >= x)::INT) AS BIGINT) AS overloaded_rows, avg((util >= x)::INT) AS overload_rate FROM cu CROSS JOIN t GROUP BY 1""", floats="threshold_pct overload_rate")
def overload_threshold_sensitivity(spark, sf):
    return C.threshold_sensitivity(calendar(spark, sf)[0], [85.0, 100.0, 120.0])


@query("capacity_after_change", _CAL + """
, x AS (SELECT rep_id, period, avail, greatest(total, (core + greatest((total + 5 - total) / 1.08, 0)) * 1.08) AS total FROM cu)
SELECT rep_id, period, total AS required_total_hours, CASE WHEN avail > 0 THEN total * 100 / avail ELSE 10000 END AS utilization_pct, total / 160 - avail / 160 AS fte_gap FROM x""", floats="required_total_hours utilization_pct fte_gap")
def capacity_after_change(spark, sf):
    cal, _ = calendar(spark, sf)
    out = C.raise_required_total(cal.withColumn("target", F.col("required_total_hours") + 5), "target", "required_customer_coverage_hours", RULES)
    return out.select("rep_id", "period", "required_total_hours", "utilization_pct", "fte_gap")


OVERLOAD, UNDERCOVERAGE = "territory_workload_exceeds_capacity", "persistent_priority_undercoverage"


def changed_calendar(spark, sf):
    """The calendar, a copy with 60 hours on reps busy in one city and a wider priority gap at quarter ends, and the truth."""
    tx, rep, cust, visit = inputs(spark, sf)
    cal = checkpointed(C.capacity_calendar(tx, rep, cust, visit, RULES)[0])
    busy = tx.groupBy("rep_id", "period", "city").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("rep_id", "period").distinct()
    marked = cal.join(busy.withColumn("busy", F.lit(True)), ["rep_id", "period"], "left").withColumns({
        "target": F.col("required_total_hours") + F.when(F.col("busy"), 60.0).otherwise(0.0),
        "priority_customer_coverage_gap": F.col("priority_customer_coverage_gap") + F.when(F.month("period") % 3 == 0, 3.0).otherwise(0.0)})
    after = checkpointed(C.raise_required_total(marked, "target", "required_customer_coverage_hours", RULES))
    entry = lambda rows, name: rows.select(
        F.concat_ws("-", F.lit(name), "rep_id", F.date_format("period", "yyyyMM")).alias("truth_id"), F.lit(name).alias("scenario"), F.array("capacity_record_id").alias("record_ids"),
        "period", "rep_id", F.lit(None).cast("string").alias("territory_id"), F.lit(None).cast("double").alias("required_total_hours_truth"))
    truth = entry(after.filter("busy"), OVERLOAD).unionByName(entry(after.filter(F.month("period") % 3 == 0), UNDERCOVERAGE))
    return cal, after.drop("busy", "target"), truth


_CHANGED = _CAL + """
, busy AS (SELECT DISTINCT rep_id, period FROM tc WHERE n >= 4)
, pg AS (SELECT rep_id, period, sum(CASE WHEN pri = 'high' THEN cgap ELSE 0 END) AS pp FROM cov GROUP BY ALL)
, ch AS (SELECT cu.rep_id, cu.period, total, util, avail, busy.rep_id IS NOT NULL AS b, total + CASE WHEN busy.rep_id IS NOT NULL THEN 60 ELSE 0 END AS t2, month(cu.period) % 3 = 0 AS q,
   coalesce(pp, 0) AS gap FROM cu LEFT JOIN busy USING (rep_id, period) LEFT JOIN pg USING (rep_id, period))
, cx AS (SELECT *, CASE WHEN avail > 0 THEN t2 * 100 / avail WHEN t2 > 0 THEN 10000 ELSE 0 END AS u2, gap + CASE WHEN q THEN 3 ELSE 0 END AS g2 FROM ch)"""


@query("capacity_scenario_types", _CHANGED + """
, th AS (SELECT quantile_cont(gap, 0.95) AS t FROM cx)
, f AS (SELECT 'territory_workload_exceeds_capacity' AS scenario, b AS y, u2 >= 100 AS p, 100.0::DOUBLE AS threshold FROM cx
   UNION ALL SELECT 'persistent_priority_undercoverage', q, g2 > t, t FROM cx CROSS JOIN th)
SELECT scenario, count(*) AS observations, count(*) FILTER (y) AS positive_support, count(*) FILTER (y) AS overall_truth_support, count(*) FILTER (p) AS selected, count(*) FILTER (y AND p) AS captured,
  count(*) FILTER (p AND NOT y) AS false_positives, CASE WHEN count(*) FILTER (p) > 0 THEN count(*) FILTER (y AND p) / count(*) FILTER (p) ELSE 0 END AS precision,
  CASE WHEN count(*) FILTER (y) > 0 THEN count(*) FILTER (y AND p) / count(*) FILTER (y) END AS recall, threshold, CASE WHEN count(*) FILTER (y) > 0 THEN 'evaluated' ELSE 'no_support' END AS support_status
FROM f GROUP BY scenario, threshold""", floats="precision recall threshold")
def capacity_scenario_types(spark, sf):
    """What the overload and the undercoverage rule find of the changes made to a copy of the calendar."""
    return C.scenario_type_rows(*changed_calendar(spark, sf), OVERLOAD, UNDERCOVERAGE)


_SHIFT = _CHANGED + """
, rk AS (SELECT rep_id, period, round(util, 6) AS v1, round(u2, 6) AS v2 FROM cx)
, sr AS (SELECT *, rank() OVER (ORDER BY v1 DESC) + (count(*) OVER (PARTITION BY v1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY v2 DESC) + (count(*) OVER (PARTITION BY v2) - 1) / 2.0::DOUBLE AS r2 FROM rk)"""


def shifts(spark, sf):
    clean, after, _ = changed_calendar(spark, sf)
    return C.rank_shift(*[t.withColumn("utilization_pct", F.round("utilization_pct", 6)) for t in (clean, after)], ["rep_id", "period"], "utilization_pct")


@query("capacity_rank_shift", _SHIFT + """
SELECT rep_id, period, v1 AS clean_value, v2 AS injected_value, r1 AS clean_rank, r2 AS injected_rank, r1 - r2 AS rank_shift FROM sr""", floats="clean_value injected_value clean_rank injected_rank rank_shift")
def capacity_rank_shift(spark, sf):
    """Rep-months in the clean and in the changed ranking by utilisation."""
    return shifts(spark, sf)


@query("capacity_rank_sensitivity", _SHIFT + """
, t(x) AS (VALUES (85.0::DOUBLE), (100.0), (120.0))
, w AS (SELECT count(*) AS paired_units, corr(r1, r2) AS spearman, avg(abs(r1 - r2)) AS mean_abs_shift, max(abs(r1 - r2)) AS max_abs_shift FROM sr)
SELECT x AS threshold, count(*) FILTER (v1 >= x) AS clean_above, count(*) FILTER (v2 >= x) AS injected_above, count(*) FILTER (v1 >= x AND v2 >= x) AS both_above,
  CASE WHEN count(*) FILTER (v1 >= x OR v2 >= x) > 0 THEN count(*) FILTER (v1 >= x AND v2 >= x) / count(*) FILTER (v1 >= x OR v2 >= x) END AS overlap, any_value(paired_units) AS paired_units,
  any_value(spearman) AS spearman, any_value(mean_abs_shift) AS mean_abs_shift, any_value(max_abs_shift) AS max_abs_shift
FROM sr CROSS JOIN t CROSS JOIN w GROUP BY x""", floats="threshold overlap spearman mean_abs_shift max_abs_shift")
def capacity_rank_sensitivity(spark, sf):
    """How far the ranking by utilisation moves when the calendar changes."""
    return C.rank_sensitivity(shifts(spark, sf), [85.0, 100.0, 120.0])
