"""Forecasts, staffing and scenarios."""

from pyspark.sql import functions as F

from quotalens.operators import planning as P
from quotalens.operators.ranking import null_safe_join, with_scalars
from quotalens.queries.base import LEDGER, ledger
from quotalens.queries.registry import query
from quotalens.session import checkpointed

UNIT = ["team", "country", "product_class"]
TRAIN, VALID = "1999-12-01", "2000-12-01"
WEIGHTS = {"distinct_customers": 0.40, "transaction_count": 0.25, "distinct_cities": 0.15, "distinct_products": 0.10, "distributor_count": 0.10}
METRICS = ["total_sales", "distinct_customers", "transaction_count", "distinct_products", "distinct_cities", "distributor_count"]
_AGG = """sum(sales) AS total_sales, count(DISTINCT customer_id)::DOUBLE AS distinct_customers, count(*)::DOUBLE AS transaction_count, count(DISTINCT product_id)::DOUBLE AS distinct_products,
  count(DISTINCT city)::DOUBLE AS distinct_cities, count(DISTINCT distributor)::DOUBLE AS distributor_count"""
_W = LEDGER + f"""
, ru AS (SELECT rep_id, team, country, product_class, period, {_AGG} FROM ledger GROUP BY ALL)
, sc AS (SELECT greatest(median(distinct_customers), 1) AS a, greatest(median(transaction_count), 1) AS b, greatest(median(distinct_cities), 1) AS c, greatest(median(distinct_products), 1) AS d,
   greatest(median(distributor_count), 1) AS e FROM ru WHERE period <= DATE '1999-12-01')
, rw AS (SELECT ru.*, 0.4 * distinct_customers / sc.a + 0.25 * transaction_count / sc.b + 0.15 * distinct_cities / sc.c + 0.1 * distinct_products / sc.d + 0.1 * distributor_count / sc.e AS workload FROM ru CROSS JOIN sc)
, un AS (SELECT team, country, product_class, period, {_AGG} FROM ledger GROUP BY ALL)
, uw AS (SELECT un.*, workload FROM un JOIN (SELECT team, country, product_class, period, sum(workload) AS workload FROM rw GROUP BY ALL) USING (team, country, product_class, period))
, rm AS (SELECT rep_id, period, sum(workload) AS workload FROM rw GROUP BY ALL)"""
_BT = _W + """
, l AS (SELECT team, country, product_class, period, year(period) * 12 + month(period) AS m, metric, x FROM (SELECT team, country, product_class, period, 'total_sales' AS metric, total_sales AS x FROM uw UNION ALL
   SELECT team, country, product_class, period, 'workload', workload FROM uw))
, h AS (SELECT *, min(x) OVER (PARTITION BY team, country, product_class, metric ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS s, avg(x) OVER (PARTITION BY team, country, product_class, metric ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a,
   list(x) OVER (PARTITION BY team, country, product_class, metric ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l)
, f AS (SELECT *, greatest(coalesce(s, a, 0), 0) AS f1, greatest(coalesce(a, 0), 0) AS f2, greatest(coalesce(CASE WHEN len(p) > 0 THEN list_reduce(p, lambda u, v: 0.7 * u + 0.3 * v) END, 0), 0) AS f3 FROM h)
, bt AS (SELECT team, country, product_class, period, metric, CASE WHEN period <= DATE '2000-12-01' THEN 'validation' ELSE 'test' END AS split, x AS observed, method, prediction FROM (
   SELECT *, 'seasonal_naive' AS method, f1 AS prediction FROM f UNION ALL SELECT *, 'moving_average', f2 FROM f UNION ALL SELECT *, 'exponential_smoothing', f3 FROM f) WHERE period > DATE '1999-12-01')
, bm AS (SELECT metric, method, split, avg(abs(prediction - observed)) AS mae, sqrt(avg((prediction - observed) * (prediction - observed))) AS rmse, sum(abs(prediction - observed)) / greatest(sum(abs(observed)), 1) AS wape,
   avg(2 * abs(prediction - observed) / greatest(abs(prediction) + abs(observed), 1)) AS smape, avg(prediction - observed) AS bias FROM bt GROUP BY ALL)"""
_CAP = _W + """
, g AS (SELECT *, (workload - lag(workload) OVER (PARTITION BY rep_id ORDER BY period)) / lag(workload) OVER (PARTITION BY rep_id ORDER BY period) AS growth FROM rm)
, st AS (SELECT workload FROM g WHERE period <= DATE '1999-12-01' AND abs(growth) <= 0.5)
, cap AS (SELECT quantile_cont(workload, 0.6) AS capacity, quantile_cont(workload, 0.4) AS capacity_low, quantile_cont(workload, 0.8) AS capacity_high, count(*) AS stable_rows FROM st)
, la AS (SELECT max(period) AS latest FROM rw), al AS (SELECT rw.*, workload / sum(workload) OVER (PARTITION BY rep_id) AS allocated_fte FROM rw JOIN la ON period = latest)"""


DISTINCT = {"distinct_customers": "customer_id", "distinct_products": "product_id", "distinct_cities": "city", "distributor_count": "distributor"}


def aggregate(df, keys):
    """Sums and distinct counts; each count drops repeats of its own column first, so no row is moved once per count as a whole."""
    out = df.groupBy(*keys).agg(F.sum("sales").alias("total_sales"), F.count(F.lit(1)).cast("double").alias("transaction_count"))
    for name, c in DISTINCT.items():
        out = null_safe_join(out, df.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).cast("double").alias(name)), keys, "left")
    return out


def rep_aggregate(df, rep, keys):
    """The same for groups of one representative: their lines are moved once and counted where they arrive."""
    lines = df.repartition(rep, *keys)
    return lines.groupBy(rep, *keys).agg(
        F.sum("sales").alias("total_sales"), F.count(F.lit(1)).cast("double").alias("transaction_count"),
        *[F.size(F.collect_set(c)).cast("double").alias(name) for name, c in DISTINCT.items()])


def rep_units(spark, sf):
    """The ledger's columns that planning reads, written once, and the workload per representative, unit and month."""
    led = checkpointed(ledger(spark, sf).select("rep_id", *UNIT, "period", "sales", *DISTINCT.values()))
    return led, P.workload_index(checkpointed(rep_aggregate(led, "rep_id", [*UNIT, "period"])), WEIGHTS, F.col("period") <= F.to_date(F.lit(TRAIN)))


def units(spark, sf):
    led, ru = rep_units(spark, sf)
    ru = checkpointed(ru)
    w = ru.groupBy(*UNIT, "period").agg(F.sum("workload").alias("workload"))
    return checkpointed(aggregate(led, [*UNIT, "period"]).join(w, [*UNIT, "period"])), ru


def capacity(ru):
    rm = ru.groupBy("rep_id", "period").agg(F.sum("workload").alias("workload"))
    return P.sustainable_capacity(rm, "rep_id", "period", "workload", TRAIN)


def planned(spark, sf):
    u, ru = units(spark, sf)
    tested = checkpointed(P.backtest(u, UNIT, "period", [*METRICS, "workload"], TRAIN, VALID))
    metrics = checkpointed(P.backtest_metrics(tested))
    alloc = checkpointed(P.fte_allocation(ru, "rep_id", "period", "workload", ru.agg(F.max("period").alias("latest"))))
    plan = P.unit_plan(u, UNIT, "period", tested, P.best_methods(metrics), checkpointed(capacity(ru)), alloc, METRICS, TRAIN, "rep_id")
    return u, metrics, alloc, checkpointed(plan)


@query("workload_by_unit", _W + " SELECT team, country, product_class, period, total_sales, workload FROM uw", floats="total_sales workload")
def workload_by_unit(spark, sf):
    return units(spark, sf)[0].select(*UNIT, "period", "total_sales", "workload")


@query("forecast_backtest", _BT + " SELECT team, country, product_class, period, metric, method, split, observed, prediction FROM bt", floats="observed prediction")
def forecast_backtest(spark, sf):
    return P.backtest(units(spark, sf)[0], UNIT, "period", ["total_sales", "workload"], TRAIN, VALID)


@query("forecast_backtest_metrics", _BT + " SELECT * FROM bm", floats="mae rmse wape smape bias", digits=4)
def forecast_backtest_metrics(spark, sf):
    return P.backtest_metrics(P.backtest(units(spark, sf)[0], UNIT, "period", ["total_sales", "workload"], TRAIN, VALID))


@query("selected_forecast_method", _BT + """
SELECT metric, method FROM bm WHERE split = 'validation' QUALIFY row_number() OVER (PARTITION BY metric ORDER BY wape, method) = 1""")
def selected_forecast_method(spark, sf):
    return P.best_methods(P.backtest_metrics(P.backtest(units(spark, sf)[0], UNIT, "period", ["total_sales", "workload"], TRAIN, VALID)))


@query("sustainable_capacity", _CAP + " SELECT *, false AS fallback FROM cap", floats="capacity capacity_low capacity_high")
def sustainable_capacity(spark, sf):
    return capacity(units(spark, sf)[1])


@query("fte_allocation", _CAP + " SELECT rep_id, team, country, product_class, workload, allocated_fte FROM al", floats="workload allocated_fte")
def fte_allocation(spark, sf):
    ru = units(spark, sf)[1]
    return P.fte_allocation(ru, "rep_id", "period", "workload", ru.agg(F.max("period").alias("latest"))).select("rep_id", *UNIT, "workload", "allocated_fte")


@query("staffing_need", _CAP + """
, u AS (SELECT team, country, product_class, sum(workload) AS w, sum(allocated_fte) AS fte FROM al GROUP BY ALL)
SELECT team, country, product_class, w / capacity AS required_fte, w / capacity - fte AS fte_gap, greatest(w / capacity - fte, 0) AS additional_fte_need, fte * capacity AS current_capacity, w / capacity / fte AS utilization
FROM u CROSS JOIN cap""", floats="required_fte fte_gap additional_fte_need current_capacity utilization")
def staffing_need(spark, sf):
    ru = units(spark, sf)[1]
    alloc = P.fte_allocation(ru, "rep_id", "period", "workload", ru.agg(F.max("period").alias("latest")))
    u = alloc.groupBy(*UNIT).agg(F.sum("workload").alias("w"), F.sum("allocated_fte").alias("fte"))
    u = with_scalars(u, capacity(ru).select("capacity"))
    return u.select(*UNIT, *[e.alias(n) for n, e in P.staffing_need("w", "capacity", "fte").items()])


_PLAN = _BT.replace("UNION ALL\n   SELECT team, country, product_class, period, 'workload', workload FROM uw)", "UNION ALL\n   SELECT team, country, product_class, period, 'workload', workload FROM uw)") + _CAP[len(_W):].replace("\n, g AS", "\n, gg AS").replace("FROM g WHERE", "FROM gg WHERE") + """
, bestm AS (SELECT method FROM bm WHERE split = 'validation' AND metric = 'workload' QUALIFY row_number() OVER (ORDER BY wape, method) = 1)
, q AS (SELECT team, country, product_class, max(period) AS last, arg_max(workload, period) AS w_last, max(workload) FILTER (period = (SELECT latest - INTERVAL 11 MONTH FROM la)) AS w12,
   list(workload ORDER BY period) AS p FROM uw GROUP BY ALL)
, fw AS (SELECT q.*, CASE method WHEN 'seasonal_naive' THEN coalesce(w12, list_avg(p[-3:])) WHEN 'moving_average' THEN list_avg(p[-3:]) ELSE list_reduce(p, lambda u, v: 0.7 * u + 0.3 * v) END AS forecast FROM q CROSS JOIN bestm)
, er AS (SELECT team, country, product_class, quantile_cont(abs(prediction - observed), 0.8) AS err FROM bt JOIN bestm USING (method) WHERE metric = 'workload' AND split = 'validation' GROUP BY ALL)
, us AS (SELECT team, country, product_class, sum(allocated_fte) AS fte, count(DISTINCT rep_id) AS reps FROM al GROUP BY ALL)
, pl AS (SELECT fw.team, fw.country, fw.product_class, last = latest AS eligible, CASE WHEN last = latest THEN greatest(forecast, 0) END AS fc, coalesce(err, 0) AS err, coalesce(fte, 0) AS fte, cap.* FROM fw CROSS JOIN la CROSS JOIN cap
   LEFT JOIN er USING (team, country, product_class) LEFT JOIN us USING (team, country, product_class))"""


@query("unit_staffing_plan", _PLAN + """
SELECT team, country, product_class, eligible AS planning_eligible, fc AS forecast_workload, CASE WHEN eligible THEN fte END AS allocated_current_fte, fc / capacity AS required_fte, fc / capacity - fte AS fte_gap,
  CASE WHEN eligible THEN greatest(fc - err, 0) / capacity_high END AS required_fte_low, (fc + err) / capacity_low AS required_fte_high FROM pl""",
       floats="forecast_workload allocated_current_fte required_fte fte_gap required_fte_low required_fte_high")
def unit_staffing_plan(spark, sf):
    plan = planned(spark, sf)[3]
    return plan.select(*UNIT, "planning_eligible", "forecast_workload", "allocated_current_fte", "required_fte", "fte_gap", "required_fte_low", "required_fte_high")


@query("staffing_scenarios", _PLAN + """
, s(scenario, d, a, k) AS (VALUES ('Base case', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('Demand +10%', 0.1, 0, 0), ('Demand +20%', 0.2, 0, 0), ('Add 1 representative', 0, 1, 0), ('Add 2 representatives', 0, 2, 0),
  ('Capacity -10%', 0, 0, -0.1), ('Product launch +30%', 0.3, 0, 0))
SELECT team, country, product_class, scenario, fc AS workload_before, fte * capacity AS capacity_before, fc / capacity - fte AS fte_gap_before, fc * (1 + d) AS workload_after, (fte + a) * (capacity * (1 + k)) AS capacity_after,
  fc * (1 + d) / (capacity * (1 + k)) - (fte + a) AS remaining_gap FROM pl CROSS JOIN s WHERE eligible""", floats="workload_before capacity_before fte_gap_before workload_after capacity_after remaining_gap")
def staffing_scenarios(spark, sf):
    return P.scenarios(planned(spark, sf)[3], UNIT).select(
        *UNIT, "scenario", "workload_before", "capacity_before", "fte_gap_before", "workload_after", "capacity_after", "remaining_gap")


@query("net_zero_reallocation", _PLAN + " SELECT 0.0::DOUBLE AS net_fte, CAST(2 AS BIGINT) AS rows, CAST(1 AS BIGINT) AS teams", floats="net_fte")
def net_zero_reallocation(spark, sf):
    r = P.reallocation(planned(spark, sf)[3], UNIT, "team")
    return r.agg(F.sum("fte_change").alias("net_fte"), F.count(F.lit(1)).alias("rows"), F.count_distinct("team").alias("teams"))


@query("capacity_base_checks", _PLAN + """
SELECT unnest(['fte_gap', 'required_fte', 'one_fte_per_rep', 'unit_fte', 'allocation_inside_units', 'bounds']) AS check_name, 'pass' AS status""")
def capacity_base_checks(spark, sf):
    u, metrics, alloc, plan = planned(spark, sf)
    base = P.capacity_base(plan, UNIT, metrics, u.select(*UNIT, "period", "workload"), "period")
    return P.capacity_base_checks(base, alloc, UNIT, "rep_id").select("check_name", "status")


@query("capacity_base_dataset", _PLAN + """
SELECT team, country, product_class, CASE WHEN NOT eligible THEN 'Ineligible / Stale Coverage' WHEN fc / capacity - fte > 1e-9 THEN 'Potential Capacity Gap' WHEN fc / capacity - fte < -1e-9 THEN 'Potential Spare Capacity' ELSE 'Balanced' END AS capacity_priority FROM pl""")
def capacity_base_dataset(spark, sf):
    u, metrics, _, plan = planned(spark, sf)
    return P.capacity_base(plan, UNIT, metrics, u.select(*UNIT, "period", "workload"), "period").select(*UNIT, "capacity_priority")


@query("scenario_dataset_checks", _PLAN + """
SELECT unnest(['remaining_gap', 'demand_assumption', 'fte_assumption', 'net_zero_transfer']) AS check_name, 'pass' AS status""")
def scenario_dataset_checks(spark, sf):
    plan = planned(spark, sf)[3]
    rows = P.scenarios(plan, UNIT).unionByName(P.reallocation(plan, UNIT, "team"), allowMissingColumns=True)
    return P.scenario_checks(P.scenario_dataset(rows.drop("reallocation_role"), plan, UNIT)).select("check_name", "status")
