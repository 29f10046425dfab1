"""Capacity steps move an activity row by its customer once, and a rep-period's cells once."""

import datetime as dt

from pyspark.sql import functions as F

from quotalens.operators import capacity as C


def sources(spark):
    day = lambda m: dt.date(2000, m, 1)
    rows = [(r, day(m), c, ("x", "y", None)[(r + c + m) % 3], p, f"d{p % 2}", float(10 * p)) for r in (1, 2, 3) for m in (1, 2, 4) for c in (7, 8, 9) for p in range((r * m + c) % 4)]
    tx = spark.createDataFrame(rows, "rep_id long, period date, customer_id long, territory_id string, product_id long, distributor string, minutes double").withColumn("city", F.coalesce("territory_id", F.lit("z")))
    visits = tx.filter("product_id < 2").select("rep_id", "period", "customer_id", "territory_id", F.col("minutes").alias("visit_duration_minutes"), F.lit(4.2).alias("estimated_travel_km"), (F.col("product_id") == 0).alias("visit_completed_flag"))
    customers = spark.createDataFrame([(7, "x", "high"), (8, "y", "low"), (9, None, "medium"), (10, "x", "low")], "customer_id long, territory_id string, customer_priority string")
    reps = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "rep_id long, territory_id string")
    return tx, reps, customers, visits


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_activity_gives_the_same_portfolio_and_coverage_without_moving_it(spark):
    tx, reps, customers, field_visits = sources(spark)
    activity, dealt = C.customer_activity(tx, field_visits)
    plain = C.prepare_visits(field_visits)
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
    got = C.coverage(C.customer_owners(tx, dealt, customers, reps, activity=activity), dealt)
    want = C.coverage(C.customer_owners(tx, plain, customers, reps), plain)
    rounded = lambda d: sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in d.collect())
    assert rounded(got) == rounded(want)
    # the rep most active in a month and what its visits were are grouped where the activity lies
    assert "Exchange" not in text(dealt.groupBy("customer_id", "period").count()) and "Exchange" not in text(activity.groupBy("customer_id", "period", "rep_id").agg(F.sum("_n")))


def test_credits_and_observed_visits_come_from_one_pass(spark):
    tx, reps, customers, field_visits = sources(spark)
    activity, visits = C.customer_activity(tx, field_visits)
    covered = C.coverage(C.customer_owners(tx, visits, customers, reps, activity=activity), visits)
    both = C.servicing_allocation(visits, covered, observed=True)
    apart = C.servicing_allocation(visits, covered).join(C.observed_visits(visits), C.REP)
    rows = lambda d: {(r["rep_id"], r["period"]): {k: round(v, 9) for k, v in r.asDict().items() if isinstance(v, float)} for r in d.collect()}
    assert rows(both) == rows(apart) and len(rows(both)) > 3


def test_allocation_by_service_adds_up_to_the_calendar_and_joins_no_wide_cells(spark):
    tx, reps, customers, field_visits = sources(spark)
    calendar, covered = C.capacity_calendar(tx, reps, customers, field_visits)
    out = C.territory_allocation(calendar, tx, field_visits, covered)
    sums = out.groupBy(*C.REP).agg(*[F.sum(c).alias(f"_{c}") for c in ("required_total_hours", "available_field_hours", "observed_visit_count", "transaction_count")])
    rows = calendar.join(sums, C.REP).collect()
    assert len(rows) == calendar.count() == 12
    for r in rows:
        for c in ("required_total_hours", "available_field_hours", "observed_visit_count", "transaction_count"):
            assert abs(r[c] - r[f"_{c}"]) < 1e-6, (c, r)
    # cells are never joined on three keys: their parts are added up in one pass
    assert "full_outer" not in text(out).lower() and "FullOuter" not in text(out)
    assert out.filter("territory_id IS NULL").count() == 0 or out.filter("territory_id IS NULL AND observed_visit_count > 0").count() == 0
