import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.operators import capacity as C, injection as I, orders as O
from quotalens.sources import readers as SR, writers as SW

JAN, FEB = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


@pytest.fixture(scope="module")
def tables(spark):
    tx = spark.createDataFrame(
        [("R1", "C1", JAN, "x", "P1", "D", "T1"), ("R1", "C2", JAN, "x", "P2", "D", "T2"), ("R1", "C2", JAN, "y", "P2", "D", "T2"), ("R2", "C3", JAN, "z", "P1", "D", "T2"),
         ("R2", "C4", FEB, "z", "P1", "E", "T2"), ("R1", "C1", FEB, "x", "P1", "D", "T1"), ("R2", "C2", FEB, "z", "P3", "D", "T2")],
        "rep_id string, customer_id string, period date, city string, product_id string, distributor string, territory_id string")
    reps = spark.createDataFrame([("R1", "T1", 8.0, 20.0, 1.0, 1.0, 4.0, 10.0, 6.0), ("R2", "T2", 8.0, 20.0, 0.0, 0.0, 4.0, 10.0, 6.0)],
                                 "rep_id string, territory_id string, standard_field_hours_per_day double, standard_working_days_per_month double, leave_days double, holiday_days double, "
                                 "training_hours double, administrative_hours double, meeting_hours double")
    customers = spark.createDataFrame([(f"C{i}", "R1" if i < 3 else "R2", "T1" if i < 3 else "T2", "high" if i == 1 else "low", 3.2) for i in range(1, 5)],
                                      "customer_id string, primary_rep_id string, territory_id string, customer_priority string, required_visit_frequency double")
    visits = spark.createDataFrame(
        [("R1", "C1", JAN, 60.0, 42.0, "true", "T1"), ("R1", "C1", JAN, 60.0, 42.0, "true", "T1"), ("R2", "C1", JAN, 30.0, 21.0, "true", "T2"), ("R2", "C3", JAN, None, 0.0, "false", "T2"),
         ("R1", "C2", FEB, 45.0, 10.0, "yes", "T2"), ("R2", "C4", FEB, 90.0, 84.0, "1", "T2")],
        "rep_id string, customer_id string, visit_date date, visit_duration_minutes double, estimated_travel_km double, visit_completed_flag string, territory_id string")
    return tx, reps, customers, visits


def test_calendar_arithmetic(tables):
    cal, covered = C.capacity_calendar(*tables)
    rows = {(r["rep_id"], r["period"]): r for r in cal.collect()}
    r = rows[("R1", JAN)]
    assert r["available_field_hours"] == 18 * 8 - 20
    # C1 needs two visits a month and got three: two thirds of every visit counts.
    assert r["planned_visit_hours"] == pytest.approx(2 * 2 / 3) and r["excess_service_visit_count"] == pytest.approx(2 / 3)
    assert r["required_total_hours"] == pytest.approx(r["core_required_hours"] * 1.08)
    assert covered.groupBy("rep_id", "period", "customer_id").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("exact", [True, False])
def test_allocation_conserves_every_additive_column(tables, exact):
    tx, reps, customers, visits = tables
    cal, covered = C.capacity_calendar(*tables)
    out = C.territory_allocation(cal, tx, visits, covered) if exact else C.territory_allocation(cal, tx)
    measures = [*C.AVAILABILITY_MEASURES, *C.VISIT_MEASURES, *C.COVERAGE_MEASURES, *C.DERIVED_MEASURES]
    sums = out.groupBy("rep_id", "period").agg(*[F.sum(c).alias(c) for c in measures], F.sum("territory_allocation_share").alias("s"))
    want = {(r["rep_id"], r["period"]): r for r in cal.collect()}
    for r in sums.collect():
        assert r["s"] == pytest.approx(1.0)
        for c in measures:
            assert r[c] == pytest.approx(want[(r["rep_id"], r["period"])][c], abs=1e-9), c


def test_residual_goes_to_the_dominant_territory(spark):
    df = spark.createDataFrame([("R", JAN, "A", True, 1.0), ("R", JAN, "B", False, 2.0)], "rep_id string, period date, territory_id string, dominant_territory_flag boolean, h double")
    source = spark.createDataFrame([("R", JAN, 5.0)], "rep_id string, period date, h double")
    out = {r["territory_id"]: r for r in C.reconcile_onto_dominant(df, source, ["h"], ["h"]).collect()}
    assert out["A"]["h"] == 3.0 and out["A"]["residual_allocation_columns"] == ["h"] and out["A"]["unrepresented_workload_residual_hours"] == 2.0
    assert out["B"]["h"] == 2.0 and out["B"]["residual_allocation_columns"] == []


def source(spark):
    base = {"Distributor": "D", "Customer Name": " Ann ", "City": "x", "Country": "c", "Latitude": "1", "Longitude": "2", "Channel": "k", "Sub-channel": None, "Product Name": "p", "Product Class": "q",
            "Quantity": "2", "Price": "5", "Sales": "10", "Month": "January", "Year": "2019", "Name of Sales Rep": "r", "Manager": "m", "Sales Team": "t"}
    rows = [base, base, {**base, "Month": "nonsense"}, {**base, "Quantity": "-2", "Sales": "-10"}]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in base))


def test_csv_round_trip_normalises(spark, tmp_path):
    raw = source(spark)
    path = SW.write_csv(raw, str(tmp_path), "raw")
    back = SR.read_csv(spark, path, raw.columns)
    report = {r["check_name"]: r["value"] for r in SR.load_commercial(back)[1].collect()}
    assert (report["raw_rows"], report["duplicates_removed"], report["invalid_rows_removed"], report["clean_rows"], report["nonpositive_sales_retained"]) == (4, 1, 1, 2, 1)
    n = SR.normalise_source(back).collect()
    assert len({r["source_row_id"] for r in n}) == 2 and all(r["customer_name"] == "Ann" and r["transaction_date"].month == 1 for r in n)
    with pytest.raises(ValueError, match="missing columns"):
        SR.load_commercial(back.drop("Sales"))


def test_manifest_layers_and_checks(spark, tmp_path):
    t = spark.range(30)
    paths = SW.write_layers(str(tmp_path), {"a": t, "rep_master": t}, {"a": t, "rep_master": t}, {"truth": t}, ["rep_master"])
    assert len(paths) == 4
    man = SW.output_manifest(spark, {"a": paths[0]}).first()
    assert man["rows"] == 30 and man["bytes"] > 0
    samples = SW.write_samples({"a": t}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(samples[0]).count() == 25
    status = {r["output"]: r["status"] for r in SW.check_outputs(spark, {"a": paths[0], "gone": str(tmp_path / "gone.parquet")}).collect()}
    assert status["a"] == "pass" and status["gone"].startswith("fail")


def test_injection_keeps_training_rows_and_traces_changes(spark):
    df = spark.createDataFrame([(f"o{i}", "train" if i < 40 else "test", 100.0 + i, "synthetic_normal") for i in range(100)], "row_id string, split string, total_sales double, data_lineage string")
    usable = [p for p in I.PERTURBATIONS if p[1] in df.columns]
    bad = I.inject(df, "row_id", "split", 0.1, 7, usable).frame
    with pytest.raises(ValueError, match="no column"):
        I.inject(df, "row_id", "split", 0.1, 7)
    assert bad.filter("injected_anomaly_flag").groupBy("split").count().collect()[0].asDict() == {"split": "test", "count": 6}
    changes = I.changed_rows(df, bad.select(*df.columns), ["row_id"], "t")
    assert changes.count() == 6
    marked = I.repair_provenance(bad.select(*df.columns), changes, ["row_id"])
    assert marked.filter("data_lineage = 'synthetic_injected'").count() == 6
    assert I.severity_counts(10, {"low": .5, "medium": .3, "high": .2}) == {"low": 5, "medium": 3, "high": 2}


def test_sustained_changes_take_two_months_and_keep_the_budget(spark):
    rows = [(f"{g}|{m}", g, f"2020-{m + 1:02d}-01", "train" if m < 3 else "test", 10.0 + m, 0.5, 100.0) for g in "abcdefgh" for m in range(12) if not (g == "c" and m % 2)]
    df = spark.createDataFrame(rows, "row_id string, g string, date string, split string, total_sales double, product_concentration double, severity double").withColumn("date", F.to_date("date"))
    types = [p for p in I.PERTURBATIONS if p[1] in df.columns]
    for fraction in (0.01, 0.2, 0.5, 1.0):
        got = I.inject(df.drop("severity"), "row_id", "split", fraction, 3, types, series=["g"])
        n = df.filter("split = 'test'").count()
        audit = got.audit.toPandas()
        assert len(audit) == audit.row_id.nunique() == max(1, int(np.ceil(n * fraction - 1e-9))) and set(audit.split) == {"test"}
        kind = {t: m for t, _, m in types}
        audit["mode"] = audit.anomaly_type.map(kind)
        lasting = audit[audit["mode"].isin(I.SUSTAINED)]
        first, second = (lasting[lasting.month == k] for k in (1, 2))
        assert len(first) == len(second)
        place = lambda part: sorted((r.row_id.split("|")[0], int(r.row_id.split("|")[1]) + (1 if r.month == 1 else 0), r.anomaly_type, r.severity) for r in part.itertuples())
        assert place(first) == place(second)
        if fraction < 0.5:
            assert all((int(r.split("|")[1]) + 1) % 3 == 0 for r in audit[audit["mode"] == "quarter"].row_id)
        frame = got.frame.toPandas().set_index("row_id")
        assert frame.injected_anomaly_flag.sum() == len(audit)
        for r in audit.itertuples():
            assert frame.loc[r.row_id, r.affected_feature] == r.injected_value and frame.loc[r.row_id, "anomaly_type"] == r.anomaly_type
            if r.mode == "sequence":
                assert r.injected_value == pytest.approx(r.original_value * (0.05 if r.month == 1 else 1 + 2 * I.STRENGTH[r.severity]))


def test_schema_adaptation_solves_the_missing_measure(spark):
    rows = lambda data, schema: SR.adapt_schema(spark.createDataFrame(data, schema))
    out, origin = rows([("6", "2", "Jan", "2024", " x "), ("6", "0", "13", "2024", None)], "Revenue string, Qty string, Month string, Year string, `Sales-Channel` string")
    got = sorted((r["sales"], r["quantity"], r["price"], r["date"], r["channel"], r["city"]) for r in out.collect() if r["date"])
    assert got == [(6.0, 2.0, 3.0, JAN, "x", "Unknown City")]
    assert out.filter("date IS NULL").select("price", "channel").first() == (None, "Unknown Channel")
    assert out.select("customer").distinct().count() == 2
    assert origin["sales"] == ("source", "Revenue") and origin["price"][0] == "derived" and origin["customer"][0] == "generated" and origin["city"][0] == "filled"
    out, origin = rows([(5.0, 1.0, "2024-02-09", "a")], "amount double, sales double, `Transaction Date` string, account string")
    assert out.select("sales", "amount", "date", "customer", "quantity", "price").first() == (1.0, 5.0, FEB, "a", None, None)
    with pytest.raises(ValueError):
        rows([(1.0, "2024")], "price double, year string")
    with pytest.raises(ValueError):
        rows([(1.0,)], "sales double")


def test_rank_shift_pairs_units_and_averages_ties(spark):
    table = lambda rows: spark.createDataFrame(rows, "rep string, v double")
    clean, after = table([("a", 90.0), ("b", 90.0), ("c", 50.0), ("d", None), (None, 10.0), ("x", 5.0)]), table([("a", 90.0), ("b", 130.0), ("c", 101.0), ("d", 4.0), (None, 10.0), ("y", 7.0)])
    shifts = C.rank_shift(clean, after, ["rep"], "v")
    got = {r["rep"]: (r["clean_rank"], r["injected_rank"], r["rank_shift"]) for r in shifts.collect()}
    assert got == {"a": (1.5, 3.0, -1.5), "b": (1.5, 1.0, 0.5), "c": (3.0, 2.0, 1.0), None: (4.0, 4.0, 0.0), "d": (None,) * 3, "x": (None,) * 3, "y": (None,) * 3}
    rows = {r["threshold"]: r for r in C.rank_sensitivity(shifts, [85.0, 100.0, 500.0]).collect()}
    assert (rows[85.0]["clean_above"], rows[85.0]["injected_above"], rows[85.0]["both_above"]) == (2, 3, 2) and rows[85.0]["overlap"] == pytest.approx(2 / 3)
    assert rows[100.0]["overlap"] == 0.0 and rows[500.0]["overlap"] is None and rows[85.0]["paired_units"] == 4 and rows[85.0]["max_abs_shift"] == 1.5
    assert rows[85.0]["spearman"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [3, 1, 2, 4])[0, 1])
    same = table([("a", 1.0), ("b", 1.0)])
    assert C.rank_sensitivity(C.rank_shift(same, same, ["rep"], "v"), [1.0]).first()["spearman"] is None
    assert C.rank_shift(clean.limit(0), after.limit(0), ["rep"], "v").count() == 0


def test_scenario_rows_count_support_that_no_record_carries(spark):
    cal = lambda rows: spark.createDataFrame([(f"CAP{i}", f"r{i}", "t", JAN, u, 10.0, g) for i, (u, g) in enumerate(rows)],
                                             "capacity_record_id string, rep_id string, territory_id string, period date, utilization_pct double, required_total_hours double, priority_customer_coverage_gap double")
    clean = cal([(50.0, float(i)) for i in range(21)])
    after = cal([(150.0 if i < 3 else 50.0, i + (30.0 if i in (0, 4) else 0.0)) for i in range(21)])
    schema = "truth_id string, scenario string, record_ids array<string>, period date, rep_id string, territory_id string, required_total_hours_truth double"
    truth = spark.createDataFrame([("1", "over", ["CAP0"], JAN, "r0", None, None), ("2", "over", ["CAP9"], JAN, "r9", None, None), ("3", "over", ["gone"], FEB, "nobody", None, None),
                                   ("4", "under", ["CAP0", "CAP4", "gone"], JAN, "r0", None, None), ("5", "under", ["CAP7"], JAN, "r7", None, None)], schema)
    rows = {r["scenario"]: r for r in C.scenario_type_rows(clean, after, truth, "over", "under").collect()}
    take = lambda r: tuple(r[c] for c in ("observations", "positive_support", "overall_truth_support", "selected", "captured", "false_positives"))
    assert take(rows["over"]) == (21, 3, 3, 3, 1, 2) and rows["over"]["recall"] == pytest.approx(1 / 3)
    assert take(rows["under"]) == (21, 3, 2, 3, 2, 1) and rows["under"]["threshold"] == 19.0 and rows["under"]["precision"] == pytest.approx(2 / 3)
    none = {r["scenario"]: r for r in C.scenario_type_rows(clean, clean, truth.limit(0), "over", "under").collect()}
    assert all(r["recall"] is None and r["support_status"] == "no_support" for r in none.values())


def test_returns_follow_their_moved_order(spark):
    orders = spark.createDataFrame([("l1", FEB), ("l1", JAN), ("l2", JAN)], "order_line_id string, order_date date")
    returns = spark.createDataFrame([("l1", "r", JAN, JAN, JAN, 0, False), ("l2", "r", JAN, FEB, JAN, 0, False), ("gone", None, None, JAN, JAN, 0, True)],
                                    "order_line_id string, rep_id string, payout_period date, return_date date, original_order_date date, days_after_order int, after_incentive_payout_flag boolean")
    payouts = spark.createDataFrame([("r", JAN, JAN), ("r", JAN, JAN)], "rep_id string, payout_period date, payout_date date")
    got = {r["order_line_id"]: r for r in O.repair_return_dates(returns, orders, payouts).collect()}
    assert len(got) == 3 and (got["l1"]["return_date"] - FEB).days == 1 and got["l1"]["days_after_order"] == 1 and got["l1"]["after_incentive_payout_flag"]
    assert got["l2"]["return_date"] == FEB and got["l2"]["original_order_date"] == JAN and got["l2"]["days_after_order"] == (FEB - JAN).days
    assert got["gone"]["original_order_date"] is None and got["gone"]["return_date"] == JAN and not got["gone"]["after_incentive_payout_flag"]
