"""Lines that many steps read are written once; a day's probes and facts are grouped together."""

import datetime as dt

from pyspark.sql import functions as F

from quotalens.operators import joins as J
from quotalens.queries.joins import return_linkage_as_of
from quotalens.sources import readers as R

SF = "/root/testdata/sf0.001"


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_linkage_reads_the_ledger_as_written(spark):
    plan = text(return_linkage_as_of(spark, SF))
    assert "lineitem" not in plan and "orders.parquet" not in plan


def test_latest_before_moves_no_fact_twice_for_its_days(spark):
    day = lambda d: dt.date(2000, 1, d) if d else None
    facts = spark.createDataFrame([(1, day(3), 5, "a"), (1, day(3), 7, "b"), (1, day(9), 1, "c"), (None, day(2), 4, "d"), (2, None, 9, "e")], "k long, day date, tie long, what string")
    probes = spark.createDataFrame([(1, day(2)), (1, day(3)), (1, day(8)), (1, day(20)), (None, day(5)), (2, day(1)), (3, day(1))], "k long, day date")
    got = J.latest_before(probes, facts, ["k"], "day", "tie", ["tie", "what"], "hit")
    joins = text(got).count("Join")
    assert {(r["k"], r["day"]): r["hit"] and r["hit"]["what"] for r in got.collect()} == {
        (1, day(2)): None, (1, day(3)): "b", (1, day(8)): "b", (1, day(20)): "c", (None, day(5)): "d", (2, day(1)): "e", (3, day(1)): None}
    assert joins == 1


def test_a_load_report_counts_copies_in_one_grouping(spark):
    columns = list(R.SOURCE_COLUMNS)
    line = {c: "x" for c in columns} | {c: "1" for c in ("Latitude", "Longitude", "Quantity", "Price", "Sales")} | {"Month": "March", "Year": "2001", "Country": "Land"}
    rows = [line] * 3 + [line | {"Sales": "-2"}] + [line | {"Price": "n/a"}] * 2 + [line | {"Sub-channel": None}]
    raw = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    clean, report = R.load_commercial(raw)
    found = {r["check_name"]: r["value"] for r in report.collect()}
    assert [found[c] for c in ("raw_rows", "unique_rows", "clean_rows", "duplicates_removed", "invalid_rows_removed", "sales_total", "nonpositive_sales_retained")] == [7, 4, 3, 3, 1, 0, 1]
    assert found["rows__Land"] == clean.count() == 3 and "LocalTableScan" not in text(report) and "ExistingRDD" not in text(report)
