"""Steps that many queries share: the ledger's joins, written tables and distinct counts."""

import os

from pyspark.sql import functions as F

from quotalens.queries import planning as Q
from quotalens.queries.base import ledger
from quotalens.session import checkpointed, shared_folder

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_compact_and_keep_rows_and_types(spark):
    folder = shared_folder(spark)
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)
    df = spark.range(200_000).select((F.col("id") % 100).alias("a"), F.lit(0.0).alias("b c"), F.lit(None).alias("nothing"), F.lit("the same text").alias("d"))
    before = size()
    back = checkpointed(df)
    assert size() - before < 1_000_000
    assert back.dtypes == df.dtypes and back.count() == 200_000
    assert back.groupBy("a", "b c", "nothing", "d").count().exceptAll(df.groupBy("a", "b c", "nothing", "d").count()).isEmpty()


def test_a_large_table_in_small_files_is_not_broadcast(spark):
    many = checkpointed(spark.range(1_500_000).select((F.col("id") % 3).alias("k"), F.lit(1.0).alias("v")))
    assert "BroadcastHashJoin" not in plan_text(spark.range(10).withColumnRenamed("id", "k").join(many, "k", "left"))


def test_ledger_moves_no_line_for_names_of_nations(spark):
    """Suppliers, nations and regions are joined as they are read, whose sizes are known, hence broadcast."""
    text = plan_text(ledger(spark, SF).select("rep_id", "team", "manager", "city", "country", "sales"))
    assert text.count("BroadcastHashJoin") >= 5


def test_distinct_counts_without_a_copy_of_each_row_per_count(spark):
    led = ledger(spark, SF)
    names = Q.DISTINCT
    for got, keys in ((Q.aggregate(led, [*Q.UNIT, "period"]), [*Q.UNIT, "period"]), (Q.rep_aggregate(led, "rep_id", [*Q.UNIT, "period"]), ["rep_id", *Q.UNIT, "period"])):
        assert "Expand" not in plan_text(got)
        want = led.groupBy(*keys).agg(F.sum("sales").alias("total_sales"), F.count(F.lit(1)).cast("double").alias("transaction_count"), *[F.count_distinct(c).cast("double").alias(n) for n, c in names.items()])
        assert got.select(*want.columns).exceptAll(want).isEmpty() and want.count() == got.count()


def test_a_customer_meets_the_facts_of_its_months_without_moving_the_months(spark):
    """No exchange of the grid: nothing is dealt by customer and month above the rows laid out per month."""
    from quotalens.operators import capacity as C
    tx = spark.createDataFrame([(1, "1997-01-01", 7, "x"), (1, "1997-03-01", 7, "x"), (2, "1997-03-01", 7, "x"), (2, "1997-03-01", 7, "x"), (2, None, 8, "x")], "rep_id long, period string, customer_id long, city string").withColumn("period", F.to_date("period"))
    visits = C.prepare_visits(tx.select("rep_id", "period", "customer_id", F.col("city").alias("territory_id")))
    customers = spark.createDataFrame([(7, "x", "high"), (8, "x", "low")], "customer_id long, territory_id string, customer_priority string")
    reps = spark.createDataFrame([(1, "x"), (2, "x")], "rep_id long, territory_id string")
    owned = C.customer_owners(tx.filter("period IS NOT NULL"), visits, customers, reps)
    covered = C.coverage(owned, visits)
    rows = {(r["customer_id"], str(r["period"])): (r["rep_id"], r["observed_visit_count"], r["servicing_rep_count"]) for r in covered.filter("customer_id = 7").collect()}
    assert rows[(7, "1997-01-01")] == (1, 1.0, 1.0) and rows[(7, "1997-02-01")][1:] == (0.0, 0.0) and rows[(7, "1997-03-01")] == (2, 3.0, 2.0)
    text = plan_text(owned)
    assert "Exchange" not in text[:text.index("Generate explode")]
