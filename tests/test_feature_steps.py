"""Steps of the feature stores: history windows, medians, distinct counts, members of a grain, peer statistics."""

import numpy as np
from pyspark.sql import functions as F

from quotalens.operators import aggregates as A, features as X, history as H, peers as P, ranking as R
from quotalens.session import checkpointed


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_of_several_metrics_sorts_its_rows_once(spark):
    rows = [(rep, f"20{17 + m // 12}-{m % 12 + 1:02d}-01", float((rep * 7 + m * 13) % 29), float(m * rep)) for rep in range(3) for m in range(20) if (rep + m) % 7]
    df = spark.createDataFrame(rows, "rep long, period string, x double, y double").withColumn("period", F.to_date("period"))
    both = H.metric_history(df, ["x", "y"], ["rep"], "period")
    assert plan_text(both).count("+- Sort ") == 1 and plan_text(both).count("Exchange hashpartitioning") == 1
    apart = H.metric_history(H.metric_history(df, "x", ["rep"], "period"), "y", ["rep"], "period")
    assert both.columns == apart.columns and both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty()


def test_median_and_deviation_of_an_array(spark):
    lists = [[], [3.0], [5.0, 1.0], [9.0, -2.0, 4.0], [1.0, 1.0, 8.0, 2.0, 100.0, -7.5]]
    df = spark.createDataFrame([(x,) for x in lists], "v array<double>")
    got = df.select("v", H.array_median(F.col("v")).alias("median"), H.array_mad(F.col("v")).alias("mad")).collect()
    for r in got:
        want = (float(np.median(r.v)), float(np.median(np.abs(np.array(r.v) - np.median(r.v))))) if r.v else (None, None)
        assert (r.median, r["mad"]) == want


def test_grain_counts_distinct_values_without_a_copy_of_each_row_per_count(spark):
    df = spark.createDataFrame([(1, "a", "x", 2.0, 1.0, 5.0), (1, "a", "y", 4.0, 1.0, 7.0), (1, "b", None, 1.0, 1.0, 9.0), (None, "b", None, 3.0, 1.0, 4.0)],
                               "rep long, customer string, city string, sales double, quantity double, price double")
    out = A.sales_grain(df, ["rep"], {"customers": "customer", "cities": "city"}, dispersion={"spread": "price"})
    assert "Expand" not in plan_text(out)
    assert out.columns == ["rep", "total_sales", "total_quantity", "transaction_count", "average_price", "median_price", "customers", "cities", "spread"]
    rows = {r.rep: r for r in out.collect()}
    assert (rows[1].total_sales, rows[1].customers, rows[1].cities, rows[1].median_price) == (7.0, 2, 2, 7.0)
    assert (rows[None].transaction_count, rows[None].customers, rows[None].cities) == (1, 1, 0)


def test_a_quantile_needs_only_the_rows_near_it(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=3001), "b": rng.integers(0, 3, 400).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 9.0]), None: rng.normal(size=50)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)], "g string, x double")
    for slack in (0.02, -0.2):  # bounds that miss the middle are found out by the counts
        got = {r.g: r.middle for r in R.middle_quantile(df, ["g"], "x", "middle", slack=slack).collect()}
        assert got == {g: float(np.median(xs)) for g, xs in groups.items()}
    assert R.middle_quantile(df, [], "x", "middle").first().middle == float(np.median(np.concatenate(list(groups.values()))))


def test_members_of_a_grain_move_its_rows_once(spark):
    lines = [(1, "p", "t", "c1", 5.0, "n1", "k"), (1, "p", "t", "c1", -5.0, "n2", None), (1, "p", "t", "c2", 8.0, "n1", None), (2, "p", None, None, 3.0, None, "k")]
    df = spark.createDataFrame(lines, "rep_id long, product_name string, territory_id string, customer string, sales double, country string, channel string").withColumns(
        {"date": F.to_date(F.lit("2001-01-01")), "quantity": F.lit(2.0), "price": F.lit(None).cast("double"), "latitude": F.col("sales"), "longitude": F.lit(1.0), "subchannel": F.col("channel"),
         "city": F.col("territory_id"), "product_class": F.col("product_name"), "sales_manager": F.lit("m"), "sales_team": F.lit("s")})
    out = X.legacy_grain(checkpointed(df))
    assert plan_text(out).count("Exchange hashpartitioning") == 1
    rows = {r.rep_id: r for r in out.collect()}
    one, two = rows[1], rows[2]
    assert (one.total_sales, one.total_quantity, one.average_price, one.unique_customers, one.transaction_count) == (8.0, 6.0, 8.0 / 6.0, 2, 3)
    assert (one.country, one.channel, one.customer_concentration, one.latitude) == ("n1", "k", 1.0, 8.0 / 3)
    assert (two.country, two.unique_customers, two.customer_concentration, two.total_sales) == (None, 0, 1.0, 3.0)


def test_peer_statistics_meet_the_rows_without_moving_them(spark):
    values = [(i, "x" if i % 3 else "y", float((i * 37) % 11)) for i in range(40)] + [(99, "z", 5.0)]
    df = spark.createDataFrame(values, "id long, k string, v double")
    out = P.with_peer_means(df, df, "v", {"k": ["k"]}, 3)
    assert "Exchange hashpartitioning" not in plan_text(out)
    everything = [v for _, _, v in values]
    for r in out.collect():
        own = [v for _, k, v in values if k == r.k]
        cohort = own if len(own) >= 3 else everything
        assert (r["_peer_median"], round(r["_peer_mean"], 9), round(r["_peer_std"], 9)) == (float(np.median(cohort)), round(float(np.mean(cohort)), 9), round(float(np.std(cohort, ddof=1)), 9))


def test_cohort_medians_meet_the_rows_without_moving_them(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3], float((i * 17) % 23)) for i in range(60)], "id long, k string, v double")
    out = P.cohort_relative(df, "id", ["v"], {"k": ["k"]})
    assert "Exchange hashpartitioning" not in plan_text(out)
    value = {r.id: r for r in df.collect()}
    for r in out.collect():
        own = float(np.median([x.v for x in value.values() if x.k == value[r.id].k]))
        assert abs(r.relative - (value[r.id].v - own) / max(abs(own), 1.0)) < 1e-12
