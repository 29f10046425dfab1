import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotalens.operators import joins as J, ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value holds a third of them."""
    rng = np.random.default_rng(5)
    value = np.where(rng.random(3000) < 0.33, 7.0, np.round(rng.normal(0, 50, 3000), 1))
    group = np.where(rng.random(3000) < 0.8, "hot", "cold")
    pdf = pd.DataFrame({"id": np.arange(3000), "g": group, "v": value})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("ranges", [None, 3, 40])
def test_positions_match_sorting_for_any_number_of_ranges(skewed, ranges):
    df, pdf = skewed
    got = R.positions(df, ["g"], "v", ranges=ranges).toPandas()
    want = pdf.groupby(["g", "v"]).size().rename("n").reset_index()
    want["below"] = want.groupby("g").n.cumsum() - want.n
    both = got.merge(want, on=["g", "v"])
    assert len(both) == len(want) == len(got)
    assert (both.n_equal == both.n).all() and (both.n_below == both.below).all()
    assert (both.n_total == both.g.map(pdf.g.value_counts())).all()


def test_quantiles_follow_the_linear_rule(skewed):
    df, pdf = skewed
    got = {r["g"]: r for r in R.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], part.v.quantile([0.25, 0.5, 0.95]))


def test_percent_rank_averages_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None)], "id int, v double")
    got = {r["id"]: r["p"] for r in R.percent_rank_average(df, [], "v", "p").collect()}
    want = pd.Series([5.0, 5.0, 9.0, None]).rank(pct=True)
    assert got[4] is None and np.allclose([got[1], got[2], got[3]], want[:3])


@pytest.mark.parametrize("ranges", [None, 13])
def test_row_numbers_and_budget_with_massive_ties(skewed, ranges):
    df, pdf = skewed
    got = R.row_numbers(df, "v", "id", "rn", ranges=ranges).toPandas().sort_values("rn")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got.id.tolist() == want.id.tolist() and got.rn.tolist() == list(range(1, 3001))
    flagged = R.top_fraction(df, "v", "id", 0.05, "f", ["g"]).filter("f").toPandas()
    for g, part in pdf.groupby("g"):
        k = int(np.ceil(len(part) * 0.05))
        assert set(flagged[flagged.g == g].id) == set(part.sort_values(["v", "id"], ascending=[False, True]).id[:k])


def test_budget_of_equal_scores_and_small_cases(spark):
    equal = spark.createDataFrame([(i, 1.0) for i in range(101)], "id int, s double")
    assert R.top_fraction(equal, "s", "id", 0.05, "f").filter("f").count() == 6
    ties = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.8), (3, 0.1)], "id int, s double")
    assert [r["id"] for r in R.top_fraction(ties, "s", "id", 0.5, "f").filter("f").orderBy("id").collect()] == [0, 1]


def test_interpolation_carries_neighbours_over_ranges(spark):
    ref = spark.createDataFrame([(float(x), float(x * x)) for x in range(0, 40, 4)], "x double, y double")
    probes = spark.createDataFrame([(i, i / 3.0 - 5) for i in range(150)], "id int, x double")
    got = J.interpolate(probes, ref, [], "x", "y", "z").orderBy("id").toPandas()
    xs = np.arange(0, 40, 4)
    assert np.allclose(got.z, np.interp(got.x, xs, xs * xs))


def test_repeated_key_fails_the_join(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(Exception, match="repeated key"):
        J.checked_left_join(left, right, ["k"]).collect()


def test_with_scalars_rejects_more_than_one_row(spark):
    df = spark.range(3)
    with pytest.raises(Exception):
        R.with_scalars(df, spark.range(2).select(F.col("id").alias("x"))).collect()


def test_cohorts_sorted_by_a_task_and_cohorts_of_any_size_agree(spark, skewed):
    from quotalens.operators import peers as P

    df = skewed[0].withColumn("h", F.pmod("id", F.lit(7)).cast("string")).withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    levels = {"fine": ["g", "h"], "group": ["g"], "all": []}
    several = lambda rows: sorted(map(tuple, P.peer_statistics(df, "id", ["v"], levels, {"fine": 100, "group": 500, "all": 1}, sorted_rows=rows).collect()))
    apart, whole = several(10**9), several(200)
    assert len(whole) == 3000 and {r[-1] for r in whole} >= {"fine", "group"}
    for a, b in zip(apart, whole):
        assert a[:2] == b[:2] and a[-1] == b[-1] and np.allclose([x if x is not None else -1 for x in a[2:-1]], [x if x is not None else -1 for x in b[2:-1]])
    pdf = df.toPandas()
    hot = pdf[pdf.g == "hot"]
    row = {r[0]: r for r in whole}[int(hot[(hot.h == "3") & hot.v.notna()].id.iloc[0])]
    own = hot[hot.h == "3"].v.dropna()
    assert np.isclose(row[3], own.median()) and np.isclose(row[4], (own - own.median()).abs().median())
    assert np.isclose(row[6], own.rank(pct=True)[row[0]])
