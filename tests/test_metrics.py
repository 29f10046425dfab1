import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame([(i, bool(y), float(s), bool(p)) for i, (y, s, p) in enumerate(rows)], "id int, y boolean, s double, p boolean")


def test_confusion_hand_checked(spark):
    df = frame(spark, [(1, .9, 1), (1, .4, 0), (0, .8, 1), (0, .1, 0)])
    r = M.evaluate(df, [], "y", "s", "id", predicted="p").first()
    assert [r[c] for c in ("precision", "recall", "f1", "f2", "specificity")] == [0.5] * 5
    assert r["roc_auc"] == 0.75 and r["pr_auc"] == pytest.approx(5 / 6)


def test_ranking_hand_checked(spark):
    df = frame(spark, [(1, .9, 0), (0, .8, 0), (1, .4, 0), (0, .1, 0)])
    rows = {r["review_fraction"]: r for r in M.ranking_metrics(df, [], "y", "s", "id", (0.25, 0.5)).collect()}
    assert (rows[0.25]["precision"], rows[0.25]["recall"], rows[0.25]["lift"]) == (1.0, 0.5, 2.0)
    assert rows[0.5]["precision"] == 0.5


def test_ensembles(spark):
    long = spark.createDataFrame([(0, "a", .1), (1, "a", .9), (0, "b", .3), (1, "b", .7)], "id int, m string, p double")
    get = lambda kind: [r["x"] for r in M.ensemble_scores(long, ["id"], "m", "p", {"a": 3.0, "b": 1.0}, kind, "x").orderBy("id").collect()]
    assert get("weighted") == pytest.approx([.15, .85]) and get("maximum") == [.3, .9]
    with pytest.raises(ValueError):
        M.ensemble_scores(long, ["id"], "m", "p", {"a": -1.0}, "weighted", "x")


def test_calibrator_is_increasing_and_bounded(spark):
    train = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 2, 3)], "raw double")
    cal = M.fit_calibrator(train, [], "raw")
    probes = spark.createDataFrame([(float(x),) for x in (-50, -1, 0, .5, 1, 2.5, 3, 4, 100, 1000)], "raw double")
    p = [r["p"] for r in M.calibrate(probes, cal, [], "raw", "p").orderBy("raw").collect()]
    assert all(a < b for a, b in zip(p, p[1:])) and 0 < p[0] and p[-1] < 1


def test_adjusted_rand_of_equal_and_independent_labels(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 10, i % 2) for i in range(60)], "a int, b int, c int")
    assert M.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert abs(M.adjusted_rand(df, "a", "c").first()[0]) < 0.1


def test_selection_weights_must_sum_to_one(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "model string, recall double")
    with pytest.raises(ValueError):
        M.weighted_selection(df, "model", {"recall": 0.7})
    rows = M.weighted_selection(df, "model", {"recall": 1.0})
    assert M.selected_model(rows, "model").filter(F.col("selected")).first()["model"] == "y"


def test_ecdf(spark):
    ref = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 5)], "v double")
    got = [r["e"] for r in M.ecdf_score(spark.createDataFrame([(0.,), (2.,), (9.,)], "v double"), ref, [], "v", "e").orderBy("v").collect()]
    assert np.allclose(got, [0, .75, 1])
