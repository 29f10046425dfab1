import numpy as np
import pytest

from quotalens.operators import kmeans_starts as KS

SCHEMA = "id string, vector array<double>"


def plain(x, k, rng):
    """One run by hand: k-means++ seeds, then Lloyd."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        gap = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.concatenate([c, x[[rng.choice(len(x), p=gap / gap.sum())]]])
    for _ in range(100):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_many_starts_reach_the_best_of_single_runs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in [(0, 0), (4, 0), (0, 4), (4, 4), (9, 9)]])
    df = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], SCHEMA)
    models, trials = KS.fit_kmeans_starts(df, "id", [3, 5], starts=20)
    rows = trials.toPandas()
    assert len(rows) == 40 and rows.settled.all() and (rows[rows.chosen].groupby("k").size() == 1).all()
    for k, model in models.items():
        best = min(plain(x, k, np.random.default_rng(s)) for s in range(20))
        assert model.inertia <= best * (1 + 1e-6) and model.inertia == pytest.approx(rows[rows.k == k].inertia.min(), rel=1e-9)
        near = ((x[:, None] - np.array(model.centers)[None]) ** 2).sum(2)
        assert near.min(1).sum() == pytest.approx(model.inertia)
        for j, center in enumerate(model.centers):
            assert x[near.argmin(1) == j].mean(0) == pytest.approx(center, abs=1e-3)
    again, _ = KS.fit_kmeans_starts(df.repartition(7), "id", [3, 5], starts=20)
    assert np.allclose(again[5].centers, models[5].centers)


def test_fewer_distinct_vectors_than_centres(spark):
    df = spark.createDataFrame([(f"r{i}", [float(i % 2), 0.0]) for i in range(30)], SCHEMA)
    models, trials = KS.fit_kmeans_starts(df, "id", [1, 4], starts=3)
    assert sorted(models[4].centers) == [[0.0, 0.0], [1.0, 0.0]] and models[4].inertia == 0.0 and models[1].inertia == pytest.approx(7.5)
    one = spark.createDataFrame([("a", [1.0])], SCHEMA)
    assert KS.fit_kmeans_starts(one, "id", [2], starts=1)[0][2].centers == [[1.0]]
    with pytest.raises(ValueError, match="no rows"):
        KS.fit_kmeans_starts(df.limit(0), "id", [2], starts=2)
