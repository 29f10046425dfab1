import numpy as np
from pyspark.sql import functions as F

from quotalens.operators import clustering as K, forest as FO, metric_tree as T, preprocess as PP, reconstruction as RC


def cloud(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, .35, (n // 4, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0))] + [rng.uniform(-6, 9, (n - 3 * (n // 4), 3))])
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")


def test_neighbour_distance_equals_brute_force_over_many_blocks(spark):
    x, df = cloud(spark)
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 4]
    got = K.kth_neighbor_distance(df, "id", 5, leaf_rows=40).orderBy("id").toPandas()
    assert np.allclose(got.distance, want)


def test_dbscan_equals_brute_force(spark):
    x, df = cloud(spark)
    eps, least = .5, 6
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), 10**6)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], 10**6).min(1), 10**6)
        if (new == label).all():
            break
        label = new
    d = np.where(core[None], np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.inf)
    border = ~core & (d.min(1) <= eps)
    label = np.where(border, label[d.argmin(1)], label)
    got = K.dbscan(df, "id", eps, least, leaf_rows=40).orderBy("id").toPandas()
    assert (got.core.to_numpy() == core).all()
    assert (got.label.fillna(10**6).astype(int).to_numpy() == label).all()


def test_pca_matches_numpy_and_forest_finds_the_outlier(spark):
    x, df = cloud(spark)
    model = RC.fit_pca(df, k=2)
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    want = np.square(centred - centred @ v[:2].T @ v[:2]).mean(1)
    assert np.allclose(model.score(df).orderBy("id").toPandas().raw_score, want)
    far = spark.createDataFrame([(9999, [40.0, 40.0, 40.0])], "id long, vector array<double>")
    scored = FO.fit_isolation_forest(df, "id", trees=40, samples=64).score(df.unionByName(far)).toPandas()
    assert scored.sort_values("raw_score").id.iloc[-1] == 9999 and scored.raw_score.between(0, 1).all()


def test_every_tree_draws_its_exact_number_of_rows(spark):
    _, df = cloud(spark)
    n = df.count()
    for samples in (2, 64, n, 10 * n):
        forest = FO.fit_isolation_forest(df, "id", trees=30, samples=samples)
        assert len(forest.trees) == 30 and {int(t[0, 4]) for t in forest.trees} == {min(samples, n)}


def test_constant_feature_keeps_scale_one(spark):
    train = spark.createDataFrame([(float(i), 0.0) for i in range(9)], "a double, b double")
    p = PP.fit_preprocessor(train, ["a", "b"])
    out = p.transform(spark.createDataFrame([(4.0, 3.0), (None, None)], "a double, b double")).collect()
    assert out[0]["vector"] == [0.0, 3.0] and out[1]["vector"] == [0.0, 0.0]
    again = PP.Preprocessor.from_table(p.to_table(spark))
    assert again.parameters == p.parameters and again.features == ["a", "b"]


def by_hand(x, eps, least):
    """Labels (10**6: noise) and core flags."""
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (gaps <= eps).sum(1) >= least
    label = np.where(core, np.arange(len(x)), 10**6)
    while True:
        new = np.where(core, np.where((gaps <= eps) & core[None], label[None], 10**6).min(1), 10**6)
        if (new == label).all():
            break
        label = new
    d = np.where(core[None], gaps, np.inf)
    return np.where(~core & (d.min(1) <= eps), label[d.argmin(1)], label), core


def test_copies_are_one_weighted_vector_and_whole_nodes_are_not_measured(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile([[1.0, 1.0]], (300, 1)), rng.normal(0, .02, (200, 2)), rng.normal((3, 0), .02, (150, 2)), rng.uniform(-4, 6, (40, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)
    got = K.kth_neighbor_distance(df, "id", 310, leaf_rows=60).orderBy("id").toPandas()
    assert np.allclose(got.distance, want[:, 309])
    assert np.allclose(K.kth_neighbor_distance(df, "id", 5000, leaf_rows=400).orderBy("id").toPandas().distance, want[:, -1])
    for eps, least in ((.5, 5), (1e-6, 250)):
        label, core = by_hand(x, eps, least)
        got = K.dbscan(df, "id", eps, least, leaf_rows=60).orderBy("id").toPandas()
        assert (got.core.to_numpy() == core).all()
        assert (got.label.fillna(10**6).astype(int).to_numpy() == label).all()
    work = K.neighbor_work(df, "id", 4, leaf_rows=30).first()
    assert work.share < 0.5 and work.measured > 0


def test_new_rows_take_the_nearest_core(spark):
    x, df = cloud(spark, 240)
    fit, new = x[::2], x[1::2]
    eps, least = .6, 6
    label, core = by_hand(fit, eps, least)
    gaps = np.sqrt(((new[:, None] - fit[None]) ** 2).sum(2))
    near = np.where(core[None], gaps, np.inf)
    want = np.where(near.min(1) <= eps, 2 * label[near.argmin(1)], -1)
    curve = np.sort(np.sort(np.sqrt(((fit[:, None] - fit[None]) ** 2).sum(2)), 1)[:, least - 1])
    d = np.sort(gaps, 1)[:, least - 1]
    base = np.searchsorted(curve, d, "right") / len(curve)
    model = K.fit_dbscan(df.filter("id % 2 = 0"), "id", eps, least, leaf_rows=40)
    rows = df.filter("id % 2 = 1").withColumnRenamed("id", "row").unionByName(spark.createDataFrame([(99999, None)], "row long, vector array<double>"))
    got = model.score(rows.filter("vector IS NOT NULL"), model.curve(), "row").orderBy("row").toPandas()
    assert (got.label.fillna(-1).astype(int).to_numpy() == want).all()
    assert np.allclose(got.anomaly_score, np.where(want < 0, .75 + .25 * base, .75 * base))
    assert np.allclose(got.raw_score, np.where(want < 0, .75, 0) + .25 * d / (1 + d))
    assert model.predict(rows, "row").filter("row = 99999").first().label is None
    nothing = K.fit_dbscan(df.filter("id < 4"), "id", 1e-9, 3)
    assert nothing.core_tree is None and {r.label for r in nothing.predict(rows, "row").collect()} == {None}


def test_wide_vectors_are_measured_exactly_where_it_matters():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 64)) + 100
    y = np.concatenate([x[:20], x[20:40] + 1e-9, rng.normal(size=(30, 64)) + 100])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    got = T.distances(x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (np.diag(got)[:20] == 0).all()
    for eps in want[3, 60:70]:
        assert ((T.distances(x, y, eps) <= eps) == (want <= eps)).all()


def test_a_row_meets_leaves_in_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32))
    x /= np.sqrt(np.square(x).sum(1))[:, None]
    df = spark.createDataFrame([(i + 2**60, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    tree = T.build_tree(df, "id", leaf_rows=20)
    own = T.own_queries(tree)
    pairs, _ = T.near_leaves(tree, own.blocks.withColumn("bound", F.lit(3.0)))
    met = T.visit(tree, own, pairs, lambda ids, others, _, d, *__: {"id": ids, "n": np.full(len(ids), len(others))}, "id long, n long").toPandas()
    assert pairs.count() > 300 and len(met) == 300 and (met.n == 300).all() and set(met.id) == {i + 2**60 for i in range(300)}
