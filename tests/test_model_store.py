"""Published versions and stored models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.operators import clustering as K, forest as FO, metrics as M, model_store as MS, preprocess as PP, reconstruction as RC
from quotalens.sources import writers as SW


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, .3, (40, 3)) for c in ((0, 0, 0), (4, 1, 0))])
    return spark.createDataFrame([(i, [float(a) for a in v], float(v[0]), None if i % 9 == 0 else float(v[1]), "ab"[i % 2]) for i, v in enumerate(x)], "id long, vector array<double>, a double, b double, g string").cache()


def test_models_score_alike_after_loading_in_another_session(spark, rows, tmp_path):
    train = rows.filter("id % 3 > 0")
    pre = PP.fit_preprocessor(train, ["a", "b"], log=True, clip=(0.05, 0.95))
    plain = PP.fit_preprocessor(train, ["a", "b"])
    models = {"pca": RC.fit_pca(train, k=2), "kmeans": K.fit_kmeans(train, 2), "forest": FO.fit_isolation_forest(train, "id", trees=10, samples=32), "pre": pre, "plain": plain,
              "dbscan": K.fit_dbscan(train, "id", .6, 4, leaf_rows=30), "curve": (M.fit_calibrator(train, ["g"], "a"), "a"), "all": (M.fit_calibrator(train, [], "a"), "a")}
    root = str(tmp_path / "m")
    assert MS.save_models(models, root, spark) == 1
    again = MS.load_models(spark.newSession(), root)
    same = lambda f: [tuple(r) for r in f(models).orderBy("id").collect()] == [tuple(r) for r in f(again).orderBy("id").collect()]
    assert same(lambda m: m["pca"].score(rows)) and same(lambda m: m["kmeans"].assign(rows)) and same(lambda m: m["forest"].score(rows))
    assert same(lambda m: m["pre"].transform(rows, "v")) and same(lambda m: m["plain"].transform(rows, "v"))
    assert same(lambda m: m["dbscan"].predict(rows.filter("id % 3 = 0"), "id")) and same(lambda m: M.calibrate(rows, m["curve"][0], ["g"], "a", "p")) and same(lambda m: M.calibrate(rows, m["all"][0], [], "a", "p"))
    MS.save_models({"kmeans": K.KMeansModel([[1.0, 2.0, 3.0]])}, root, spark)
    assert MS.load_models(spark, root)["kmeans"].centers == [[1.0, 2.0, 3.0]] and set(MS.load_models(spark, root, 1)) == set(models)


def test_an_interrupted_write_is_not_seen(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    with pytest.raises(LookupError):
        SW.published(spark, root)
    assert SW.publish({"t": rows.select("id", "a")}, root, spark) == 1
    broken = rows.select("id", F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise(F.col("a")).cast("double").alias("a"))
    with pytest.raises(Exception, match="lost"):
        SW.publish({"t": rows.select("id").limit(3), "u": broken}, root, spark)
    assert set(SW.published(spark, root)) == {"t"} and SW.published(spark, root)["t"].count() == 80
    write = SW.write_table
    with monkeypatch.context() as m, pytest.raises(ValueError, match="read back"):
        m.setattr(SW, "write_table", lambda table, *more: write(table.filter("id < 9"), *more))
        SW.publish({"t": rows.select("id")}, root, spark)
    assert [tuple(r) for r in SW.verified(spark, root).collect()] == [("t", 80, True)]
    rows.select("id", "a").filter("id > 3").write.mode("overwrite").parquet(SW.published_manifest(spark, root).first()["path"])
    assert [tuple(r) for r in SW.verified(spark, root).collect()] == [("t", 80, False)]
    assert SW.publish({"t": rows.select("id")}, root, spark) == 2
