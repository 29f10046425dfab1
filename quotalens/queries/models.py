"""Preprocessing, clustering, reconstruction and forest."""

import uuid

from pyspark.sql import functions as F

from quotalens.operators import clustering as K, forest as FO, model_store as MS, preprocess as PP, reconstruction as RC, review as V
from quotalens.queries.base import REP_MONTH, read, rep_month
from quotalens.queries.registry import query
from quotalens.session import checkpointed, shared_folder

FEATURES = ["total_sales", "total_quantity", "transaction_count"]


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


@query("median_imputation", """
WITH d AS (SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CASE WHEN toxic = 1 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS n FROM documents LEFT JOIN labels USING (doc_id))
, m AS (SELECT median(quality) AS a, median(n) AS b FROM d)
SELECT doc_id, coalesce(quality, a) AS quality, coalesce(n, b) AS n FROM d CROSS JOIN m""", floats="quality n")
def median_imputation(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.when(F.coalesce("toxic", F.lit(0)) == 1, None).otherwise(F.col("n_chars").cast("double")).alias("n"))
    p = PP.fit_preprocessor(d, ["quality", "n"])
    return d.select("doc_id", *[F.coalesce(F.col(c), F.lit(p.parameters[c]["fill"])).alias(c) for c in ("quality", "n")])


_PRE = REP_MONTH + """
, x AS (SELECT rep_id, period, sign(total_sales) * ln(1 + abs(total_sales)) AS a, sign(total_quantity) * ln(1 + abs(total_quantity)) AS b, ln(1 + transaction_count) AS c FROM rep_month)
, t AS (SELECT * FROM x WHERE period <= DATE '1999-12-01')
, q AS (SELECT quantile_cont(a, 0.01) AS al, quantile_cont(a, 0.99) AS ah, median(a) AS am, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ai, quantile_cont(b, 0.01) AS bl, quantile_cont(b, 0.99) AS bh, median(b) AS bm,
   quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS bi, quantile_cont(c, 0.01) AS cl, quantile_cont(c, 0.99) AS ch, median(c) AS cm, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS ci FROM t)"""


def prepared(spark, sf, **settings):
    d = checkpointed(rep_month(spark, sf))
    return d, PP.fit_preprocessor(d.filter("period <= '1999-12-01'"), FEATURES, **{"log": True, "clip": (0.01, 0.99), **settings})


@query("robust_scaling_and_clipping", _PRE + """
SELECT rep_id, period, (least(greatest(a, al), ah) - am) / ai AS a, (least(greatest(b, bl), bh) - bm) / bi AS b, (least(greatest(c, cl), ch) - cm) / ci AS c FROM x CROSS JOIN q""", floats="a b c")
def robust_scaling_and_clipping(spark, sf):
    d, p = prepared(spark, sf)
    v = p.transform(d)
    return v.select("rep_id", "period", *[F.element_at("vector", i + 1).alias(n) for i, n in enumerate("abc")])


@query("standard_scaling", _PRE + """
, z AS (SELECT rep_id, period, least(greatest(a, al), ah) AS a, least(greatest(b, bl), bh) AS b, least(greatest(c, cl), ch) AS c FROM x CROSS JOIN q)
, s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM z WHERE period <= DATE '1999-12-01')
SELECT rep_id, period, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM z CROSS JOIN s""", floats="a b c")
def standard_scaling(spark, sf):
    d, p = prepared(spark, sf, scaler="standard")
    v = p.transform(d)
    return v.select("rep_id", "period", *[F.element_at("vector", i + 1).alias(n) for i, n in enumerate("abc")])


_EMB = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def label_centers(spark, sf):
    rows = K.centroids(vectors(spark, sf), "label").orderBy("label").collect()  # one row per label
    return K.KMeansModel([r["m"] for r in rows])


_CENTERS = _EMB + """
, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), ma AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS m FROM ma GROUP BY 1)
, d AS (SELECT vec_id, c.label AS cluster, list_distance(v, m) AS distance, v, m FROM e CROSS JOIN c), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""


@query("centroid_assignment", _CENTERS + " SELECT vec_id, cluster, distance FROM a", floats="distance")
def centroid_assignment(spark, sf):
    return label_centers(spark, sf).assign(vectors(spark, sf)).select("vec_id", "cluster", "distance")


@query("centroid_contributions", _CENTERS + """
, w AS (SELECT vec_id, cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x, unnest(m) AS c, distance FROM a)
SELECT vec_id, cluster, 'f' || i AS feature, (x - c) * (x - c) / (distance * distance) AS share, x - c AS residual FROM w""", floats="share residual")
def centroid_contributions(spark, sf):
    return label_centers(spark, sf).contributions(vectors(spark, sf), [f"f{i + 1}" for i in range(64)], "vec_id")


@query("centroid_distance_checks", _CENTERS + " SELECT true AS all_nearest, sum(distance * distance) AS inertia, count(*) AS rows FROM a", floats="inertia")
def centroid_distance_checks(spark, sf):
    return label_centers(spark, sf).checks(vectors(spark, sf))


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    v = checkpointed(vectors(spark, sf))
    return K.distance_score(K.fit_kmeans(v, 10).assign(v).drop("vector"), K.fit_kmeans(v, 10).assign(v)).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.max("anomaly_score").alias("top"))


@query("kmeans_grid_search")
def kmeans_grid_search(spark, sf):
    return K.tune_kmeans(checkpointed(vectors(spark, sf)), "vec_id", [3, 6, 10])[0].drop("runtime_seconds")


@query("kth_neighbor_distance", _EMB + """
, d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a CROSS JOIN e b)
SELECT vec_id, distance FROM d WHERE r = 8""", floats="distance")
def kth_neighbor_distance(spark, sf):
    return K.kth_neighbor_distance(vectors(spark, sf), "vec_id", 8, leaf_rows=128)


@query("eps_candidates", _EMB + """
, d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a CROSS JOIN e b)
SELECT quantile_cont(distance, 0.7) AS q70, quantile_cont(distance, 0.9) AS q90 FROM d WHERE r = 8""", floats="q70 q90")
def eps_candidates(spark, sf):
    return K.k_distance_quantiles(vectors(spark, sf), "vec_id", 8, [0.7, 0.9])


EPS = 0.95
_DB = _EMB + f"""
, n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM e a CROSS JOIN e b WHERE list_distance(a.v, b.v) <= {EPS}), core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5)
, ce AS (SELECT a, b FROM n SEMI JOIN core ON n.a = core.a WHERE b IN (SELECT a FROM core))
, reach AS (WITH RECURSIVE r(a, l) AS (SELECT a, a FROM core UNION SELECT ce.b, r.l FROM r JOIN ce ON r.a = ce.a) SELECT a, min(l) AS label FROM r GROUP BY a)
, bo AS (SELECT n.a, label, row_number() OVER (PARTITION BY n.a ORDER BY d, b) AS k FROM n JOIN reach ON n.b = reach.a WHERE n.a NOT IN (SELECT a FROM core))
, lab AS (SELECT vec_id, coalesce(r.label, bo.label) AS label, r.label IS NOT NULL AS core FROM e LEFT JOIN reach r ON r.a = vec_id LEFT JOIN bo ON bo.a = vec_id AND bo.k = 1)"""


@query("dbscan_labels", _DB + " SELECT vec_id, label, core FROM lab")
def dbscan_labels(spark, sf):
    return K.dbscan(vectors(spark, sf).drop("label"), "vec_id", EPS, 5, leaf_rows=128)


@query("dbscan_scores", _DB + """
, kd AS (SELECT a.vec_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a CROSS JOIN e b)
, k AS (SELECT vec_id, distance, cume_dist() OVER (ORDER BY distance) AS base FROM kd WHERE r = 5)
SELECT vec_id, CASE WHEN label IS NULL THEN 0.75 + 0.25 * base ELSE 0.75 * base END AS anomaly_score, CASE WHEN label IS NULL THEN 0.75 ELSE 0 END + 0.25 * distance / (1 + distance) AS raw_score FROM k JOIN lab USING (vec_id)""",
       floats="anomaly_score raw_score")
def dbscan_scores(spark, sf):
    v = checkpointed(vectors(spark, sf).drop("label"))
    return K.dbscan_scores(K.dbscan(v, "vec_id", EPS, 5), checkpointed(K.kth_neighbor_distance(v, "vec_id", 5)), "vec_id")


#: Rep-months are told apart at this distance; fitted up to 1999, later months are new rows.
NEW_EPS, NEW_LEAST = 0.3, 6
_NEW = _PRE + f"""
, z AS (SELECT rep_id * 1000000 + year(period) * 100 + month(period) AS row_id, period <= DATE '1999-12-01' AS fitted, [(least(greatest(a, al), ah) - am) / ai, (least(greatest(b, bl), bh) - bm) / bi, (least(greatest(c, cl), ch) - cm) / ci] AS v FROM x CROSS JOIN q)
, f AS (SELECT * FROM z WHERE fitted), p AS (SELECT * FROM z WHERE NOT fitted)
, n AS (SELECT a.row_id AS a, b.row_id AS b, list_distance(a.v, b.v) AS d FROM f a CROSS JOIN f b WHERE list_distance(a.v, b.v) <= {NEW_EPS}), core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= {NEW_LEAST})
, ce AS (SELECT a, b FROM n SEMI JOIN core ON n.a = core.a WHERE b IN (SELECT a FROM core))
, reach AS (WITH RECURSIVE r(a, l) AS (SELECT a, a FROM core UNION SELECT ce.b, min(r.l) FROM r JOIN ce ON r.a = ce.a GROUP BY ce.b) SELECT a, min(l) AS label FROM r GROUP BY a)
, near AS (SELECT p.row_id, arg_min(reach.label, {{'d': list_distance(p.v, f.v), 'id': f.row_id}}) AS label, min(list_distance(p.v, f.v)) AS d FROM p CROSS JOIN f JOIN reach ON reach.a = f.row_id GROUP BY 1)
, lab AS (SELECT p.row_id, CASE WHEN near.d <= {NEW_EPS} THEN near.label END AS label FROM p LEFT JOIN near USING (row_id))
, kf AS (SELECT a.row_id, list_sort(list(list_distance(a.v, b.v)))[{NEW_LEAST}] AS distance FROM f a CROSS JOIN f b GROUP BY 1), cdf AS (SELECT distance, cume_dist() OVER (ORDER BY distance) AS base FROM kf)
, kp AS (SELECT p.row_id, list_sort(list(list_distance(p.v, f.v)))[{NEW_LEAST}] AS distance FROM p CROSS JOIN f GROUP BY 1)
, sc AS (SELECT kp.row_id, kp.distance, coalesce((SELECT max(base) FROM cdf WHERE cdf.distance <= kp.distance), 0) AS base FROM kp)
SELECT sc.row_id, label, CASE WHEN label IS NULL THEN 0.75 + 0.25 * base ELSE 0.75 * base END AS anomaly_score, CASE WHEN label IS NULL THEN 0.75 ELSE 0 END + 0.25 * distance / (1 + distance) AS raw_score FROM sc JOIN lab USING (row_id)"""


def fitted_and_new(spark, sf):
    """Prepared rep-months up to 1999, and the later ones."""
    d, p = prepared(spark, sf)
    v = checkpointed(p.transform(d).withColumn("row_id", F.col("rep_id") * 1000000 + F.year("period") * 100 + F.month("period")).select("row_id", "period", "vector"))
    old = F.col("period") <= F.to_date(F.lit("1999-12-01"))
    return v.filter(old), v.filter(~old)


@query("dbscan_new_rows", _NEW, floats="anomaly_score raw_score")
def dbscan_new_rows(spark, sf):
    fitted, new = fitted_and_new(spark, sf)
    model = K.fit_dbscan(fitted, "row_id", NEW_EPS, NEW_LEAST)
    return model.score(new, checkpointed(model.curve()), "row_id")


@query("dbscan_grid_search")
def dbscan_grid_search(spark, sf):
    return K.tune_dbscan(checkpointed(vectors(spark, sf).drop("label")), "vec_id", [5], [0.7, 0.9])[0].drop("runtime_seconds")


@query("stored_models", _CENTERS + """
, s AS (SELECT vec_id, cluster, distance FROM a)
SELECT s.vec_id, cluster, distance, 0.0::DOUBLE AS pca_gap, 0.0::DOUBLE AS forest_gap, cume_dist() OVER (ORDER BY distance) AS top FROM s""", floats="distance pca_gap forest_gap top", digits=9)
def stored_models(spark, sf):
    """Centres, PCA, forest and a reference curve, published as a version, read in another session, used there."""
    v = checkpointed(vectors(spark, sf))
    pca, forest, centers = RC.fit_pca(v, variance=0.9), FO.fit_isolation_forest(v, "vec_id", trees=20), label_centers(spark, sf)
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    MS.save_models({"pca": pca, "forest": forest, "centers": centers}, root, spark)
    first = checkpointed(forest.score(pca.score(v, out="_pca"), out="_forest").select("vec_id", "_pca", "_forest"))
    again = MS.load_models(spark.newSession(), root)
    scored = again["forest"].score(again["pca"].score(again["centers"].assign(v), out="pca"), out="forest").join(first, ["vec_id"])
    out = scored.select("vec_id", "cluster", "distance", (F.col("pca") - F.col("_pca")).alias("pca_gap"), (F.col("forest") - F.col("_forest")).alias("forest_gap"))
    return K.distance_score(out, out, out="top")


@query("clustering_quality", _CENTERS + """
, sp AS (SELECT e.label, avg(list_distance(v, m)) AS s, count(*) AS n, sum(list_distance(v, m) ** 2) AS w FROM e JOIN c USING (label) GROUP BY 1)
, r AS (SELECT a.label, max((x.s + y.s) / list_distance(a.m, b.m)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN sp x ON x.label = a.label JOIN sp y ON y.label = b.label GROUP BY 1)
, al AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM u GROUP BY 1)), bt AS (SELECT sum(n * list_distance(c.m, al.m) ** 2) AS b FROM c JOIN sp USING (label) CROSS JOIN al)
, pw AS (SELECT x.vec_id, x.label AS own, y.label, sum(list_distance(x.v, y.v) ** 2) AS s, count(*) AS n FROM e x CROSS JOIN e y GROUP BY ALL)
, ab AS (SELECT vec_id, max(s / greatest(n - 1, 1)) FILTER (own = label) AS a, min(s / n) FILTER (own <> label) AS b, max(n) FILTER (own = label) AS n FROM pw GROUP BY 1)
SELECT CAST((SELECT count(*) FROM c) AS INTEGER) AS number_of_clusters, 0.0::DOUBLE AS noise_percentage, (SELECT 100.0 * min(n) / sum(n) FROM sp) AS smallest_cluster_pct, (SELECT 100.0 * max(n) / sum(n) FROM sp) AS largest_cluster_pct,
  (SELECT min(n) / max(n) FROM sp) AS cluster_balance, (SELECT avg(r) FROM r) AS davies_bouldin_score,
  (SELECT b FROM bt) / ((SELECT count(*) FROM c) - 1) / ((SELECT sum(w) / (sum(n) - count(*)) FROM sp)) AS calinski_harabasz_score, (SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) FROM ab) AS silhouette_squared""",
       floats="noise_percentage smallest_cluster_pct largest_cluster_pct cluster_balance davies_bouldin_score calinski_harabasz_score silhouette_squared")
def clustering_quality(spark, sf):
    """All but the sampled silhouette, which is exact only up to the sample's size."""
    return K.clustering_quality(vectors(spark, sf), "vec_id", "label").drop("silhouette_score")


@query("pca_reconstruction")
def pca_reconstruction(spark, sf):
    v = checkpointed(vectors(spark, sf))
    return RC.fit_pca(v, variance=0.9).score(v).select("vec_id", "raw_score")


@query("pca_full_rank_reconstructs", _EMB + " SELECT count(*) AS rows, 0.0::DOUBLE AS worst FROM e", floats="worst", digits=9)
def pca_full_rank_reconstructs(spark, sf):
    v = checkpointed(vectors(spark, sf))
    return RC.fit_pca(v, variance=None).score(v).agg(F.count(F.lit(1)).alias("rows"), F.max("raw_score").alias("worst"))


@query("pca_coordinates")
def pca_coordinates(spark, sf):
    v = checkpointed(vectors(spark, sf))
    return RC.fit_pca(v, k=2).coordinates(v).select("vec_id", "component_1", "component_2")


@query("isolation_forest_scores")
def isolation_forest_scores(spark, sf):
    v = checkpointed(vectors(spark, sf))
    return FO.fit_isolation_forest(v, "vec_id", trees=50).score(v).select("vec_id", "raw_score")


@query("feature_ablation")
def feature_ablation(spark, sf):
    d, p = prepared(spark, sf)
    v = checkpointed(p.transform(d).withColumn("row_id", F.concat_ws("|", "rep_id", "period")))
    forest = FO.fit_isolation_forest(v, "row_id", trees=30)
    return forest.ablation(checkpointed(forest.score(v)), "row_id", FEATURES, [0.0, 0.0, 0.0])


@query("driver_explanations")
def driver_explanations(spark, sf):
    d, p = prepared(spark, sf)
    v = checkpointed(p.transform(d).withColumn("row_id", F.concat_ws("|", "rep_id", "period")))
    errors = RC.fit_pca(v, k=1).errors(v)
    drivers = V.top_drivers(RC.long_contributions(errors, "row_id", FEATURES), "row_id", "feature", "contribution", 2)
    return V.driver_explanations(drivers, V.values_with_percentiles(v, "row_id", "period", FEATURES, {}), "row_id")


@query("centroid_explanations")
def centroid_explanations(spark, sf):
    d, p = prepared(spark, sf)
    v = checkpointed(p.transform(d).withColumn("row_id", F.concat_ws("|", "rep_id", "period")))
    from quotalens.operators.ranking import unpivot
    return V.distance_explanations(K.fit_kmeans(v, 4).contributions(v, FEATURES, "row_id"), unpivot(v, ["row_id"], FEATURES, "feature", "value"), "row_id", "cluster", 2)


#: The width of the vectors of table embeddings.
DIMENSIONS = 64


@query("density_explanations")
def density_explanations(spark, sf):
    v = checkpointed(vectors(spark, sf))
    wide = v.select("vec_id", *[F.element_at("vector", i + 1).alias(f"f{i + 1}") for i in range(DIMENSIONS)])
    return V.density_explanations(checkpointed(K.kth_neighbor_distance(v, "vec_id", 5)), wide, "vec_id", [f"f{i + 1}" for i in range(DIMENSIONS)], 5)
