"""K-Means from several starts (M5, M8)."""

import numpy as np
from pyspark.sql import functions as F

from quotalens.operators import kmeans_starts as KS
from quotalens.queries.models import _EMB, vectors
from quotalens.queries.registry import query
from quotalens.session import checkpointed

#: Given centres: three runs of four rows each, in the order of vec_id; centres move three times.
RUNS, SIZE, ROUNDS = 3, 4, 3


def _round(i: int) -> str:
    """SQL of one move: rows to their nearest centre of each run, centres to the means."""
    return f"""
, a{i} AS (SELECT vec_id, run, cluster, v, list_distance(v, m) AS d FROM e CROSS JOIN c{i - 1} QUALIFY row_number() OVER (PARTITION BY vec_id, run ORDER BY list_distance(v, m), cluster) = 1)
, u{i} AS (SELECT run, cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i}), m{i} AS (SELECT run, cluster, i, avg(x) AS m FROM u{i} GROUP BY ALL)
, c{i} AS (SELECT run, cluster, list(m ORDER BY i) AS m FROM m{i} GROUP BY ALL)"""


@query("kmeans_lloyd_starts", _EMB + f"""
, n AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM e), c0 AS (SELECT r // {SIZE} AS run, r % {SIZE} AS cluster, v AS m FROM n WHERE r < {RUNS * SIZE})""" + "".join(_round(i) for i in range(1, ROUNDS + 2)) + f"""
SELECT CAST(run AS INTEGER) AS start, CAST(cluster AS INTEGER) AS cluster, count(*) AS rows, sum(d * d) AS cost, any_value(sqrt(list_inner_product(m, m))) AS center_norm
FROM a{ROUNDS + 1} JOIN c{ROUNDS} USING (run, cluster) GROUP BY run, cluster""", floats="cost center_norm")
def kmeans_lloyd_starts(spark, sf):
    """Three runs from given centres, moved together: rows, squared distances and centres of each cluster."""
    data = checkpointed(vectors(spark, sf).select("vec_id", "vector"))
    given = np.array([r["vector"] for r in data.orderBy("vec_id").limit(RUNS * SIZE).collect()])
    runs = KS.lloyd(data, [KS.Run(SIZE, s, given[s * SIZE:(s + 1) * SIZE]) for s in range(RUNS)], ROUNDS, -1.0)
    rows = [(run.start, j, int(n[j]), float(cost[j]), float(np.sqrt(np.square(run.centers[j]).sum())))
            for run, (n, cost, _) in zip(runs, KS.measured(data, [r.centers for r in runs])) for j in range(SIZE)]
    return spark.createDataFrame(rows, "start int, cluster int, rows long, cost double, center_norm double")


@query("kmeans_starts")
def kmeans_starts(spark, sf):
    """Twenty starts for three k in the same passes; the chosen run of each k has the least inertia."""
    _, trials = KS.fit_kmeans_starts(vectors(spark, sf), "vec_id", [3, 6, 10], 20)
    return trials.withColumn("inertia", F.round("inertia", 6))
