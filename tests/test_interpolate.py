"""Piecewise-linear lookup against numpy, and the cost of its look ahead."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from quotalens.operators.joins import interpolate


def test_lookup_equals_numpy_and_no_frame_runs_to_the_end(spark):
    rng = np.random.default_rng(3)
    known = {int(x): float(y) for x, y in zip(rng.integers(0, 900, 40), rng.random(40))}
    reference = spark.createDataFrame([(float(x), y) for x, y in known.items()], "x double, y double")
    probes = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.integers(-50, 950, 300))], "id long, x double")
    found = interpolate(probes, reference, [], "x", "y", "out")
    xs = sorted(known)
    for row in found.collect():
        assert abs(row["out"] - np.interp(row["x"], xs, [known[x] for x in xs])) < 1e-12
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.select(F.sum("out")).explain(True)
    assert "windowframe" in plan.getvalue().lower() and "unboundedfollowing" not in plan.getvalue().lower()
