"""Fitted models as one table: a row per centre, component, tree, feature or reference point.

Small parts go through the driver as they do when a model is fitted; calibrators and the rows of a fitted
DBSCAN stay tables.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quotalens.operators.clustering import DbscanModel, KMeansModel
from quotalens.operators.forest import IsolationForest
from quotalens.operators.metric_tree import build_tree
from quotalens.operators.preprocess import Preprocessor
from quotalens.operators.reconstruction import PcaModel
from quotalens.session import checkpointed
from quotalens.sources.writers import publish, published

ROWS = "name string, kind string, part string, position long, key string, values array<double>, text string"
FIELDS = ("fill", "low", "high", "center", "scale")
REFERENCE = ("position", "_low", "_high", "_tail", "_low_position", "_high_position")


def _parts(model) -> tuple[str, list[tuple]]:
    """Kind and (part, position, values, text) of a model that is small."""
    floats = lambda row: [None if x is None else float(x) for x in row]
    if isinstance(model, PcaModel):
        return "pca", [("mean", 0, floats(model.mean), None), ("explained", 0, floats(model.explained), None), *(("component", i, floats(c), None) for i, c in enumerate(model.components))]
    if isinstance(model, KMeansModel):
        return "kmeans", [("inertia", 0, [float(model.inertia)], None), *(("center", i, floats(c), None) for i, c in enumerate(model.centers))]
    if isinstance(model, IsolationForest):
        return "forest", [("samples", 0, [float(model.samples)], None), *(("tree", i, floats(t.ravel()), None) for i, t in enumerate(model.trees))]
    if isinstance(model, Preprocessor):
        return "preprocessor", [("feature", i, [*floats(model.parameters[f][k] for k in FIELDS), float(model.parameters[f]["log"])], f) for i, f in enumerate(model.features)]
    raise TypeError(f"cannot store {type(model).__name__}")


def model_rows(spark: SparkSession, name: str, model) -> DataFrame:
    """The rows of a model.  A calibrator is the pair of its table and its raw column."""
    if isinstance(model, tuple):
        table, raw = model
        keys = [c for c in table.columns if c not in (raw, *REFERENCE)]
        key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
        values = F.array(F.col(raw).cast("double"), *[F.col(c).cast("double") for c in REFERENCE])
        kinds = dict(table.dtypes)
        schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
        points = table.select(F.lit(name).alias("name"), F.lit("calibrator").alias("kind"), F.lit("point").alias("part"), F.lit(0).cast("long").alias("position"), key.alias("key"), values.alias("values"), F.lit(None).cast("string").alias("text"))
        return points.unionByName(spark.createDataFrame([(name, "calibrator", "columns", 0, raw, None, schema)], ROWS))
    if isinstance(model, DbscanModel):
        tree = model.tree.rows.select("id", "vector").join(model.tree.members, ["id"])
        fitted = tree.join(model.labels.select(F.col(model.row_id).alias("member"), "label", "core"), ["member"]).select(
            F.lit(name).alias("name"), F.lit("dbscan").alias("kind"), F.lit("fitted").alias("part"), F.col("core").cast("long").alias("position"),
            F.col("member").cast("string").alias("key"), F.col("vector").alias("values"), F.col("label").cast("string").alias("text"))
        head = (name, "dbscan", "settings", 0, model.row_id, [model.eps, float(model.min_samples), float(model.leaf_rows)], dict(model.labels.dtypes)[model.row_id])
        return fitted.unionByName(spark.createDataFrame([head], ROWS))
    kind, parts = _parts(model)
    return spark.createDataFrame([(name, kind, part, i, None, values, text) for part, i, values, text in parts], ROWS)


def save_models(models: Mapping[str, object], root: str, spark: SparkSession) -> int:
    """Publish all models as one version and return its number; readers see either all of them or none."""
    rows = None
    for name, model in models.items():
        more = model_rows(spark, name, model)
        rows = more if rows is None else rows.unionByName(more)
    return publish({"models": checkpointed(rows)}, root, spark)


def load_model(rows: DataFrame, name: str):
    """A model from the table of a version."""
    own = rows.filter(F.col("name") == name)
    head = own.select("kind").first()
    if head is None:
        raise KeyError(name)
    kind = head["kind"]
    if kind == "calibrator":
        columns = own.filter("part = 'columns'").first()
        points = own.filter("part = 'point'")
        values = [F.get("values", F.lit(i)).alias(c) for i, c in enumerate((columns["key"], *REFERENCE))]
        if not columns["text"]:
            return points.select(*values), columns["key"]
        return points.select(F.from_json("key", columns["text"]).alias("_k"), *values).select("_k.*", columns["key"], *REFERENCE), columns["key"]
    if kind == "dbscan":
        settings = own.filter("part = 'settings'").first()
        eps, least, leaf_rows = settings["values"]
        row_id, id_type = settings["key"], settings["text"]
        fitted = checkpointed(own.filter("part = 'fitted'").select(F.col("key").cast(id_type).alias(row_id), F.col("values").alias("vector"), F.col("text").cast(id_type).alias("label"), (F.col("position") == 1).alias("core")))
        tree = build_tree(fitted, row_id, "vector", int(leaf_rows))
        cores = tree.rows.select("id", "vector").join(fitted.filter("core").select(F.col(row_id).alias("id"), "label"), ["id"])
        core_labels = checkpointed(cores.select("id", "label"))
        return DbscanModel(eps, int(least), row_id, fitted.select(row_id, "label", "core"), tree, cores.select("id", "vector"), core_labels, int(leaf_rows))
    parts: dict[str, list] = {}
    for r in own.orderBy("part", "position").collect():  # as many rows as the fit sent
        parts.setdefault(r["part"], []).append(r)
    listed = lambda part: [r["values"] for r in parts[part]]
    if kind == "pca":
        return PcaModel(np.array(listed("mean")[0]), np.array(listed("component")), np.array(listed("explained")[0]))
    if kind == "kmeans":
        return KMeansModel(listed("center"), listed("inertia")[0][0])
    if kind == "forest":
        return IsolationForest([np.array(t).reshape(-1, 5) for t in listed("tree")], int(listed("samples")[0][0]))
    features = [r["text"] for r in parts["feature"]]
    return Preprocessor(features, {r["text"]: {**dict(zip(FIELDS, r["values"])), "log": bool(r["values"][-1])} for r in parts["feature"]})


def load_models(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """All models of the latest published version, or of a given one."""
    rows = published(spark, root, version)["models"]
    return {r["name"]: load_model(rows, r["name"]) for r in rows.select("name").distinct().collect()}
