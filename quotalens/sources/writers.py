"""Sinks and their bookkeeping: Parquet, CSV, layers, samples, fingerprints, manifest, dictionary."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, folder: str, name: str, parquet: bool = True, csv_gz: bool = False, partition_by: Sequence[str] = ()) -> list[str]:
    paths = []
    if parquet:
        path = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)
        paths.append(path)
    if csv_gz:
        path = f"{folder}/{name}.csv"
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
        paths.append(path)
    return paths


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_layers(root: str, clean: Mapping[str, DataFrame], injected: Mapping[str, DataFrame], benchmark: Mapping[str, DataFrame], masters: Sequence[str]) -> list[str]:
    """clean/, injected/ and benchmark/ folders; masters are not written a second time."""
    paths = []
    for layer, tables in (("clean", clean), ("injected", {n: t for n, t in injected.items() if n not in masters}), ("benchmark", benchmark)):
        for name, table in tables.items():
            paths += write_table(table, f"{root}/{layer}", name)
    return paths


def write_samples(tables: Mapping[str, DataFrame], folder: str, rows: int = 25) -> list[str]:
    return [write_csv(t.limit(rows), folder, n) for n, t in tables.items()]


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows and a checksum of row hashes (one row)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"), F.bit_xor(h).alias("xor"))


# --- versions: staged, verified, published by a manifest --------------------------------------

MANIFEST = "version long, table_name string, path string, rows long, checksum string, xor long"


def published_manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published rows (version, table_name, path, rows, checksum, xor); none before the first version."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def publish(tables: Mapping[str, DataFrame], root: str, spark: SparkSession) -> int:
    """Write tables as one version and return its number.

    Each table goes to a staging folder of its own and is read back; only when counts and fingerprints of all
    agree is the manifest appended, as the last step.  A write that ends before leaves files that no reader sees.
    """
    staged = f"{root}/data/{uuid.uuid4().hex}"
    version = (published_manifest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    rows = []
    for name, table in tables.items():
        path = write_table(table, staged, name)[0]
        want, got = (fingerprint(t).first() for t in (table, spark.read.schema(table.schema).parquet(path)))
        if want != got:
            raise ValueError(f"{name}: {got['rows']} rows read back where {want['rows']} were written, or other values")
        rows.append((version, name, path, got["rows"], got["checksum"], got["xor"]))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest version, or of a given one; files outside the manifest do not exist for a reader."""
    manifest = published_manifest(spark, root)
    if version is None:
        version = manifest.agg(F.max("version")).first()[0]
    rows = manifest.filter(F.col("version") == F.lit(version)).collect()  # one row per table
    if not rows:
        raise LookupError(f"no published version {version} in {root}")
    return {r["table_name"]: spark.read.parquet(r["path"]) for r in rows}


def verified(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(table_name, rows, intact): the tables of a version against the fingerprints of its manifest."""
    tables = published(spark, root, version)
    manifest = published_manifest(spark, root)
    newest = manifest.agg(F.max("version")).first()[0] if version is None else version
    out = None
    for name, table in tables.items():
        now = fingerprint(table).select(F.lit(name).alias("table_name"), F.col("rows").alias("_rows"), F.col("checksum").alias("_checksum"), F.col("xor").alias("_xor"))
        row = manifest.filter(F.col("version") == newest).join(now, ["table_name"]).select(
            "table_name", "rows", ((F.col("rows") == F.col("_rows")) & F.col("checksum").eqNullSafe(F.col("_checksum")) & F.col("xor").eqNullSafe(F.col("_xor"))).alias("intact"))
        out = row if out is None else out.unionByName(row)
    return out


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two fingerprints agree."""
    return before.exceptAll(after).agg((F.count(F.lit(1)) == 0).alias("unchanged"))


def output_manifest(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(output, format, files, rows, bytes) of written Parquet or CSV folders, from the files' own metadata."""
    out = None
    for name, path in paths.items():
        kind = "csv" if path.endswith(".csv") else "parquet"
        df = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
        per_file = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p", "s").agg(F.count(F.lit(1)).alias("r"))
        row = per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("r").alias("rows"), F.sum("s").alias("bytes")).select(F.lit(name).alias("output"), F.lit(kind).alias("format"), "files", "rows", "bytes")
        out = row if out is None else out.unionByName(row)
    return out


# Definitions by column ending.
DEFINITIONS = {
    "_id": "Stable identifier", "_date": "Calendar date", "_flag": "Boolean indicator", "_pct": "Percentage or share", "_count": "Number of records", "_hours": "Hours",
    "_amount": "Monetary amount in the table's currency", "_fte": "Full-time equivalents", "_score": "Model or composite score", "_name": "Display name",
}


def data_dictionary(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, position, field, type, definition) from the actual schemas."""
    def meaning(c: str) -> str:
        return next((text for end, text in DEFINITIONS.items() if c.endswith(end)), c.replace("_", " ").capitalize())
    rows = [(t, i, f.name, f.dataType.simpleString(), meaning(f.name)) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, field string, type string, definition string")


def check_outputs(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(output, status): pass when the output can be read and holds a row."""
    rows = []
    for name, path in paths.items():
        try:
            df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
            rows.append((name, "fail" if df.isEmpty() else "pass"))
        except Exception as error:  # a missing or unreadable folder is the finding itself
            rows.append((name, f"fail: {type(error).__name__}"))
    return spark.createDataFrame(rows, "output string, status string")
