"""CSV sources and the sinks, read back from the shared folder."""

import uuid

from pyspark.sql import functions as F

from quotalens.queries.base import read
from quotalens.queries.registry import query
from quotalens.session import shared_folder
from quotalens.sources import readers as SR, writers as SW

#: A name that holds what CSV must quote.
AWKWARD = 'c_name || \', "\' || c_mktsegment || \'"\''


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", f"""
SELECT c_custkey, {AWKWARD} AS label, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit, c_mktsegment FROM customer""", floats="credit")
def csv_round_trip(spark, sf):
    """Customers with quotes, commas and missing numbers, written as CSV and scanned as text."""
    rows = read(spark, sf, "customer").selectExpr("c_custkey", f"{AWKWARD} AS label", "c_nationkey", "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit", "c_mktsegment")
    texts = SR.read_csv(spark, SW.write_csv(rows, _folder(spark, "csv"), "customer"), rows.columns)
    return texts.select(*[F.col(c).cast(kind).alias(c) for c, kind in rows.dtypes])


@query("written_layers", """
SELECT 'clean/orders' AS output, 'parquet' AS format, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders UNION ALL SELECT 'clean/supplier', 'parquet', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL
SELECT 'injected/orders', 'parquet', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'benchmark/truth', 'parquet', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT 'compressed', 'csv', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier""")
def written_layers(spark, sf):
    """Clean, injected and benchmark folders and a compressed CSV, as their files say; masters are written once."""
    root, orders, supplier = _folder(spark, "layers"), read(spark, sf, "orders"), read(spark, sf, "supplier")
    paths = SW.write_layers(root, {"orders": orders, "supplier": supplier}, {"orders": orders.filter("o_orderstatus <> 'F'"), "supplier": supplier}, {"truth": orders.filter("o_orderstatus = 'F'")}, ["supplier"])
    named = {p[len(root) + 1:].removesuffix(".parquet"): p for p in paths}
    named["compressed"] = SW.write_table(supplier, root, "supplier", parquet=False, csv_gz=True)[0]
    sums = None
    for name, path in named.items():
        table = SR.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
        one = table.agg(F.sum(F.col(table.columns[0]).cast("long")).alias("key_sum")).withColumn("output", F.lit(name))
        sums = one if sums is None else sums.unionByName(one)
    return SW.output_manifest(spark, named).join(sums, ["output"]).select("output", "format", "rows", "key_sum")
