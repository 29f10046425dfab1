"""Review tables derived from the driver's tables, in Spark and as SQL text.

Roles: supplier = representative, nation of supplier = manager, region of supplier = team,
customer's nation = city and territory, customer's region = country, market segment = channel,
part = product, part type = product class, brand = distributor.  Sales are whole currency
units (so sums are exact in any order) and negative for returned lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotalens.functions import month_start


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its dimensions.

    Orders meet their customers first, so a line is moved only for its order and its product; suppliers, nations and
    regions are joined last and as they are read, so Spark knows their sizes and no line is moved for them or with their names.
    """
    t = lambda n: read(spark, sf_dir, n)
    nation = lambda side: t("nation").select(F.col("n_nationkey").alias(f"{side}_nationkey"), F.col("n_regionkey").alias(f"{side}_regionkey"), F.col("n_name").alias(f"{side}_nation"))
    region = lambda side: t("region").select(F.col("r_regionkey").alias(f"{side}_regionkey"), F.col("r_name").alias(f"{side}_region"))
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_custkey", "c_mktsegment", "c_nationkey")
    gross = F.floor(F.col("l_extendedprice") + 0.5).cast("double")
    net = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 0.5).cast("double")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return (
        t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation("s"), "s_nationkey").join(region("s"), "s_regionkey")
        .join(nation("c"), "c_nationkey").join(region("c"), "c_regionkey")
        .select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("s_suppkey").alias("rep_id"), F.col("s_name").alias("rep_name"), F.col("s_nation").alias("manager"), F.col("s_region").alias("team"),
            F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("channel"), F.col("c_nation").alias("city"), F.col("c_region").alias("country"),
            F.col("l_partkey").alias("product_id"), F.col("p_type").alias("product_class"),
            F.col("p_brand").alias("distributor"),
            F.col("o_orderdate").cast("date").alias("order_date"), month_start("o_orderdate").alias("period"),
            F.col("l_shipdate").cast("date").alias("ship_date"),
            F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount_pct"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("double").alias("price"),
            (sign * gross).alias("gross_sales"), (sign * net).alias("sales"),
            (F.col("l_returnflag") == "R").alias("return_flag"),
        )
    )


LEDGER = """WITH ledger AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, s_suppkey AS rep_id, s_name AS rep_name,
         sn.n_name AS manager, sr.r_name AS team, c_custkey AS customer_id, c_mktsegment AS channel,
         cn.n_name AS city, cr.r_name AS country, l_partkey AS product_id, p_type AS product_class,
         p_brand AS distributor, CAST(o_orderdate AS DATE) AS order_date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(l_shipdate AS DATE) AS ship_date,
         l_quantity AS quantity, l_discount AS discount_pct, floor(l_extendedprice / l_quantity + 0.5) AS price,
         CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * floor(l_extendedprice + 0.5) AS gross_sales,
         CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * floor(l_extendedprice * (1 - l_discount) + 0.5) AS sales,
         l_returnflag = 'R' AS return_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
)"""


def rep_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rep × month totals."""
    return ledger(spark, sf_dir).groupBy("rep_id", "period").agg(
        F.max("team").alias("team"), F.max("manager").alias("manager"),
        F.sum("sales").alias("total_sales"), F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


REP_MONTH = LEDGER + """, rep_month AS (
  SELECT rep_id, period, max(team) AS team, max(manager) AS manager, sum(sales) AS total_sales,
         sum(quantity) AS total_quantity, count(*) AS transaction_count
  FROM ledger GROUP BY rep_id, period
)"""


def class_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rep × product class × month totals."""
    return ledger(spark, sf_dir).groupBy("rep_id", "product_class", "period").agg(
        F.max("team").alias("team"), F.min("country").alias("peer_country"),
        F.sum("sales").alias("total_sales"), F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


CLASS_MONTH = LEDGER + """, class_month AS (
  SELECT rep_id, product_class, period, max(team) AS team, min(country) AS peer_country, sum(sales) AS total_sales,
         sum(quantity) AS total_quantity, count(*) AS transaction_count
  FROM ledger GROUP BY rep_id, product_class, period
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two score vectors: tied (word-like length) and fine (characters)."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("observation_id"), "lang", "source",
        (F.col("toxic") == 1).alias("label"), (F.col("quality") == 0).alias("low_quality"),
        F.floor(F.col("n_chars") / 100.0).cast("double").alias("score"),
        F.col("n_chars").cast("double").alias("fine_score"),
    )


SCORES = """WITH scores AS (
  SELECT doc_id AS observation_id, lang, source, toxic = 1 AS label, quality = 0 AS low_quality,
         floor(n_chars / 100.0) AS score, CAST(n_chars AS DOUBLE) AS fine_score
  FROM documents JOIN labels USING (doc_id)
)"""
