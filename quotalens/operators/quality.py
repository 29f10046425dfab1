"""Data checks as queries: each returns rows (check_name, status, value, detail), never raising by itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from quotalens.operators.ranking import null_safe_join

LEAK_WORDS = ("ground_truth", "anomaly_type", "anomaly_category", "severity", "injection_id", "correlated_case")


def check_row(df: DataFrame, name: str, passed: Column, value: Column, detail: str) -> DataFrame:
    """Turn a one-row frame into a check row."""
    return df.select(F.lit(name).alias("check_name"), F.when(passed, "pass").otherwise("fail").alias("status"),
                     value.cast("double").alias("value"), F.lit(detail).alias("detail"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require(checks: DataFrame) -> DataFrame:
    """Make the query fail when a check row does."""
    message = F.concat(F.lit("check failed: "), F.col("check_name"), F.lit(" value="), F.col("value").cast("string"))
    return checks.withColumn("status", F.when(F.col("status") == "fail", F.raise_error(message)).otherwise(F.col("status")))


def primary_key(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Repeated or null keys."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = groups.agg(F.coalesce(F.sum(F.when(missing, F.col("_n")).otherwise(F.col("_n") - 1)), F.lit(0)).alias("bad"))
    return check_row(row, f"pk__{label}", F.col("bad") == 0, F.col("bad"), "+".join(keys))


def foreign_key(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str], label: str) -> DataFrame:
    """Distinct child keys without a parent; null and empty keys are ignored."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in child_keys])
    names = [f"_k{i}" for i in range(len(child_keys))]
    left = child.filter(present).select(*[F.col(c).alias(n) for c, n in zip(child_keys, names)]).distinct()
    right = parent.select(*[F.col(c).alias(n) for c, n in zip(parent_keys, names)]).distinct()
    row = left.join(right, names, "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    return check_row(row, f"fk__{label}", F.col("bad") == 0, F.col("bad"), f"{'+'.join(child_keys)} -> {'+'.join(parent_keys)}")


def reconciliation(df: DataFrame, name: str, left: Column, right: Column, tolerance: float, detail: str) -> DataFrame:
    """Largest absolute difference of two expressions."""
    row = df.agg(F.coalesce(F.max(F.abs(left - right)), F.lit(0.0)).alias("error"))
    return check_row(row, name, F.col("error") <= tolerance, F.col("error"), detail)


def all_rows(df: DataFrame, name: str, condition: Column, detail: str) -> DataFrame:
    """Rows breaking a condition (null breaks it)."""
    row = df.agg(F.sum(F.when(condition, 0).otherwise(1)).alias("bad")).select(F.coalesce("bad", F.lit(0)).alias("bad"))
    return check_row(row, name, F.col("bad") == 0, F.col("bad"), detail)


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, day_split: bool = True) -> DataFrame:
    """Flag intervals starting before an earlier one of the same key has ended, and repeated starts.

    The running maximum end is taken inside a calendar day and carried over days through one row
    per key and day, so a busy key is spread over its days.
    """
    day = F.to_date(start)
    cut = df.withColumn("_day", day)
    order = [F.col(start), F.col(end), F.col(row_id)]
    inside = W.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    daily = cut.groupBy(*keys, "_day").agg(F.max(end).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = daily.select(*keys, "_day", F.max("_end").over(earlier).alias("_carried"))
    marked = null_safe_join(cut.withColumn("_busy", F.max(end).over(inside)), carried, [*keys, "_day"], "inner")
    starts = W.partitionBy(*keys, "_day", start)
    return (
        marked.withColumn("overlap", F.coalesce(F.col(start) < F.greatest("_busy", "_carried"), F.lit(False)))
        .withColumn("duplicate_start", F.count(F.lit(1)).over(starts) > 1).drop("_day", "_busy", "_carried")
    )


def largest_group(df: DataFrame, keys: Sequence[str], ceiling: int, name: str, detail: str) -> DataFrame:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n"))
    return check_row(row, name, F.col("n") <= ceiling, F.col("n"), detail)


def feature_checks(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """No null, no infinity, unique grain, no label columns among the features."""
    row = df.agg(
        F.sum(reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in features])).alias("missing"),
        F.sum(reduce(lambda a, b: a + b, [
            F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 1).otherwise(0) for c in features])).alias("infinite"))
    leaked = [c for c in features if any(w in c.lower() for w in LEAK_WORDS)]
    spark = df.sparkSession
    leak = spark.range(1).select(F.lit(len(leaked)).alias("bad"))
    return union_all([
        check_row(row, "features__no_null", F.col("missing") == 0, F.col("missing"), "model features contain no nulls"),
        check_row(row, "features__finite", F.col("infinite") == 0, F.col("infinite"), "model features contain no infinities"),
        primary_key(df, keys, "features__unique_grain"),
        check_row(leak, "features__no_labels", F.col("bad") == 0, F.col("bad"), "label columns are not features"),
    ])


def share_within(df: DataFrame, name: str, condition: Column, target: float, tolerance: float) -> DataFrame:
    """Whether a share lies within a tolerance of its configured value (at least one row's worth)."""
    row = df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))
    allowed = F.greatest(F.lit(1.0) / F.greatest(F.col("n"), F.lit(1)), F.lit(float(tolerance)))
    return check_row(row, name, F.abs(F.col("share") - target) <= allowed, F.col("share"), f"configured={target:.3f}")


def mix_within(df: DataFrame, name: str, category: str, mix: Mapping[str, float]) -> DataFrame:
    """Largest distance between the observed and the configured category shares."""
    total = sum(mix.values())
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col(category) == k, 1.0).otherwise(0.0)).alias(f"_{i}") for i, k in enumerate(mix)])
    worst = F.greatest(F.lit(0.0), *[F.abs(F.col(f"_{i}") - v / total) for i, v in enumerate(mix.values())])
    allowed = F.greatest(F.lit(2.0) / F.greatest(F.col("n"), F.lit(1)), F.lit(0.03))
    return check_row(row, name, worst <= allowed, worst, "configured category mix")


def rows_equal(left: DataFrame, right: DataFrame, name: str, detail: str) -> DataFrame:
    """Rows on one side only, counting repeats."""
    extra = left.exceptAll(right).unionByName(right.exceptAll(left)).agg(F.count(F.lit(1)).alias("bad"))
    return check_row(extra, name, F.col("bad") == 0, F.col("bad"), detail)


def no_future_leakage(original: DataFrame, changed_future: DataFrame, period: str, cutoff, row_id: str,
                      columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Past rows must keep their values when only later rows change."""
    past = lambda df, tag: df.filter(F.col(period) <= F.to_date(F.lit(cutoff))).select(
        row_id, *[F.col(c).alias(f"{tag}{c}") for c in columns], F.lit(1).alias(f"{tag}here"))
    both = past(original, "a_").join(past(changed_future, "b_"), [row_id], "full_outer")
    same = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    types = {f.name: f.dataType for f in original.schema.fields}
    for c in columns:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        close = a.eqNullSafe(b)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            close = close | F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))
        same = same & close
    return all_rows(both, "no_future_leakage", same, f"history up to {cutoff} unchanged")


def label_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Columns that carry or name benchmark labels."""
    return [c for c in df.columns if c in extra or any(w in c.lower() for w in LEAK_WORDS)]


def without_labels(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return df.drop(*label_columns(df, extra))


def require_no_labels(df: DataFrame, label: str) -> DataFrame:
    found = label_columns(df)
    if found:
        raise ValueError(f"{label} carries benchmark labels: {found}")
    return df


def canonical_checks(df: DataFrame, sales: str = "sales", date: str = "date", least_rows: int = 100, most_missing: float = 0.20) -> DataFrame:
    """Row-count and missing-sales thresholds fail; negative sales, duplicates and bad dates warn."""
    duplicates = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("bad"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(sales).isNull(), 1.0).otherwise(0.0)).alias("missing"),
                 F.sum(F.when(F.col(sales) < 0, 1).otherwise(0)).alias("negative"), F.sum(F.when(F.col(date).isNull(), 1).otherwise(0)).alias("undated"))
    warn = lambda frame, name, c, detail: frame.select(
        F.lit(name).alias("check_name"), F.when(F.col(c) > 0, "warning").otherwise("pass").alias("status"), F.col(c).cast("double").alias("value"), F.lit(detail).alias("detail"))
    return union_all([
        check_row(row, "row_count", F.col("n") >= least_rows, F.col("n"), f"at least {least_rows} rows"),
        check_row(row, "missing_sales", F.col("missing") <= most_missing, F.col("missing"), "share of rows without sales"),
        warn(row, "negative_sales", "negative", "retained as returns"), warn(duplicates, "exact_duplicates", "bad", "retained for audit"),
        warn(row, "invalid_dates", "undated", "excluded from monthly aggregation"),
    ])
