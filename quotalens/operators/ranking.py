"""Exact order statistics, ranks, top fractions and budgets without one-task sorts.

Everything here rests on :func:`positions`: for each distinct value of a group, how many rows
hold it, how many lie below it, and how many the group has.  Values are first collapsed to
(group, value, count) with map-side combine, then cut into ranges, counted range by range and joined
with the counts of the ranges before, so neither a group that holds a third of all rows nor one value
that does is ever sorted or collected by a single task.  The cut is written once and read by all
later steps, hence safe to go on with after a lost executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.session import checkpointed, sent


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach group totals by aggregate-then-join (groups of any size, AQE splits hot keys)."""
    aggregated = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return null_safe_join(df, aggregated, keys, "left") if keys else with_scalars(df, aggregated)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row; more than one row fails the query."""
    tag = "_s" + uuid.uuid4().hex[:8]
    value = one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()
    return df.withColumn(tag, value).select(*df.columns, *[F.col(f"{tag}.{c}").alias(c) for c in one_row.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join on same-named keys where null matches null; keeps the left key columns."""
    tag = uuid.uuid4().hex[:8]
    renamed = right.select(*[F.col(k).alias(f"{k}__{tag}") if k in keys else F.col(k) for k in right.columns])
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"{k}__{tag}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"{k}__{tag}" for k in keys])


def in_ranges(distinct: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Add ``_bucket``: the number of a row's range, in order of keys and value.  Written once, so that all readers see one cut.

    Spark samples the rows for the cut and sizes the ranges by their bytes; a large group spreads over as many as it needs.
    """
    order = [F.col(f"`{c}`") for c in (*keys, value)]
    cut = distinct.repartitionByRange(ranges, *order) if ranges else distinct.repartitionByRange(*order)
    return checkpointed(cut.withColumn("_bucket", F.spark_partition_id()))


def positions(df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, str] | None = None,
              ranges: int | None = None) -> DataFrame:
    """One row per (group, distinct non-null value): ``n_equal``, ``n_below``, ``n_total``.

    ``weights`` adds the same three for sums of columns: {"pos": "_y"} gives pos_equal, pos_below, pos_total.
    """
    keys = list(keys)
    amounts = {"n": F.count(F.lit(1)), **{name: F.sum(c) for name, c in (weights or {}).items()}}
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[a.alias(f"{n}_equal") for n, a in amounts.items()])
    cut = in_ranges(counts, keys, value, ranges)

    per_bucket = cut.groupBy(*keys, "_bucket").agg(*[F.sum(f"{n}_equal").alias(f"_{n}") for n in amounts])
    over_buckets = W.partitionBy(*keys).orderBy("_bucket")
    whole = W.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[(F.sum(f"_{n}").over(over_buckets) - F.col(f"_{n}")).alias(f"_{n}_before") for n in amounts],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in amounts])
    inside = W.partitionBy(*keys, "_bucket").orderBy(value)
    running = cut.withColumns({f"_{n}_inside": F.sum(f"{n}_equal").over(inside) - F.col(f"{n}_equal") for n in amounts})
    joined = null_safe_join(running, offsets, keys + ["_bucket"], "inner")
    return joined.select(*keys, value, *[x for n in amounts for x in (
        F.col(f"{n}_equal"), (F.col(f"_{n}_before") + F.col(f"_{n}_inside")).alias(f"{n}_below"), F.col(f"{n}_total"))])


def quantiles_from(pos: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group from a :func:`positions` table."""
    out = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        lo, hi = F.floor(place), F.ceil(place)
        holds = lambda rank: (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n_equal"))
        v = F.col(value).cast("double")
        out += [
            F.max(F.when(holds(lo), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi), v)).alias(f"_hi_{name}"),
            F.max(place - lo).alias(f"_part_{name}"),
        ]
    wide = pos.groupBy(*keys).agg(*out)
    return wide.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in probabilities
        ],
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per group (numpy's linear rule) for groups of any size."""
    return quantiles_from(positions(df, keys, value), keys, value, probabilities)


def middle_quantile(df: DataFrame, keys: Sequence[str], value: str, out: str, probability: float = 0.5, slack: float = 0.02) -> DataFrame:
    """One exact quantile per group, from the rows near it.

    A sketch names two values around the quantile; rows outside are only counted, rows between go through :func:`positions`.
    Where the counts show that the quantile is not between, the group's rows are all taken.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    ends = [max(0.0, probability - slack), min(1.0, probability + slack)]
    near = checkpointed(rows.groupBy(*keys).agg(F.percentile_approx(value, ends, 1000).alias("_ends")))
    at = F.col(value)
    beside = null_safe_join(rows, sent(near), keys, "inner") if keys else with_scalars(rows, near)
    counts = beside.groupBy(*keys).agg(
        F.first("_ends").alias("_ends"), F.count(F.lit(1)).alias("_total"), F.sum((at < F.col("_ends")[0]).cast("long")).alias("_low"), F.sum((at <= F.col("_ends")[1]).cast("long")).alias("_upto"))
    place = F.lit(float(probability)) * (F.col("_total") - 1)
    between = (F.col("_low") <= F.floor(place)) & (F.ceil(place) < F.col("_upto"))
    counts = checkpointed(counts.select(*keys, F.when(between, F.col("_ends")).alias("_ends"), "_total", F.when(between, F.col("_low")).otherwise(0).alias("_low")))
    beside = null_safe_join(rows, sent(counts), keys, "inner") if keys else with_scalars(rows, counts)
    pos = positions(beside.filter(F.col("_ends").isNull() | at.between(F.col("_ends")[0], F.col("_ends")[1])), keys, value)
    pos = null_safe_join(pos, sent(counts), keys, "inner") if keys else with_scalars(pos, counts)
    pos = pos.select(*keys, value, "n_equal", (F.col("n_below") + F.col("_low")).alias("n_below"), F.col("_total").alias("n_total"))
    return quantiles_from(pos, keys, value, {out: probability})


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of several columns in one pass: (keys, ``column_name``, quantiles)."""
    long = unpivot(df, list(keys), columns, "column_name", "_value")
    return quantiles(long, [*keys, "column_name"], "_value", probabilities)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; values are doubles."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), name, value)


# --- ranks ----------------------------------------------------------------------------------

def percent_ranks(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Rank over group size with ties averaged, for several columns; null stays null."""
    out = df
    for value, name in columns.items():
        pos = positions(df, keys, value).select(
            *keys, value, ((F.col("n_below") + (F.col("n_equal") + 1) / 2.0) / F.col("n_total")).alias(name))
        out = null_safe_join(out, pos, [*keys, value], "left")
    return out


def percent_rank_average(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return percent_ranks(df, keys, {value: out})


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = True) -> DataFrame:
    """Rank from one with ties averaged; null stays null."""
    middle = (F.col("n_equal") + 1) / 2.0
    rank = (F.col("n_total") - F.col("n_below") - F.col("n_equal") + middle) if descending else (F.col("n_below") + middle)
    pos = positions(df, keys, value).select(*keys, value, rank.alias(out))
    return null_safe_join(df, pos, [*keys, value], "left")


def row_numbers(df: DataFrame, score: str, tie: str, out: str, keys: Sequence[str] = (), size: str | None = None, ranges: int | None = None) -> DataFrame:
    """1, 2, 3 … per group by score descending (null last), ties by ascending unique id.

    Rows are cut into sorted ranges of the unique order key (score, id), so ranges stay balanced however many scores tie; a
    row's number is its place in its range and the count of the group's rows in the ranges before.
    ``size`` also keeps the group's row count.
    """
    keys = list(keys)
    order = F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("s"), F.col(tie).alias("t"))
    by = [*(F.col(f"`{k}`") for k in keys), F.col("_order")]
    placed = df.withColumn("_order", order)
    placed = (placed.repartitionByRange(ranges, *by) if ranges else placed.repartitionByRange(*by)).sortWithinPartitions(*by)
    # the id counts a range's rows in its lower 33 bits and holds the range's number above
    placed = checkpointed(placed.drop("_order").withColumn("_at", F.monotonically_increasing_id()).withColumn("_bucket", F.shiftright("_at", 33)))
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = counts.select(
        *keys, "_bucket", "_first", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_size"))
    ranked = null_safe_join(placed, offsets, [*keys, "_bucket"], "inner")
    ranked = ranked.withColumn(out, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"))
    if size:
        ranked = ranked.withColumn(size, F.col("_size"))
    return ranked.drop("_at", "_bucket", "_before", "_size", "_first")


def budget(total: Column, fraction: float) -> Column:
    """ceil(n * fraction), at least one.  The tiny slack keeps 100 * 0.07 at 7 instead of 8."""
    return F.greatest(F.lit(1), F.ceil(total * F.lit(float(fraction)) - 1e-9)).cast("long")


def budget_threshold(df: DataFrame, score: str, fraction: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: the k-th highest score, k = ceil(n * fraction)."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    filled = df.select(*keys, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_score"))
    pos = positions(filled, keys, "_score").withColumn("_k", budget(F.col("n_total"), fraction))
    above = F.col("n_total") - F.col("n_below") - F.col("n_equal")
    kth = pos.filter((above < F.col("_k")) & (F.col("_k") <= above + F.col("n_equal")))
    return kth.select(*keys, F.col("_score").alias("threshold"), F.col("_k").alias("review_count"))


def top_fraction(df: DataFrame, score: str, tie: str, fraction: float, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Flag exactly ceil(n * fraction) rows per group, at least one; ties by ascending unique id."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    ranked = row_numbers(df, score, tie, "_rank", keys, size="_total")
    return ranked.withColumn(out, F.col("_rank") <= budget(F.col("_total"), fraction)).drop("_rank", "_total")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.  ``order`` holds columns to be *minimised*.

    A struct minimum combines map-side, so a hot key never reaches one sorter.
    """
    fields = [F.struct(*[c for c in order]).alias("_rank"), *[F.col(c) for c in df.columns if c not in keys]]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*fields[1:]), fields[0]).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group.  Spark prunes each map task to n rows per group before shuffling."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
