"""Grain aggregates, rates, summaries, profiles, pivots and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quotalens.functions import finite_or_null
from quotalens.operators.ranking import (
    best_row, column_quantiles, null_safe_join, percent_ranks, quantiles, unpivot, with_scalars, with_totals,
)

NUMERIC = (T.NumericType,)


def grain_totals(sales: str = "sales", quantity: str = "quantity", price: str = "price", dispersion: Mapping[str, str] | None = None) -> list[Column]:
    """The aggregates of :func:`sales_grain` that read single rows."""
    return [F.sum(sales).alias("total_sales"), F.sum(quantity).alias("total_quantity"),
            F.count(F.lit(1)).alias("transaction_count"), F.avg(price).alias("average_price"),
            F.percentile(price, 0.5).alias("median_price"),
            *[F.stddev_samp(c).alias(n) for n, c in (dispersion or {}).items()]]


def sales_grain(df: DataFrame, grain: Sequence[str], distinct: Mapping[str, str], sales: str = "sales",
                quantity: str = "quantity", price: str = "price", dispersion: Mapping[str, str] | None = None) -> DataFrame:
    """Sums, rows, mean and exact median price, distinct counts and sample dispersions at a grain.

    The median counts each distinct price, before the shuffle too, so a hot group costs its number of prices and not its
    number of rows.  Each distinct count drops repeats of its own column: counted beside the median, every row would
    be copied once per count, each copy with a table of prices.
    """
    out = df.groupBy(*grain).agg(*grain_totals(sales, quantity, price, dispersion))
    for n, c in distinct.items():
        out = null_safe_join(out, df.select(*grain, c).distinct().groupBy(*grain).agg(F.count(c).alias(n)), grain, "left")
    first = [*grain, "total_sales", "total_quantity", "transaction_count", "average_price", "median_price", *distinct]
    return out.select(*first, *(dispersion or {}))


def rollups(df: DataFrame, grains: Mapping[str, Sequence[str]], distinct: Mapping[str, str]) -> dict[str, DataFrame]:
    """The same aggregate at several grains; distinct counts come from rows, never from sums."""
    return {name: sales_grain(df, grain, distinct) for name, grain in grains.items()}


def grouping_sets(df: DataFrame, dimensions: Sequence[str], aggregates: Sequence[Column], sets: Sequence[Sequence[str]]) -> DataFrame:
    """One pass over several groupings; absent dimensions are null and ``grouping`` names the set."""
    columns = [F.col(d) for d in dimensions]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("_gid"), *aggregates)
    label = None
    for s in sets:
        gid = sum(1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions) if d not in s)
        name = "+".join(s) or "all"
        label = F.when(F.col("_gid") == gid, name) if label is None else label.when(F.col("_gid") == gid, name)
    return grouped.withColumn("grouping", label).drop("_gid")


def grain_comparison(df: DataFrame, grains: Sequence[Sequence[str]]) -> DataFrame:
    """Per grain: groups, median rows per group, percentage of single-row groups."""
    out = None
    for grain in grains:
        sizes = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"))
        name = F.lit(" x ".join(grain)).alias("grain")
        facts = sizes.agg(F.count(F.lit(1)).alias("observations"),
                          (F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)) * 100).alias("single_row_pct"))
        middle = quantiles(sizes, [], "n", {"median_rows": 0.5})
        row = with_scalars(facts, middle).select(name, "observations", "median_rows", "single_row_pct")
        out = row if out is None else out.unionByName(row)
    return out


def conditional_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, tuple[Column, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(F.when(cond, F.col(v)).otherwise(0.0)).alias(n) for n, (cond, v) in sums.items()])


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds (null counts as false)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def duplicate_share(df: DataFrame, owner: Sequence[str], key: Sequence[str], out: str) -> DataFrame:
    """Share of the owner's rows whose full key occurs more than once."""
    key = list(dict.fromkeys([*owner, *key]))
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*owner).agg((F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias(out))


def token_join(c: str) -> Column:
    """Sorted distinct non-null values joined by ``|``."""
    return F.concat_ws("|", F.array_sort(F.collect_set(F.col(c).cast("string"))))


def label_join(c: str) -> Column:
    """Sorted distinct labels without blanks and null words; ``none`` when empty."""
    text = F.trim(F.col(c).cast("string"))
    kept = F.when((text != "") & ~F.lower(text).isin("none", "nan"), F.col(c).cast("string"))
    joined = F.concat_ws("|", F.array_sort(F.collect_set(kept)))
    return F.when(joined == "", "none").otherwise(joined)


def truth_rollup(df: DataFrame, keys: Sequence[str], label: str, texts: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Labels at the scoring grain: any positive wins, descriptive lists are joined."""
    return df.groupBy(*keys).agg(
        F.max(F.col(label).cast("boolean")).alias("ground_truth_label"),
        *[label_join(c).alias(c) for c in texts], *[F.min(c).alias(c) for c in first],
    )


def lineage_precedence(df: DataFrame, keys: Sequence[str], c: str = "data_lineage", winner: str = "synthetic_injected",
                       default: str = "synthetic_derived") -> DataFrame:
    """The winning lineage if any row carries it, else the most frequent (smallest on ties)."""
    counts = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col(c).isNotNull(), F.struct(-F.col("_n"), F.col(c)))
    return counts.groupBy(*keys).agg(
        F.when(F.max(F.col(c) == winner), winner).otherwise(F.coalesce(F.min_by(c, known), F.lit(default))).alias(c))


def entity_risk_summary(df: DataFrame, entity: str, score: str, flag: str, tie: str, sums: Mapping[str, str],
                        context: Sequence[str]) -> DataFrame:
    """The entity's highest-scoring row with its totals and flag rate."""
    top = best_row(df.select(entity, score, tie, *context), [entity], [-F.col(score), F.col(tie)])
    totals = df.groupBy(entity).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        F.sum(F.col(flag).cast("long")).alias("flagged_observations"), F.count(F.lit(1)).alias("observations"))
    return null_safe_join(top, totals, [entity], "inner").withColumn(
        "flagged_observation_rate", F.col("flagged_observations") / F.greatest(F.col("observations"), F.lit(1)))


def cluster_profiles(df: DataFrame, cluster: str, metrics: Mapping[str, str], flag: str, categories: Mapping[str, str],
                     total: str) -> DataFrame:
    """Size, share, mean, median, distance from the population, dominant categories and a sentence."""
    names = list(metrics)
    base = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("population"), F.sum(total).alias(f"{total}_sum"), rate(F.col(flag)).alias("anomaly_rate"),
        *[F.avg(m).alias(f"mean_{m}") for m in names])
    everyone = df.agg(F.count(F.lit(1)).alias("_n"), rate(F.col(flag)).alias("_rate"), *[F.avg(m).alias(f"_mean_{m}") for m in names])

    def wide_medians(source, keys, prefix):
        long = column_quantiles(source, names, {"median": 0.5}, keys)
        return long.groupBy(*keys).agg(*[F.max(F.when(F.col("column_name") == m, F.col("median"))).alias(f"{prefix}{m}") for m in names])

    out = null_safe_join(base, wide_medians(df, [cluster], "median_"), [cluster], "left")
    out = with_scalars(with_scalars(out, everyone), wide_medians(df, [], "_median_"))
    for name, c in categories.items():
        from quotalens.operators.shares import dominant_member
        out = null_safe_join(out, dominant_member(df, [cluster], c, name), [cluster], "left")
    out = out.withColumn("population_pct", F.col("population") / F.col("_n") * 100.0)
    for m in names:
        for stat in ("mean", "median"):
            ref = F.col(f"_{stat}_{m}")
            out = out.withColumn(f"{m}_vs_population_{stat}_pct",
                                 (F.col(f"{stat}_{m}") - ref) / F.greatest(F.abs(ref), F.lit(1e-9)) * 100.0)
    spread = base.agg(*[F.avg(f"mean_{m}").alias(f"_center_{m}") for m in names],
                      *[F.stddev_pop(f"mean_{m}").alias(f"_spread_{m}") for m in names])
    out = with_scalars(out, spread)
    words = []
    for m, label in metrics.items():
        z = F.when(F.col(f"_spread_{m}") > 1e-12, (F.col(f"mean_{m}") - F.col(f"_center_{m}")) / F.col(f"_spread_{m}")).otherwise(0.0)
        words.append(F.when(z >= 0.65, f"higher {label}").when(z <= -0.65, f"lower {label}"))
    words.append(F.when(F.col("anomaly_rate") >= F.col("_rate") + 0.03, "elevated review-label rate"))
    found = F.slice(F.array_compact(F.array(*words)), 1, 5)
    sentence = F.concat(F.upper(F.substring("_s", 1, 1)), F.lower(F.expr("substring(_s, 2)")))
    out = out.withColumn("_s", F.when(F.size(found) == 0, "near-population-average operating pattern").otherwise(F.concat_ws("; ", found)))
    out = out.withColumn("business_interpretation", F.concat(
        F.when(F.col(cluster) == -1, "Density-isolated; ").otherwise(""), sentence, F.lit(".")))
    return out.drop("_s", *[c for c in out.columns if c.startswith("_")])


def organisation_summary(df: DataFrame, group: str, rep: str, flag: str, sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Observations, representatives, candidates and flag rate per organisational unit."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct(rep).alias("representatives"),
        F.sum(F.col(flag).cast("long")).alias("review_candidates"), rate(F.col(flag)).alias("flag_rate"),
        *[F.sum(c).alias(f"{c}_total") for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in means])


def category_comparison(df: DataFrame, category: str, score: str, flag: str | None = None, largest: int = 15) -> DataFrame:
    """Flag rate of the largest categories; without a flag the top decile of the score counts."""
    if flag is None:
        cut = quantiles(df, [], score, {"_cut": 0.9})
        df = with_scalars(df, cut).withColumn("_flag", F.col(score) >= F.col("_cut"))
        flag = "_flag"
    grouped = df.groupBy(category).agg(F.count(F.lit(1)).alias("observations"), rate(F.col(flag)).alias("anomaly_rate"),
                                       F.avg(score).alias("average_score"))
    return grouped.orderBy(F.col("observations").desc(), F.col(category)).limit(largest)


def score_histogram(df: DataFrame, groups: Sequence[str], score: str, raw: str, bins: int) -> DataFrame:
    """Fixed bins over [0, 1] per group; empty bins are kept."""
    if bins < 2:
        raise ValueError("at least two bins")
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counted = df.withColumn("_bin", place).groupBy(*groups, "_bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(raw).alias("mean_raw_score"), F.avg(score).alias("mean_score"))
    sizes = counted.groupBy(*groups).agg(F.sum("count").alias("_n"))
    grid = sizes.withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = null_safe_join(grid, counted, [*groups, "_bin"], "left")
    n = F.coalesce(F.col("count"), F.lit(0))
    return full.select(
        *groups, (F.col("_bin") + 1).alias("bin"), (F.col("_bin") / F.lit(float(bins))).alias("score_lower"),
        ((F.col("_bin") + 1) / F.lit(float(bins))).alias("score_upper"), n.cast("long").alias("count"),
        (n / F.col("_n")).alias("share"), "mean_raw_score", "mean_score")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of Pearson correlations in one aggregate, as long rows."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"c{i}").alias("correlation"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells))


def spearman(df: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with averaged ties, per group, over rows where both are present; null where either is constant."""
    both = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, left, right)
    ranked = percent_ranks(both, keys, {left: "_l", right: "_r"})
    spread = F.stddev_pop("_l") * F.stddev_pop("_r")
    return ranked.groupBy(*keys).agg((F.covar_pop("_l", "_r") / F.when(spread > 0, spread)).alias("spearman"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, cardinality, quantiles and moments of numbers, commonest value of the rest."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    text = [f.name for f in df.schema.fields if f.name not in numeric]
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f.name).cast("string").alias("_text"),
                 (finite_or_null(F.col(f.name).cast("double")) if f.name in numeric else F.lit(None).cast("double")).alias("_number"))
        for f in df.schema.fields])
    long = df.select(F.inline(cells))
    base = long.groupBy("column_name", "dtype").agg(
        F.count("_text").alias("non_null_count"), (F.count(F.lit(1)) - F.count("_text")).alias("missing_count"),
        ((F.count(F.lit(1)) - F.count("_text")) / F.count(F.lit(1)) * 100.0).alias("missing_pct"),
        F.count_distinct("_text").alias("cardinality"), F.min("_number").alias("min"), F.max("_number").alias("max"),
        F.avg("_number").alias("mean"), F.stddev_samp("_number").alias("std"))
    base = base.withColumn("std", F.when(F.col("mean").isNotNull(), F.coalesce(F.col("std"), F.lit(0.0))))
    q = quantiles(long.filter(F.col("_number").isNotNull()), ["column_name"], "_number", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    words = long.filter(F.col("column_name").isin(text or [""]) & F.col("_text").isNotNull()).groupBy("column_name", "_text").agg(
        F.count(F.lit(1)).alias("_n"))
    top = words.groupBy("column_name").agg(
        F.min_by("_text", F.struct(-F.col("_n"), F.col("_text"))).alias("most_common_value"), F.max("_n").alias("most_common_count"))
    return null_safe_join(null_safe_join(base, q, ["column_name"], "left"), top, ["column_name"], "left")


def missing_rates(df: DataFrame) -> DataFrame:
    """Quality rows: missing rate per column with a pass / warning status."""
    row = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(f"missing_rate__{c}").alias("check_name"), F.col(c).alias("value")) for c in df.columns])
    return row.select(F.inline(cells)).select(
        "check_name", F.when(F.col("value") > 0, "warning").otherwise("pass").alias("status"), "value")


def forecast_errors(df: DataFrame, keys: Sequence[str], observed: str, predicted: str) -> DataFrame:
    """MAE, RMSE, WAPE, sMAPE and bias."""
    y, p = F.col(observed), F.col(predicted)
    error = F.abs(p - y)
    return df.groupBy(*keys).agg(
        F.avg(error).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        (F.sum(error) / F.greatest(F.sum(F.abs(y)), F.lit(1.0))).alias("wape"),
        F.avg(2 * error / F.greatest(F.abs(p) + F.abs(y), F.lit(1.0))).alias("smape"), F.avg(p - y).alias("bias"))


def coverage(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(period).alias("start"), F.max(period).alias("end"), F.count(F.lit(1)).alias("rows"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("rows"))


def pivot_rate(df: DataFrame, row: str, column: str, values: Sequence, flag: str) -> DataFrame:
    """Rows × named columns of flag rates; naming the columns keeps it one pass."""
    return df.groupBy(row).pivot(column, list(values)).agg(rate(F.col(flag)))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    joined = with_totals(df, keys, _total=F.sum(value))
    return joined.withColumn(out, F.col(value) / F.greatest(F.abs(F.col("_total")), F.lit(1.0))).drop("_total")


def distinct_per_group(df: DataFrame, keys: Sequence[str], c: str, out: str) -> DataFrame:
    """Distinct count of the group on every row."""
    return with_totals(df, keys, **{out: F.count_distinct(c)})

