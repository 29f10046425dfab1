"""Checked, as-of, range, pairing, interpolation and set-style joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.functions import month_start, stable_integer
from quotalens.operators.ranking import in_ranges, null_safe_join, row_numbers, with_scalars


def unique_or_fail(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """The same rows; a repeated key fails the query when it runs (no extra action)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, F.assert_true(F.col("_n") == 1, F.lit(f"{label}: repeated key")).alias("_ok")).filter(
            F.col("_ok").isNull()).select(*keys)
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"{label}: repeated key")))
    return grouped.withColumn("_row", row).select(*keys, "_row.*").select(*df.columns)


def checked_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str = "many_to_one",
                      label: str = "lookup") -> DataFrame:
    """Left join that fails when the declared cardinality does not hold."""
    if cardinality not in ("many_to_one", "one_to_one"):
        raise ValueError(cardinality)
    if cardinality == "one_to_one":
        left = unique_or_fail(left, keys, f"{label} (left)")
    return left.join(unique_or_fail(right, keys, label), list(keys), "left")


def assemble(base: DataFrame, facts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join pre-aggregated facts to one base on one key; earlier columns win."""
    for fact in facts:
        fresh = [c for c in fact.columns if c not in base.columns]
        base = base.join(fact.select(*keys, *fresh), list(keys), "left")
    return base


def outer_facts(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Full outer join of two facts; missing measures become ``fill``."""
    joined = left.join(right, list(keys), "full_outer")
    measures = [c for c in joined.columns if c not in keys]
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in measures])


def with_fallback(found: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``found`` plus the fallback rows whose key it lacks."""
    missing = wanted.join(found.select(*keys).distinct(), list(keys), "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def month_grid(entities: DataFrame, facts: DataFrame, period: str, start: str | None = None) -> DataFrame:
    """Every entity × every calendar month between the facts' first and last (from its start on).

    Months are generated per entity row, so no join pairs rows with each other.
    """
    span = facts.agg(F.min(month_start(period)).alias("_from"), F.max(month_start(period)).alias("_to"))
    begin = F.greatest(F.col("_from"), month_start(start)) if start else F.col("_from")
    months = F.when(begin <= F.col("_to"), F.sequence(begin, F.col("_to"), F.expr("interval 1 month")))
    return with_scalars(entities, span).withColumn(period, F.explode(months)).drop("_from", "_to")


def by_month(rules: DataFrame, start: str, end: str, period: str) -> DataFrame:
    """Effective-dated rules, one row per month they are valid in, so period joins are equi joins."""
    months = F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))
    exploded = rules.withColumn(period, F.explode(months))
    return exploded.filter((F.col(start) <= F.col(period)) & (F.col(end) >= F.col(period)))


def effective_join(df: DataFrame, rules: DataFrame, period: str, start: str, end: str) -> DataFrame:
    """Each row with every rule valid on the first day of its period."""
    return df.join(by_month(rules, start, end, period), [period], "left")


def tier_join(df: DataFrame, row_key: Sequence[str], rules: DataFrame, period: str, start: str, end: str,
              value: Column, lower: str, upper: str) -> DataFrame:
    """The valid rule tier with lower <= value < upper; the top tier when none matches."""
    candidates = effective_join(df.withColumn("_value", value), rules, period, start, end)
    hit = (F.col(lower) <= F.col("_value")) & (F.col("_value") < F.col(upper))
    rule_columns = [c for c in rules.columns if c not in df.columns]
    # Matching tiers first, lowest wins; otherwise the tier with the highest lower bound.
    order = F.struct(F.when(hit, 0).otherwise(1), F.when(hit, F.col(lower)).otherwise(-F.col(lower)))
    return candidates.groupBy(*row_key).agg(
        *[F.first(c).alias(c) for c in df.columns if c not in row_key],
        F.min_by(F.struct(*rule_columns), order).alias("_rule"),
    ).select(*df.columns, *[F.col(f"_rule.{c}").alias(c) for c in rule_columns])


def latest_before(probes: DataFrame, facts: DataFrame, keys: Sequence[str], day: str, tie: str, payload: Sequence[str],
                  out: str) -> DataFrame:
    """As-of join on day granularity: the last fact (by day, then ``tie``) on or before the probe's day.

    Facts collapse to their last row per key and day first, so the ordered window of one key
    holds calendar days, never raw rows.
    """
    # probes' days without a fact and facts meet in one grouping; within a day the last row is the one with the highest tie
    row = F.struct(F.col(tie), *[c for c in payload if c != tie])
    days = facts.select(*keys, day, row.alias("_row")).unionByName(probes.select(*keys, day), allowMissingColumns=True)
    timeline = days.groupBy(*keys, day).agg(F.max("_row").alias("_row"))
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    resolved = timeline.withColumn(out, F.last("_row", ignorenulls=True).over(w)).drop("_row")
    return null_safe_join(probes, resolved, [*keys, day], "left")


def latest_with_ladder(probes: DataFrame, facts: DataFrame, ladder: Sequence[Sequence[str]], day: str, tie: str,
                       payload: Sequence[str]) -> DataFrame:
    """As-of join trying each key list in turn; ``match_level`` tells which one hit (0 = none)."""
    for i, keys in enumerate(ladder, 1):
        probes = latest_before(probes, facts, keys, day, tie, payload, f"_hit{i}")
    hits = [F.col(f"_hit{i}") for i in range(1, len(ladder) + 1)]
    level = F.lit(0)
    for i in range(len(ladder), 0, -1):
        level = F.when(F.col(f"_hit{i}").isNotNull(), i).otherwise(level)
    best = F.coalesce(*hits)
    plain = [c for c in probes.columns if not c.startswith("_hit")]
    return probes.withColumn("_best", best).withColumn("match_level", level).select(
        *plain, "match_level", *[F.col(f"_best.{p}").alias(f"linked_{p}") for p in payload])


def shifted(df: DataFrame, keys: Sequence[str], period: str, months: int, columns: Mapping[str, str]) -> DataFrame:
    """Self join on the calendar: the columns of the row ``months`` later (negative: earlier)."""
    moved = df.select(*keys, F.add_months(period, -months).alias(period), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(moved, [*keys, period], "left")


def coverage_check(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only on the left, only on the right, on both."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    sides = a.join(b, list(keys), "full_outer")
    return sides.agg(
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("both"))


def pair_by_rank(left: DataFrame, left_score: str, right: DataFrame, right_score: str, group: Sequence[str], tie: str) -> DataFrame:
    """Pair the n-th of one side with the n-th of the other inside each group."""
    a = row_numbers(left.select(*group, F.col(tie).alias("receiver"), F.col(left_score).alias("receiver_score")),
                    "receiver_score", "receiver", "pair", group)
    b = row_numbers(right.select(*group, F.col(tie).alias("donor"), F.col(right_score).alias("donor_score")),
                    "donor_score", "donor", "pair", group)
    return a.join(b, [*group, "pair"])


def interpolate(probes: DataFrame, reference: DataFrame, keys: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Piecewise-linear lookup of ``x`` in the reference points (x, y); flat outside their range.

    Reference and probe values share order-preserving buckets; neighbours are found inside a
    bucket and carried across buckets through one small row per bucket.
    """
    values = (
        reference.select(*keys, x, F.col(y).alias("_y"))
        .unionByName(probes.select(*keys, x).withColumn("_y", F.lit(None).cast("double")))
        .filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.max("_y").alias("_y"))
    )
    cut = in_ranges(values, keys, x)
    point = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    edges = cut.groupBy(*keys, "_bucket").agg(F.max(point).alias("_top"), F.min(point).alias("_bottom"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        *keys, "_bucket", F.last("_top", ignorenulls=True).over(before).alias("_from_before"),
        F.last("_bottom", ignorenulls=True).over(after).alias("_from_after"))
    # a frame that runs to the end is summed anew for every row, so what follows is looked up in falling order
    inside = W.partitionBy(*keys, "_bucket")
    near = cut.select(
        *keys, x, "_bucket",
        F.last(point, ignorenulls=True).over(inside.orderBy(x).rowsBetween(W.unboundedPreceding, 0)).alias("_lo"),
        F.last(point, ignorenulls=True).over(inside.orderBy(F.col(x).desc()).rowsBetween(W.unboundedPreceding, 0)).alias("_hi"))
    near = null_safe_join(near, carried, [*keys, "_bucket"], "inner")
    lo, hi = F.coalesce("_lo", "_from_before"), F.coalesce("_hi", "_from_after")
    near = near.withColumn("_a", F.coalesce(lo, hi)).withColumn("_b", F.coalesce(hi, lo))
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a["x"] == b["x"], a["y"]).otherwise(
        a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / F.when(a["x"] != b["x"], b["x"] - a["x"]))
    return null_safe_join(probes, near.select(*keys, x, line.alias(out)), [*keys, x], "left")


def resolve_by_ladder(truth: DataFrame, truth_id: str, records: DataFrame, record_id: str,
                      id_list: str, ladder: Sequence[Sequence[str]]) -> DataFrame:
    """(truth_id, record_id, basis): listed ids first, else the first key list that is filled in.

    A truth row that lists ids never falls through to the broader keys.
    """
    listed = truth.filter(F.size(id_list) > 0).select(truth_id, F.explode(id_list).alias(record_id)).distinct()
    out = listed.join(records.select(record_id), [record_id], "left_semi").select(
        truth_id, record_id, F.lit("record").alias("basis"))
    rest = truth.filter(F.col(id_list).isNull() | (F.size(id_list) <= 0))
    for keys in ladder:
        filled = F.lit(True)
        for k in keys:
            filled = filled & F.col(k).isNotNull()
        now = rest.filter(filled).select(truth_id, *keys)
        out = out.unionByName(now.join(records.select(*keys, record_id), list(keys)).select(
            truth_id, record_id, F.lit("+".join(keys)).alias("basis")))
        rest = rest.filter(~filled)
    return out


def assign_representatives(transactions: DataFrame, org: Sequence[str], customer: str, reps_per_org: int, seed: int) -> DataFrame:
    """Each customer of an organisation unit to one of its slots by a stable hash; slots get ids."""
    if reps_per_org < 1:
        raise ValueError("reps_per_org must be positive")
    token = F.concat_ws("|", *[F.col(c).cast("string") for c in [*org, customer]])
    slot = stable_integer(token, seed, reps_per_org)
    customers = transactions.select(*org, customer).distinct().withColumn("rep_slot", slot)
    units = transactions.select(*org).distinct()
    slots = units.withColumn("rep_slot", F.explode(F.sequence(F.lit(0), F.lit(reps_per_org - 1)).cast("array<bigint>")))
    parts = [F.col(c).cast("string") for c in org] + [F.col("rep_slot").cast("string")]
    slots = slots.withColumn("assigned_rep", F.concat_ws("/", *parts))
    mapping = customers.join(slots, [*org, "rep_slot"], "left")
    return transactions.join(mapping, [*org, customer], "left")
