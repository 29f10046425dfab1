"""Category shares, concentration, mix shift and customer flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.functions import ratio_or
from quotalens.operators.ranking import null_safe_join


def category_weights(df: DataFrame, keys: Sequence[str], category: str, value: str, basis: str = "gross") -> DataFrame:
    """(keys, category, weight, rows).  ``gross`` sums absolute values, ``net`` takes |sum|."""
    weight = F.sum(F.abs(F.col(value))) if basis == "gross" else F.abs(F.sum(value))
    return df.groupBy(*keys, category).agg(weight.alias("weight"), F.count(F.lit(1)).alias("rows"))


def category_shares(df: DataFrame, keys: Sequence[str], category: str, value: str) -> DataFrame:
    """Share of absolute value per category; share of rows where all values are zero."""
    weights = category_weights(df, keys, category, value)
    totals = weights.groupBy(*keys).agg(F.sum("weight").alias("_weight"), F.sum("rows").alias("_rows"))
    joined = null_safe_join(weights, totals, keys, "inner")
    share = F.when(F.col("_weight") > 0, F.col("weight") / F.col("_weight")).otherwise(F.col("rows") / F.col("_rows"))
    return joined.select(*keys, category, "weight", share.alias("share"))


def concentration(df: DataFrame, keys: Sequence[str], category: str, value: str, prefix: str,
                  basis: str = "gross") -> DataFrame:
    """HHI, diversity (1 − HHI) and dominant share from sums and sums of squares; no share table.

    ``gross``: absolute value shares with row shares as fallback.  ``net``: |net| shares with the
    total floored at one.
    """
    weights = category_weights(df, keys, category, value, basis)
    g = weights.groupBy(*keys).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.max("weight").alias("wm"),
        F.sum("rows").cast("double").alias("n"), F.sum(F.col("rows") * F.col("rows")).alias("n2"), F.max("rows").alias("nm"),
    )
    if basis == "gross":
        hhi = F.when(F.col("w") > 0, F.col("w2") / (F.col("w") * F.col("w"))).otherwise(F.col("n2") / (F.col("n") * F.col("n")))
        top = F.when(F.col("w") > 0, F.col("wm") / F.col("w")).otherwise(F.col("nm") / F.col("n"))
    else:
        total = F.greatest(F.col("w"), F.lit(1.0))
        hhi, top = F.col("w2") / (total * total), F.col("wm") / total
    return g.select(*keys, hhi.alias(f"{prefix}_hhi"), (1 - hhi).alias(f"{prefix}_diversity"), top.alias(f"{prefix}_top_share"))


def signed_concentration(df: DataFrame, keys: Sequence[str], category: str, value: str, out: str) -> DataFrame:
    """Sum of squared signed shares of the net total; 0 where the total vanishes."""
    sums = df.groupBy(*keys, category).agg(F.sum(value).alias("v"))
    g = sums.groupBy(*keys).agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("v2"))
    safe = ratio_or(F.lit(1.0), F.col("v"))
    return g.select(*keys, (F.col("v2") * safe * safe).alias(out))


def entropy_proxy(hhi):
    return -F.log(F.greatest(F.col(hhi) if isinstance(hhi, str) else hhi, F.lit(1e-9)))


def next_period(df: DataFrame, series: Sequence[str], period: str, out: str = "_next") -> DataFrame:
    """Observed periods per series with the following observed one (one row per month)."""
    periods = df.select(*series, period).distinct()
    return periods.withColumn(out, F.lead(period).over(W.partitionBy(*series).orderBy(period)))


def mix_shift(df: DataFrame, series: Sequence[str], period: str, category: str, value: str, out: str,
              basis: str = "gross", first: str = "zero") -> DataFrame:
    """Half the L1 distance to the previous observed period's shares.

    ``first="zero"``: the first period has no shift.  ``first="empty"``: it is compared with
    an empty mix, giving 0.5.
    Current shares and the previous ones (re-dated to the period they are compared in) are added
    with opposite signs per category, so no wide pivot and no outer join is needed.
    """
    keys = [*series, period]
    if basis == "gross":
        shares = category_shares(df, keys, category, value).select(*keys, category, "share")
    else:
        weights = category_weights(df, keys, category, value, "net")
        totals = weights.groupBy(*keys).agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("_total"))
        shares = null_safe_join(weights, totals, keys, "inner").select(
            *keys, category, (F.col("weight") / F.col("_total")).alias("share"))
    steps = next_period(shares, series, period)
    moved = (
        null_safe_join(shares, steps, keys, "inner").filter(F.col("_next").isNotNull())
        .select(*series, F.col("_next").alias(period), category, (-F.col("share")).alias("share"), F.lit(0).alias("_now"))
    )
    both = shares.select(*keys, category, "share", F.lit(1).alias("_now")).unionByName(moved)
    # One row per side exists at most; subtracting two maxima keeps the difference exact.
    sides = both.groupBy(*keys, category).agg(
        F.coalesce(F.max(F.when(F.col("_now") == 1, F.col("share"))), F.lit(0.0)).alias("_cur"),
        F.coalesce(F.max(F.when(F.col("_now") == 0, -F.col("share"))), F.lit(0.0)).alias("_prev"),
        F.max("_now").alias("_now"),
    )
    shift = sides.groupBy(*keys).agg((0.5 * F.sum(F.abs(F.col("_cur") - F.col("_prev")))).alias(out))
    if first == "zero":
        starts = shares.groupBy(*series).agg(F.min(period).alias("_first"))
        shift = (
            null_safe_join(shift, starts, series, "inner")
            .withColumn(out, F.when(F.col(period) == F.col("_first"), F.lit(0.0)).otherwise(F.col(out))).drop("_first")
        )
    return shift


def customer_flow(df: DataFrame, series: Sequence[str], period: str, member: str) -> DataFrame:
    """New, repeat and lost members per series and period, with the repeat ratio and loss rate.

    Lost means present in the previous observed period and absent now.
    """
    keys = [*series, period]
    present = df.select(*keys, member).distinct()
    firsts = present.groupBy(*series, member).agg(F.min(period).alias("_first"))
    current = null_safe_join(present, firsts, [*series, member], "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.when(F.col("_first") == F.col(period), 1).otherwise(0)).alias("new_members"),
    )
    steps = next_period(present, series, period)
    carried = null_safe_join(present, steps, keys, "inner").filter(F.col("_next").isNotNull()).select(
        *series, F.col("_next").alias(period), member, F.lit(1).alias("_before"), F.lit(0).alias("_now"))
    sides = (
        present.select(*keys, member, F.lit(0).alias("_before"), F.lit(1).alias("_now")).unionByName(carried)
        .groupBy(*keys, member).agg(F.max("_before").alias("_before"), F.max("_now").alias("_now"))
    )
    lost = sides.groupBy(*keys).agg(
        F.sum("_before").alias("_prior"),
        F.sum(F.when((F.col("_before") == 1) & (F.col("_now") == 0), 1).otherwise(0)).alias("lost_members"),
    )
    joined = null_safe_join(current, lost, keys, "inner")
    return joined.select(
        *keys, "members", "new_members", (F.col("members") - F.col("new_members")).alias("repeat_members"), "lost_members",
        ((F.col("members") - F.col("new_members")) / F.col("members")).alias("repeat_ratio"),
        (F.col("lost_members") / F.greatest(F.lit(1), F.col("_prior"))).alias("loss_rate"),
    )


def dominant_member(df: DataFrame, keys: Sequence[str], member: str, out: str, weight: str | None = None) -> DataFrame:
    """The member with most rows (or most weight); ties go to the smallest member."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(member).isNotNull()).groupBy(*keys, member).agg(amount.alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(member, F.struct(-F.col("_n"), F.col(member))).alias(out))


def member_summary(rows: DataFrame, keys: Sequence[str], dominant: Sequence[str], concentrated: Sequence[tuple[str, str]], counted: Mapping[str, str],
                   n: str, value: str, more: Sequence[Column]) -> DataFrame:
    """Dominant members, signed concentrations and distinct members of several columns at one grain: rows are moved once, by the grain.

    ``rows`` has one row per grain and combination of members, dealt by the grain, with their number ``n`` and the sum ``value``;
    each column's members are summed beside the rows there, so nothing is joined.  ``more`` are further aggregates of the grain.
    """
    members = dict.fromkeys([*dominant, *(c for c, _ in concentrated), *counted.values()])
    for c in members:
        one = W.partitionBy(*keys, c)
        rows = rows.withColumns({f"_n_{c}": F.sum(n).over(one), f"_v_{c}": F.sum(value).over(one), f"_once_{c}": F.row_number().over(one.orderBy(c)) == 1})
    once = lambda c, x: F.sum(F.when(F.col(f"_once_{c}"), x))
    aggregates = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col(f"_n_{c}"), F.col(c)))).alias(c) for c in dominant]
    for c, out in concentrated:
        v = F.col(f"_v_{c}")
        safe = ratio_or(F.lit(1.0), once(c, v))
        aggregates.append((once(c, v * v) * safe * safe).alias(out))
    aggregates += [F.coalesce(once(c, F.when(F.col(c).isNotNull(), 1)), F.lit(0)).cast("long").alias(out) for out, c in counted.items()]
    return rows.groupBy(*keys).agg(*more, *aggregates)


def member_history(rows: DataFrame, series: Sequence[str], period: str, value: str, dominant: Sequence[str], gross: Mapping[str, str], counted: Mapping[str, str],
                   shifted: Mapping[str, str], flow: str, more: Sequence[Column]) -> DataFrame:
    """What :func:`dominant_member`, :func:`concentration` (gross), :func:`mix_shift` (gross, first zero) and :func:`customer_flow` say of several columns, one
    row per series and period.

    The rows are moved once, by the series: each column's members are summed beside them, a member's earlier period is the last one before it, and what a
    period lost against the one before is that one's total less what came along.  ``dominant`` columns keep their names; ``gross`` gives the prefix of
    {prefix}_hhi and {prefix}_top_share, ``counted`` {name: column}, ``shifted`` {column: name}.  ``more`` are further aggregates of the period's rows, which
    may use the sum of absolute values of its period, ``_gross``, and of a member, ``_w_{column}``, null but on one row of each member, as is its number of rows ``_n_{column}``.
    """
    # a row without a period lies before all others
    before_all = F.lit(-(2 ** 31) + 1)
    rows = rows.repartition(*series).withColumns({"_at": F.coalesce(F.unix_date(F.col(period).cast("date")), before_all), "_abs": F.abs(F.col(value))})
    everything, earlier = (W.unboundedPreceding, W.unboundedFollowing), (W.unboundedPreceding, -1)
    timeline = W.partitionBy(*series).orderBy("_at")
    whole = W.partitionBy(*series, "_at").rowsBetween(*everything)
    rows = rows.withColumns({"_gross": F.sum("_abs").over(whole), "_all": F.count(F.lit(1)).over(whole), "_before": F.max("_at").over(timeline.rangeBetween(*earlier))})
    histories = dict.fromkeys([flow, *shifted])
    for c in dict.fromkeys([*histories, *gross, *counted.values(), *dominant]):
        one = W.partitionBy(*series, c, "_at").orderBy("_at")
        rows = rows.withColumns({"_w": F.sum("_abs").over(one.rowsBetween(*everything)), "_n": F.count(F.lit(1)).over(one.rowsBetween(*everything)), "_i": F.row_number().over(one)})
        if c in histories:
            along = W.partitionBy(*series, c).orderBy("_at").rangeBetween(*earlier)
            share = F.coalesce(F.when(F.col("_gross") > 0, F.col("_w") / F.col("_gross")).otherwise(F.col("_n") / F.col("_all")), F.lit(0.0))
            rows = rows.withColumn("_share", share).withColumns({"_last": F.max("_at").over(along), "_then": F.last("_share").over(along)})
            rows = rows.withColumns({f"_last_{c}": F.col("_last"), f"_s_{c}": F.when(F.col("_i") == 1, F.col("_share")), f"_then_{c}": F.when(F.col("_last") == F.col("_before"), F.col("_then"))})
        rows = rows.withColumns({f"_w_{c}": F.when(F.col("_i") == 1, F.col("_w")), f"_n_{c}": F.when(F.col("_i") == 1, F.col("_n"))}).drop("_w", "_n", "_i", "_share", "_last", "_then")
    once = lambda c: F.col(f"_n_{c}").isNotNull()
    number = lambda condition: F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")
    carried = lambda c: once(c) & F.col(f"_then_{c}").isNotNull()
    out = [F.min_by(c, F.when(F.col(c).isNotNull() & once(c), F.struct(-F.col(f"_n_{c}"), F.col(c)))).alias(c) for c in dominant]
    out += [number(once(c) & F.col(c).isNotNull()).alias(name) for name, c in counted.items()]
    for c, prefix in gross.items():
        w, n = F.col(f"_w_{c}"), F.col(f"_n_{c}")
        total, rows_of = F.sum(w), F.sum(n).cast("double")
        hhi = F.when(total > 0, F.sum(w * w) / (total * total)).otherwise(F.sum(n * n) / (rows_of * rows_of))
        top = F.when(total > 0, F.max(w) / total).otherwise(F.max(n) / rows_of)
        out += [hhi.alias(f"{prefix}_hhi"), (1 - hhi).alias(f"{prefix}_diversity"), top.alias(f"{prefix}_top_share")]
    seen = F.col(f"_last_{flow}")
    out += [number(once(flow)).alias("members"), number(once(flow) & (seen.isNull() | (seen == before_all)) & F.col(period).isNotNull()).alias("new_members"), number(carried(flow)).alias("_stayed")]
    for c in shifted:
        moved = F.when(once(c), F.abs(F.col(f"_s_{c}") - F.coalesce(f"_then_{c}", F.lit(0.0))))
        out += [F.sum(moved).alias(f"_moved_{c}"), F.sum(f"_s_{c}").alias(f"_sum_{c}"), number(once(c)).alias(f"_members_{c}"),
                number(carried(c)).alias(f"_came_{c}"), F.sum(F.when(carried(c), F.col(f"_then_{c}"))).alias(f"_came_share_{c}")]
    periods = rows.groupBy(*series, "_at", period).agg(*more, *out)
    previous = lambda c: F.coalesce(F.lag(c).over(timeline), F.lit(0))
    lost = previous("members") - F.col("_stayed")
    first = F.col(period) == F.min(period).over(W.partitionBy(*series))
    shifts = {}
    for c, name in shifted.items():
        gone = previous(f"_sum_{c}") - F.coalesce(f"_came_share_{c}", F.lit(0.0))
        gone = F.when(previous(f"_members_{c}") > F.col(f"_came_{c}"), F.greatest(gone, F.lit(0.0))).otherwise(0.0)
        shifts[name] = F.when(first, F.lit(0.0)).otherwise(0.5 * (F.col(f"_moved_{c}") + gone))
    periods = periods.withColumns({**shifts, "lost_members": lost, "loss_rate": lost / F.greatest(F.lit(1), previous("members")),
                                   "repeat_members": F.col("members") - F.col("new_members"), "repeat_ratio": (F.col("members") - F.col("new_members")) / F.col("members")})
    return periods.drop("_at", "_stayed", *[f"_{x}_{c}" for c in shifted for x in ("moved", "sum", "members", "came", "came_share")])


def first_purchases(df: DataFrame, owner: str, customer: str, period: str, value: str, out: str) -> DataFrame:
    """Customers whose first positive purchase from the owner falls in the period."""
    firsts = df.filter(F.col(value) > 0).groupBy(owner, customer).agg(F.min(period).alias(period))
    return firsts.groupBy(owner, period).agg(F.count(F.lit(1)).alias(out))
