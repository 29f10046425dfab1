"""Past-only windows over one series per key, at one row per period.

A series has at most one row per calendar month, so these windows stay small whatever the
size of the fact behind them; callers aggregate to the series grain first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quotalens.functions import finite_or_null, month_index, ratio_floored


def calendar_frame(keys: Sequence[str], period: str, start: int, end: int):
    """Window over calendar months relative to the current one; missing months stay missing."""
    return W.partitionBy(*keys).orderBy(month_index(period)).rangeBetween(start, end)


def row_frame(keys: Sequence[str], period: str, start: int, end: int):
    """Window over the rows that exist, oldest first."""
    return W.partitionBy(*keys).orderBy(period).rowsBetween(start, end)


def calendar_lag(c: str, months: int, keys: Sequence[str], period: str) -> Column:
    """The value exactly ``months`` months ago, null when that month has no row."""
    return F.first(c).over(calendar_frame(keys, period, -months, -months))


def calendar_prior(c: str, months: int, statistic: str, keys: Sequence[str], period: str, at_least: int = 1) -> Column:
    """mean / median / std / sum over the prior ``months`` calendar months."""
    w = calendar_frame(keys, period, -months, -1)
    value = {
        "mean": F.avg(c), "sum": F.sum(c), "std": F.stddev_samp(c),
        "median": F.percentile(c, F.lit(0.5)),
    }[statistic].over(w)
    return F.when(F.count(c).over(w) >= at_least, value)


def row_prior(c: str, rows: int, statistic: str, keys: Sequence[str], period: str, at_least: int = 1) -> Column:
    """The same over the last ``rows`` rows present before the current one."""
    w = row_frame(keys, period, -rows, -1)
    value = {
        "mean": F.avg(c), "sum": F.sum(c), "std": F.stddev_samp(c),
        "median": F.percentile(c, F.lit(0.5)),
    }[statistic].over(w)
    return F.when(F.count(c).over(w) >= at_least, value)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: what a lambda names from outside is worked out anew each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of an array of non-null numbers; null when empty."""
    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        at = lambda end: F.element_at(ordered, end((n + 1) / 2).cast("int"))
        return F.when(n > 0, (at(F.floor) + at(F.ceil)) / 2.0)

    return _bound(F.sort_array(values), middle)


def array_mad(values: Column) -> Column:
    """Median absolute deviation from the median of an array."""
    return _bound(array_median(values), lambda center: array_median(F.transform(values, lambda v: F.abs(v - center))))


def calendar_prior_mad(c: str, months: int, keys: Sequence[str], period: str, at_least: int = 3) -> Column:
    values = F.collect_list(c).over(calendar_frame(keys, period, -months, -1))
    return F.when(F.size(values) >= at_least, array_mad(values))


def percent_change(c: str, keys: Sequence[str], period: str, limit: float = 10.0) -> Column:
    """Change against the previous row, 0 when undefined or infinite, clipped to ±limit."""
    previous = F.lag(c).over(W.partitionBy(*keys).orderBy(period))
    change = F.try_divide(F.col(c) - previous, previous)
    return F.greatest(F.least(F.coalesce(finite_or_null(change), F.lit(0.0)), F.lit(limit)), F.lit(-limit))


def prior_total(c: str, keys: Sequence[str], period: str) -> Column:
    """Sum of all earlier rows, 0 at the start."""
    w = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0.0))


def prior_expanding_median(c: str, keys: Sequence[str], period: str) -> Column:
    w = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    return F.percentile(c, F.lit(0.5)).over(w)


def exact_window_sum(c: str, months: int, keys: Sequence[str], period: str, ending: int = 0) -> Column:
    """Sum over ``months`` calendar months ending ``ending`` months from now; null unless complete."""
    w = calendar_frame(keys, period, ending - months + 1, ending)
    return F.when(F.count(c).over(w) == months, F.sum(c).over(w))


def recent_growth(c: str, months: int, keys: Sequence[str], period: str) -> Column:
    """Mean of the last ``months`` over the mean of the ones before, minus one; all must exist."""
    recent = exact_window_sum(c, months, keys, period)
    before = exact_window_sum(c, months, keys, period, -months)
    return F.when(before > 0, recent / before - 1)


def change_from_previous(c: str, keys: Sequence[str], period: str) -> Column:
    return F.col(c) - F.lag(c).over(W.partitionBy(*keys).orderBy(period))


def repeated_flags(flag: str, rows: int, keys: Sequence[str], period: str) -> Column:
    """How many of the previous ``rows`` rows were flagged."""
    w = row_frame(keys, period, -rows, -1)
    return F.coalesce(F.sum(F.col(flag).cast("int")).over(w), F.lit(0))


def seasonal_index(c: str, period: str, keys: Sequence[str] = (), low: float = 0.7, high: float = 1.3) -> Column:
    """Mean of earlier rows of the same calendar month over the mean of all earlier rows, clipped.

    The input is one row per (key, month); without keys that is a single short monthly series.
    """
    before = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(*keys, F.month(period)).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    index = F.when(F.abs(F.avg(c).over(before)) >= 1e-12, F.avg(c).over(same) / F.avg(c).over(before))
    return F.least(F.greatest(F.coalesce(index, F.lit(1.0)), F.lit(low)), F.lit(high))


def metric_history(df: DataFrame, metric: str | Sequence[str], keys: Sequence[str], period: str) -> DataFrame:
    """The past-only columns of one metric or several: lags, rolling statistics, growth, trend, deviation.

    All windows stand in one projection, so the rows are sorted once and not once per column.
    """
    windows, growth, rest, order = {}, {}, {}, []
    for m in [metric] if isinstance(metric, str) else metric:
        c = lambda suffix: F.col(f"{m}_{suffix}")
        past = {f"{m}_lag_{n}": calendar_lag(m, n, keys, period) for n in (1, 2, 3, 6, 12)}
        past |= {f"{m}_rolling_mean_{n}": calendar_prior(m, n, "mean", keys, period) for n in (3, 6)}
        past |= {
            f"{m}_rolling_median": calendar_prior(m, 6, "median", keys, period, 2),
            f"{m}_rolling_std": calendar_prior(m, 6, "std", keys, period, 2),
            f"{m}_rolling_MAD": calendar_prior_mad(m, 6, keys, period, 3)}
        scale = F.greatest(1.4826 * c("rolling_MAD"), F.abs(c("rolling_median")) * 0.1)
        known = c("rolling_MAD").isNotNull() & c("rolling_median").isNotNull()
        change = {
            f"{m}_month_over_month_growth": ratio_floored(F.col(m) - c("lag_1"), c("lag_1")),
            f"{m}_year_over_year_growth": ratio_floored(F.col(m) - c("lag_12"), c("lag_12")),
            f"{m}_trend": ratio_floored(c("lag_1") - c("lag_3"), c("lag_3"))}
        last = {
            f"{m}_acceleration": c("month_over_month_growth") - ratio_floored(c("lag_1") - c("lag_2"), c("lag_2")),
            f"{m}_history_deviation": F.when(known, ratio_floored(F.col(m) - c("rolling_median"), scale))}
        windows, growth, rest, order = windows | past, growth | change, rest | last, [*order, *past, *change, *last]
    kept = [c for c in df.columns if c not in order]
    return df.withColumns(windows).withColumns(growth).withColumns(rest).select(*kept, *order)
