import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.functions import month_from_parts, payout_multiplier, strict_bool, with_formulas
from quotalens.operators import detectors as D, history as H, planning as P, quality as Q, shares as S


def months(n, start=2017):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def series(spark, values, skip=()):
    rows = [(f"o{i}", "r", "c", d, float(v)) for i, (d, v) in enumerate(zip(months(len(values)), values)) if i not in skip]
    return spark.createDataFrame(rows, "observation_id string, rep string, cls string, date date, x double")


def test_month_words(spark):
    df = spark.createDataFrame([("2019", "March"), ("2019", "mar"), ("2019", "3"), ("2019", "bad"), ("x", "3"), ("2019", "13")], "y string, m string")
    got = [r[0] for r in df.select(month_from_parts("y", "m")).collect()]
    assert got == [dt.date(2019, 3, 1)] * 3 + [None] * 3


def test_calendar_lag_does_not_bridge_a_gap(spark):
    df = series(spark, range(1, 7), skip=(2,))
    lag = {r["date"]: r["l"] for r in df.withColumn("l", H.calendar_lag("x", 1, ["rep"], "date")).collect()}
    assert lag[dt.date(2017, 4, 1)] is None and lag[dt.date(2017, 5, 1)] == 4.0


def recursive(values, window=6, least=3, alpha=.3, drift=.5):
    """Plain replay of one series: rolling residual, EWMA residual and level shift."""
    out, hist, ewma, up, down = [], [], None, 0.0, 0.0
    for x in values:
        h = np.array(hist[-window:])
        enough = len(h) >= least
        center = np.median(h) if len(h) else 0
        scale = max(1.4826 * np.median(abs(h - center)), abs(center) * .1, 1) if len(h) else 1
        r = (x - center) / scale if enough else 0
        up, down = (max(0, up + r - drift), max(0, down - r - drift)) if enough else (0, 0)
        prev = (hist[-1] - np.median(hist[-window - 1:-1])) / scale if len(hist) > least else 0
        out.append((abs(r), abs(x - ewma) / scale if enough else 0, max(up, down) if r * prev > 0 and abs(prev) > 1 else 0))
        hist.append(x)
        ewma = x if ewma is None else alpha * x + (1 - alpha) * ewma
    return np.array(out)


def test_detectors_equal_the_replay(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(100, 15, 18), rng.normal(1000, 60, 12)])
    d = D.temporal_details(series(spark, values), "observation_id", ["rep", "cls"], "date", ["x"]).toPandas()
    wide = d.pivot(index="date", columns="model", values="score").sort_index()
    got = wide[["Rolling Residual", "EWMA Residual", "Change-Point / Level Shift"]].to_numpy()
    assert np.allclose(got, recursive(values))
    assert got[:18, 2].max() < got[19:, 2].max()


def test_future_rows_do_not_change_history(spark):
    a = series(spark, np.arange(30) * 3.0 + 5)
    b = a.withColumn("x", F.when(F.col("date") > "2018-06-01", F.col("x") * 9 + 1).otherwise(F.col("x")))
    build = lambda df: H.metric_history(df, "x", ["rep", "cls"], "date")
    columns = [c for c in build(a).columns if c.startswith("x")]
    assert Q.no_future_leakage(build(a), build(b), "date", "2018-06-01", "observation_id", columns).first()["status"] == "pass"
    leaky = lambda df: df.withColumn("x_all", F.avg("x").over(H.W.partitionBy("rep")))
    assert Q.no_future_leakage(leaky(a), leaky(b), "date", "2018-06-01", "observation_id", ["x_all"]).first()["status"] == "fail"


def test_forecasts(spark):
    df = P.one_step_forecasts(series(spark, list(range(1, 14)) + [0]), ["rep"], "date", "x")
    last = df.filter(F.col("date") == dt.date(2018, 2, 1)).first()
    assert last["seasonal_naive"] == 2.0 and last["moving_average"] == pytest.approx(12.0)
    e = 1.0
    for v in range(2, 14):
        e = .3 * v + .7 * e
    assert last["exponential_smoothing"] == pytest.approx(e)


def test_smoothing_of_a_long_series_stays_finite(spark):
    values = [float(v % 17) for v in range(2600)]
    rows = [("r", dt.date(1900 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(values)]
    got = P.one_step_forecasts(spark.createDataFrame(rows, "rep string, date date, x double"), ["rep"], "date", "x").orderBy("date").toPandas()
    e, want = None, []
    for v in values:
        want.append(0.0 if e is None else e)
        e = v if e is None else .3 * v + .7 * e
    assert np.allclose(got["exponential_smoothing"], want)


def test_staffing_need(spark):
    row = spark.createDataFrame([(300.0, 100.0, 2.0)], "w double, c double, f double").select(*[e.alias(n) for n, e in P.staffing_need("w", "c", "f").items()]).first()
    assert (row["required_fte"], row["fte_gap"], row["utilization"]) == (3.0, 1.0, 1.5)


def test_mix_shift_first_period_modes(spark):
    rows = [("r", d, c, v) for d, c, v in zip([dt.date(2020, 1, 1)] * 2 + [dt.date(2020, 3, 1)] * 2, "abac", (50., 50., 50., 50.))]
    df = spark.createDataFrame(rows, "r string, d date, c string, v double")
    get = lambda **k: [x["s"] for x in S.mix_shift(df, ["r"], "d", "c", "v", "s", **k).orderBy("d").collect()]
    assert get() == [0.0, 0.5] and get(basis="net", first="empty") == [0.5, 0.5]


def test_strict_boolean_rejects_other_words(spark):
    with pytest.raises(Exception, match="ambiguous"):
        spark.createDataFrame([("maybe",)], "b string").select(strict_bool("b")).collect()


def test_formulas_reject_anything_but_arithmetic(spark):
    df = spark.range(1).withColumn("a", F.lit(2.0))
    assert with_formulas(df, {"b": "greatest(a * k, 1)"}, {"k": 3.0}).first()["b"] == 6.0
    for bad in ("a; drop table x", "reflect(a)", "missing + 1", "a -- b"):
        with pytest.raises(ValueError):
            with_formulas(df, {"b": bad})


def test_payout_multiplier_points(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.7, 0.9, 1.0, 1.2, 5.0)], "a double")
    assert [round(r[0], 6) for r in df.select(payout_multiplier("a")).collect()] == [0.0, 0.6, 0.8, 1.0, 1.3, 2.0]
