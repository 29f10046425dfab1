"""The class population is dealt once, by series, and says what the single operators say."""

import datetime as dt

from pyspark.sql import functions as F

from quotalens.operators import features as X, shares as S
from quotalens.operators.ranking import null_safe_join

GRAIN = ["representative", "product_class", "date"]


def lines(spark):
    day = lambda m: dt.date(2000, m, 1) if m else None
    rows = []
    for n in range(240):
        rep, m = f"r{n % 3}", (1, 2, 4, 7, None)[n // 3 % 5]
        i = (n * 7919 + n * n * 31) % 1009
        rows.append((rep, "m" if i % 7 else None, f"t{i % 2}", f"land{i % 4}", day(m), f"c{n // 15 % 2}" if n % 31 else None, i * 7 % 11 if i % 13 else None, i * 5 % 6, f"d{i * 3 % 4}",
                     f"ch{i % 3}", None, f"city{i % 4}", float(i % 9), float(i % 5), float(i % 10), float(i % 6), 0.0 if i % 3 == 1 else float(i * 37 % 50 - 20)))
    return spark.createDataFrame(rows, "representative string, manager string, team string, country string, date date, product_class string, customer long, product long, distributor string, "
                                       "channel string, subchannel string, city string, latitude double, longitude double, quantity double, price double, sales double")


def test_class_population_moves_its_rows_once(spark):
    plan = X.class_population(lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_class_population_agrees_with_the_single_operators(spark):
    tx = lines(spark)
    got = X.class_population(tx).filter("date IS NOT NULL AND product_class IS NOT NULL")
    series = GRAIN[:2]
    flow = S.customer_flow(tx, series, "date", "customer").select(*GRAIN, F.col("new_members").alias("a"), F.col("repeat_ratio").alias("b"), F.col("loss_rate").alias("c"))
    want = [flow, S.mix_shift(tx, series, "date", "product", "sales", "d"), S.mix_shift(tx, series, "date", "distributor", "sales", "e"), S.dominant_member(tx, GRAIN, "manager", "f")]
    want += [S.concentration(tx, GRAIN, c, "sales", c).select(*GRAIN, f"{c}_{x}") for c, x in (("product", "hhi"), ("product", "top_share"), ("country", "diversity"), ("customer", "hhi"))]
    for other in want:
        got = null_safe_join(got, other, GRAIN, "left")
    pairs = [("new_customers", "a"), ("repeat_customer_ratio", "b"), ("customer_loss_rate", "c"), ("product_mix_change", "d"), ("distributor_mix_change", "e"), ("product_concentration", "product_hhi"),
             ("dominant_product_share", "product_top_share"), ("country_mix", "country_diversity"), ("customer_concentration", "customer_hhi")]
    rows = got.collect()
    assert len(rows) == 24
    for r in rows:
        assert all(abs(r[x] - r[y]) < 1e-9 for x, y in pairs) and r["manager"] == r["f"], r
    assert any(r["customer_loss_rate"] > 0 for r in rows) and any(r["product_mix_change"] > 0 for r in rows)


def test_rows_without_a_key_have_totals_only(spark):
    rows = X.class_population(lines(spark)).filter("date IS NULL OR product_class IS NULL").collect()
    assert rows and all(r["total_sales"] is not None and r["distinct_products"] > 0 and r["new_customers"] is None and r["product_concentration"] is None for r in rows)
