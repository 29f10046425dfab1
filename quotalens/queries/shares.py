"""Shares, concentration, flows."""

from pyspark.sql import functions as F

from quotalens.operators import aggregates as A, shares as S
from quotalens.queries.base import CLASS_MONTH, LEDGER, class_month, ledger
from quotalens.queries.registry import query


@query("category_shares", LEDGER + """
, w AS (SELECT rep_id, channel, sum(abs(sales)) AS weight, count(*) AS n FROM ledger GROUP BY ALL)
SELECT rep_id, channel, weight, CASE WHEN sum(weight) OVER (PARTITION BY rep_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY rep_id)
  ELSE n / sum(n) OVER (PARTITION BY rep_id) END AS share FROM w""", floats="weight share")
def category_shares(spark, sf):
    return S.category_shares(ledger(spark, sf), ["rep_id"], "channel", "sales")


@query("concentration_hhi", LEDGER + """
, w AS (SELECT rep_id, period, customer_id, sum(abs(sales)) AS weight FROM ledger GROUP BY ALL)
, s AS (SELECT rep_id, period, weight / sum(weight) OVER (PARTITION BY rep_id, period) AS share FROM w)
SELECT rep_id, period, sum(share * share) AS customer_hhi, 1 - sum(share * share) AS customer_diversity,
  max(share) AS customer_top_share FROM s GROUP BY ALL""", floats="customer_hhi customer_diversity customer_top_share")
def concentration_hhi(spark, sf):
    return S.concentration(ledger(spark, sf), ["rep_id", "period"], "customer_id", "sales", "customer")


@query("net_concentration_hhi", LEDGER + """
, w AS (SELECT rep_id, period, distributor, abs(sum(sales)) AS weight FROM ledger GROUP BY ALL)
, s AS (SELECT rep_id, period, weight / greatest(sum(weight) OVER (PARTITION BY rep_id, period), 1) AS share FROM w)
SELECT rep_id, period, sum(share * share) AS brand_hhi, 1 - sum(share * share) AS brand_diversity,
  max(share) AS brand_top_share FROM s GROUP BY ALL""", floats="brand_hhi brand_diversity brand_top_share")
def net_concentration_hhi(spark, sf):
    return S.concentration(ledger(spark, sf), ["rep_id", "period"], "distributor", "sales", "brand", basis="net")


@query("signed_share_concentration", LEDGER + """
, w AS (SELECT rep_id, period, channel, sum(sales) AS v FROM ledger GROUP BY ALL)
, t AS (SELECT rep_id, period, sum(v) AS total, sum(v * v) AS v2 FROM w GROUP BY ALL)
SELECT rep_id, period, CASE WHEN abs(total) > 1e-12 THEN v2 / total / total ELSE 0 END AS channel_mix FROM t""", floats="channel_mix", digits=4)
def signed_share_concentration(spark, sf):
    return S.signed_concentration(ledger(spark, sf), ["rep_id", "period"], "channel", "sales", "channel_mix")


_SHIFT = LEDGER + """
, w AS (SELECT rep_id, period, product_class, {weight} AS weight FROM ledger GROUP BY ALL)
, s AS (SELECT rep_id, period, product_class, weight / greatest(sum(weight) OVER (PARTITION BY rep_id, period), 1) AS share FROM w)
, p AS (SELECT rep_id, period, lead(period) OVER (PARTITION BY rep_id ORDER BY period) AS nxt,
          min(period) OVER (PARTITION BY rep_id) AS first FROM (SELECT DISTINCT rep_id, period FROM w))
, prev AS (SELECT s.rep_id, p.nxt AS period, product_class, share FROM s JOIN p USING (rep_id, period) WHERE nxt IS NOT NULL)
, d AS (SELECT coalesce(s.rep_id, prev.rep_id) AS rep_id, coalesce(s.period, prev.period) AS period,
          abs(coalesce(s.share, 0) - coalesce(prev.share, 0)) AS diff
        FROM s FULL JOIN prev ON s.rep_id = prev.rep_id AND s.period = prev.period AND s.product_class = prev.product_class)
SELECT d.rep_id, d.period, {final} AS mix_shift FROM d JOIN p ON d.rep_id = p.rep_id AND d.period = p.period
GROUP BY d.rep_id, d.period, first"""


@query("mix_shift_first_zero", _SHIFT.replace("{weight}", "sum(abs(sales))").replace(
    "{final}", "CASE WHEN d.period = first THEN 0 ELSE 0.5 * sum(diff) END"), floats="mix_shift")
def mix_shift_first_zero(spark, sf):
    return S.mix_shift(ledger(spark, sf), ["rep_id"], "period", "product_class", "sales", "mix_shift")


@query("mix_shift_first_empty", _SHIFT.replace("{weight}", "abs(sum(sales))").replace("{final}", "0.5 * sum(diff)"), floats="mix_shift")
def mix_shift_first_empty(spark, sf):
    return S.mix_shift(ledger(spark, sf), ["rep_id"], "period", "product_class", "sales", "mix_shift", basis="net", first="empty")


@query("product_mix_entropy", LEDGER + """
, w AS (SELECT rep_id, period, product_class, abs(sum(sales)) AS weight FROM ledger GROUP BY ALL)
, s AS (SELECT rep_id, period, weight / greatest(sum(weight) OVER (PARTITION BY rep_id, period), 1) AS share FROM w)
SELECT rep_id, period, -ln(greatest(sum(share * share), 1e-9)) AS entropy FROM s GROUP BY ALL""", floats="entropy")
def product_mix_entropy(spark, sf):
    h = S.concentration(ledger(spark, sf), ["rep_id", "period"], "product_class", "sales", "class", basis="net")
    return h.select("rep_id", "period", S.entropy_proxy("class_hhi").alias("entropy"))


@query("deterministic_mode", LEDGER + """
, n AS (SELECT rep_id, period, channel, count(*) AS n FROM ledger GROUP BY ALL)
SELECT rep_id, period, channel AS usual_channel FROM n QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY n DESC, channel) = 1""")
def deterministic_mode(spark, sf):
    return S.dominant_member(ledger(spark, sf), ["rep_id", "period"], "channel", "usual_channel")


@query("dominant_territory_by_weight", LEDGER + """
, n AS (SELECT rep_id, period, city, sum(quantity) AS n FROM ledger GROUP BY ALL)
SELECT rep_id, period, city AS territory FROM n QUALIFY row_number() OVER (PARTITION BY rep_id, period ORDER BY n DESC, city) = 1""")
def dominant_territory_by_weight(spark, sf):
    return S.dominant_member(ledger(spark, sf), ["rep_id", "period"], "city", "territory", weight="quantity")


@query("customer_flow", LEDGER + """
, c AS (SELECT DISTINCT rep_id, period, customer_id FROM ledger)
, f AS (SELECT rep_id, customer_id, min(period) AS first FROM c GROUP BY ALL)
, p AS (SELECT rep_id, period, lag(period) OVER (PARTITION BY rep_id ORDER BY period) AS prev FROM (SELECT DISTINCT rep_id, period FROM c))
, a AS (SELECT c.rep_id, c.period, count(*) AS members, sum((first = c.period)::INT) AS new_members
        FROM c JOIN f USING (rep_id, customer_id) GROUP BY ALL)
, l AS (SELECT p.rep_id, p.period, count(b.customer_id) AS prior, sum((b.customer_id IS NOT NULL AND n.customer_id IS NULL)::INT) AS lost
        FROM p LEFT JOIN c b ON b.rep_id = p.rep_id AND b.period = p.prev
        LEFT JOIN c n ON n.rep_id = p.rep_id AND n.period = p.period AND n.customer_id = b.customer_id GROUP BY ALL)
SELECT rep_id, period, members, CAST(new_members AS BIGINT) AS new_members, CAST(members - new_members AS BIGINT) AS repeat_members,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost_members, (members - new_members) / members AS repeat_ratio,
  coalesce(lost, 0) / greatest(1, prior) AS loss_rate FROM a JOIN l USING (rep_id, period)""", floats="repeat_ratio loss_rate")
def customer_flow(spark, sf):
    return S.customer_flow(ledger(spark, sf), ["rep_id"], "period", "customer_id")


@query("first_purchase_counts", LEDGER + """
, f AS (SELECT rep_id, customer_id, min(period) AS period FROM ledger WHERE sales > 0 GROUP BY ALL)
SELECT rep_id, period, count(*) AS new_customer_count FROM f GROUP BY ALL""")
def first_purchase_counts(spark, sf):
    return S.first_purchases(ledger(spark, sf), "rep_id", "customer_id", "period", "sales", "new_customer_count")


@query("share_of_partition_total", CLASS_MONTH + """
SELECT rep_id, product_class, period, total_sales / greatest(abs(sum(total_sales) OVER (PARTITION BY rep_id, period)), 1) AS class_share
FROM class_month""", floats="class_share")
def share_of_partition_total(spark, sf):
    return A.share_of_total(class_month(spark, sf), ["rep_id", "period"], "total_sales", "class_share").select(
        "rep_id", "product_class", "period", "class_share")


@query("expected_by_potential_share", CLASS_MONTH + """
, t AS (SELECT rep_id, product_class, period, total_sales, total_quantity, sum(total_sales) OVER (PARTITION BY period) AS s,
  sum(total_quantity) OVER (PARTITION BY period) AS q FROM class_month)
SELECT rep_id, product_class, period, total_sales - s * total_quantity / greatest(q, 1) AS residual FROM t""", floats="residual", digits=4)
def expected_by_potential_share(spark, sf):
    from quotalens.operators.peers import potential_residual
    return potential_residual(class_month(spark, sf), ["period"], "total_sales", "total_quantity", "residual").select(
        "rep_id", "product_class", "period", "residual")


@query("distinct_count_on_rows", CLASS_MONTH + """
, d AS (SELECT rep_id, period, count(DISTINCT product_class) AS class_count FROM class_month GROUP BY ALL)
SELECT rep_id, product_class, period, class_count FROM class_month JOIN d USING (rep_id, period)""")
def distinct_count_on_rows(spark, sf):
    return A.distinct_per_group(class_month(spark, sf), ["rep_id", "period"], "product_class", "class_count").select(
        "rep_id", "product_class", "period", "class_count")
