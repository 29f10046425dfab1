"""Every SQL twin belongs to a query, and a cross-section of queries agrees with its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

from quotalens.queries import ORACLES, QUERIES, load_all

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))
from check_oracle import TABLES, table  # noqa: E402

load_all()
SF = "/root/testdata/sf0.001"
SAMPLE = ["category_shares", "customer_flow", "return_linkage_as_of", "calendar_lags", "incentive_payout_ratio", "coverage_drilldown", "temporal_detector_scores", "average_precision_step_sum", "dbscan_labels"]


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(ORACLES[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want
