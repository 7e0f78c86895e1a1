"""The registered plans against their SQL on the smallest tables (a cross-section)."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare_sql import TABLES, compare

SAMPLE = ["normalise_events", "union_labelled_with_ids", "rolling_features", "rules_with_graph", "account_profiles", "build_nodes", "live_graph_vector",
          "cycle_closure", "pagerank", "communities", "community_benford", "knn", "edge_features", "fused_scores", "group_risk", "eval_frame", "threshold_sweep", "roc_auc", "ring_detection"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_equals_sql(spark, sf, con, name):
    got = compare(entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df())
    assert got.startswith("ok"), got


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
