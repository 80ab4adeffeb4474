"""Registered queries against their SQL in DuckDB on the smallest tables, with plain and with bucketed plans."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

BOTH = ["d14_auroc_exact", "e03_risk_coverage_curve", "e04_coverage_prefix_metrics", "d04_median_composite", "e07_tune_held_thresholds", "e15_proportional_allocation"]
ONCE = [
    "entry_knn_selective_risk", "a03_chunk_ingest", "a07_feature_round_trip", "b15_safeguard_reasons", "c04_interval_join", "c08_point_in_polygon",
    "c09_overlap_pairs", "c17_ledger_reconciliation", "d11_metrics_undefined_null", "d25_block_grid_metrics", "d27_full_and_retained_modes",
    "d30_paired_block_bootstrap", "d34_shrunk_covariance", "e09_blocks_first_sampler", "e18_group_disjoint_split", "g05_aoi_window_scores",
    "g06_boundary_clearance", "g07_connected_components", "g09_cross_tile_reconciliation", "h08_lonlat_to_utm", "k02_chunk_contract",
    "l02_duplicate_key_rejection", "l03_incremental_composite", "d44_held_risk_summary", "d29_bootstrap_auroc", "d45_block_scores", "a13_asset_registry",
    "l01_restartable_chunk_ingest", "g11_instance_deduplication", "g12_conflict_resolution", "g15_mask_instances",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def check(spark, con, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert line.startswith("ok"), line


@pytest.mark.parametrize("name", ONCE)
def test_matches_sql(spark, con, name):
    check(spark, con, name)


@pytest.mark.parametrize("name", BOTH)
def test_matches_sql_on_both_paths(spark, con, path, name):
    check(spark, con, name)


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 180
