"""Registered queries against their DuckDB text (a sample, at sf0.001)."""

import pytest

import oracle_check

SF = "/root/testdata/sf0.001"
KEYS = ["resolve_renames", "current_touches", "jaccard_distance", "coupled_pairs", "cluster_routes",
        "file_dates", "tf_idf", "cosine_similarity", "repo_name", "strip_common_prefix", "city_grid_dims",
        "hashes_newest_first", "split_identifier", "cluster_dbscan"]


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    ok, msg = oracle_check.compare(spark, con, key, SF)
    assert ok, msg
