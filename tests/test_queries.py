"""Registered queries against their SQL, over the whole sf0.001 tables.

PIXTAB_ALL=1 runs every query; by default one or two of each kind.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
USUAL = ["a5_discover_samples", "a6_pair_by_prefix", "b1_three_way_split", "b6_difficulty_filter", "c5_roi_normalise",
         "d4_median", "d7_close", "d9_gaussian", "d11_clahe", "e3_components_4", "e6_thinning", "e11_graph_edges",
         "f3_peaks", "f5_ring_seeds", "g8_coverage_gain", "g13_advantages", "g19_stage_history", "h1_tolerant_f1",
         "h6_hd95", "s2_streamed_stages"]
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("PIXTAB_ALL") else USUAL)
def test_query_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, ORACLES[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
