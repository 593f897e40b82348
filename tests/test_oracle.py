"""Registered queries against DuckDB.  A core set by default; FAIRLINE_ALL=1 runs every query."""

import os

import pytest
from oracle import compare, connect

from fairline.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
CORE = (
    "b10_normalize_snapshot", "w4_row_scores", "ga5_selection_metrics", "ga6_compare_bookmakers", "w5_rolling_form", "w8_venue_form", "w10_elo", "w11_match_features", "w13_lineup_aggregates",
    "w14_temporal_matrix", "w16_bench_assembly", "j4_match_identity", "j5_replace_snapshots", "j7_reconcile_fixtures", "j14_as_of_latest", "j18_merge_player_facts", "ga12_metrics_by_season",
    "ga16_form_diagnostics", "m3_score_probabilities", "m13_paired_bootstrap", "s1_edge_dataset", "s5_rule_search", "q6_ready_set", "ga27_even_sample", "a5_odds_pages", "a7_feed_players",
    "x2_latest_at_cutoff", "x3_elo_stream", "p8_feed_backfill",
)
NAMES = [n for n in QUERIES if n in ORACLES] if os.environ.get("FAIRLINE_ALL") else list(CORE)


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    problem, rows = compare(QUERIES[name](spark, DATA), duck, ORACLES[name])
    assert problem is None
    assert rows >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
