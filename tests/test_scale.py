"""Joins on larger tables: what is broadcast and what is compared."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from fairline.catalog import QUERIES
from fairline.catalog.quality import payloads
from fairline.catalog.sources import feed_payloads, report_frame
from fairline.operators.players import pair_history
from fairline.operators.quality import choose_lineups, lineup_completeness, raw_census, ready_set
from fairline.operators.resolve import met_names, name_candidates
from fairline.plans.views import view
from fairline.session import SPLIT

ORDERS = (
    "id AS o_orderkey", "id * 7919 % 9973 AS o_custkey", "date_add(date'1995-01-01', cast(id % 900 AS int)) AS o_orderdate",
    "concat(id % 5 + 1, '-X') AS o_orderpriority",
)


def test_unfolded_views_are_not_broadcast_on_an_estimate(spark, tmp_path):
    spark.range(300000).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = [spark.conf.get(name, None) for name in limits]
    try:
        spark.conf.set(limits[0], "10m")
        spark.conf.unset(limits[1])
        rows = view(spark, str(tmp_path), "v_lineup").select("match_id", "side", "slot")
        games = view(spark, str(tmp_path), "v_match").select("match_id", "season", "league")
        plan = games.join(rows, "match_id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert spark.conf.get(limits[1]) == "10m"
        spark.conf.set(limits[0], "-1")
        view(spark, str(tmp_path), "v_match")
        assert spark.conf.get(limits[0]) == "-1"
    finally:
        for name, value in zip(limits, held, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["p9_payload_import", "p13_sampled_coverage"])
def test_payloads_are_built_for_the_wanted_matches_only(spark, tmp_path, name):
    spark.range(600).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.index("collect_list") < plan.index("LeftSemi")


def test_raw_census_moves_no_pairs(spark):
    rows = [("a", 1, "p"), ("a", 1, "p"), ("a", 1, "q"), ("a", 2, "p"), ("a", 2, None), ("a", None, "p"), ("b", 1, "p"), (None, 1, None)]
    players = spark.createDataFrame(rows, "provider string, match_id long, player_id string").selectExpr(
        "*", "if(player_id = 'q', 'substitute', 'starter') AS lineup_role", "player_id AS position", "match_id AS shirt_number", "match_id = 1 AS timing_observed")
    out = raw_census(players)
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (6, 5, 1, 5, 5, 3, 3), "b": (1, 1, 0, 1, 1, 1, 1), None: (1, 1, 0, 0, 1, 1, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*player_id", plan)


def test_pairs_stay_where_their_line_ups_lie(spark):
    rows = [(1, "home", 1, True, p, True, 90.0) for p in "abc"] + [(1, "home", 1, True, "c", True, 90.0)]  # one player listed twice
    rows += [(2, "home", 2, False, p, True, 45.0) for p in "ab"]  # asked for, but not counted
    rows += [(3, "home", 3, True, p, p != "b", None if p == "c" else 60.0) for p in "abc"] + [(3, "home", 3, True, None, True, 1.0), (None, "home", 3, True, "a", True, 1.0)]
    rows += [(4, "away", 4, True, p, True, 10.0) for p in "ac"]
    slots = spark.createDataFrame(rows, "match_id long, side string, date int, counts boolean, player_id string, starter boolean, actual_minutes double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = pair_history(slots)
        got = {(r["match_id"], r["a"], r["b"]): (r["co_starts"], r["shared_sum"], r["shared_n"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    nothing, once = (0, None, 0), (1, 90.0, 1)
    assert got == {
        (1, "a", "b"): nothing, (1, "a", "c"): nothing, (1, "b", "c"): nothing, (2, "a", "b"): once,
        (3, "a", "b"): once, (3, "a", "c"): once, (3, "b", "c"): once, (4, "a", "c"): (2, 90.0, 1)}
    final = plan.split("Initial Plan")[0]
    assert "ShuffledHashJoin" in final and not re.search(r"hashpartitioning\(a#\d+, b#\d+, date", plan)


def test_views_read_small_splits(spark, tmp_path):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(10).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        view(spark, str(tmp_path), "v_match")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(SPLIT)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # smaller ones stay
        view(spark, str(tmp_path), "v_match")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("build", [feed_payloads, report_frame, payloads])
def test_payloads_are_put_together_where_their_rows_lie(spark, tmp_path, build):
    spark.range(100).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    plan = build(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1


def test_names_meet_once_a_block(spark):
    schema = "league string, home_goals int, away_goals int, match_date date, home_name string, away_name string"
    day = datetime.date(2024, 1, 1)
    rows = [("1", 1, 0, day, "Alpha", "x"), ("1", 1, 0, day, "Alpha", "y"), ("1", 1, 0, day, "Beta", None), ("1", 2, 0, day, "Gamma", "x")]
    external = spark.createDataFrame(rows, schema).withColumn("external_id", F.monotonically_increasing_id())
    canonical = spark.createDataFrame([*rows, ("1", 1, 0, datetime.date(2024, 1, 2), "Delta", "x"), ("1", 1, 0, datetime.date(2024, 1, 3), "Far", "x")], schema)
    canonical = canonical.withColumn("match_id", F.monotonically_increasing_id())
    met = met_names(external, canonical)
    old = name_candidates(external, canonical, 0.0).select("_eh", "_ch").distinct()
    expected = [("alpha", "alpha"), ("alpha", "delta"), ("gamma", "gamma")]
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, old.collect())) == expected
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert below.count("Aggregate") == 2


def test_ready_set_meets_on_the_match_alone(spark):
    matches = spark.createDataFrame([(1, "A", "B", "H"), (2, "A", "B", "H"), (3, "A", "B", "H"), (None, "A", "B", "H")], "match_id int, home_team string, away_team string, result string")
    rows = [(m, t, f"{m}{t}{k}", "p", f"{t}{i}" if (m, i) != (2, 0) else "both", "starter", "D") for m in (1, 2, None) for t in "AB" for k in (0, 1) for i in range(11)]
    stored = spark.createDataFrame(rows, "match_id int, team_id string, lineup_id string, provider string, player_id string, lineup_role string, position string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ready, rejected = ready_set(matches, choose_lineups(lineup_completeness(stored), ["p"]), stored)
        plan = ready._jdf.queryExecution().executedPlan().toString()
        assert [(r.match_id, r.home_lineup_id, r.away_lineup_id) for r in ready.collect()] == [(1, "1A0", "1B0")]
        lost = ["missing_away_lineup", "missing_home_lineup"]
        assert {r.match_id: r.reasons for r in rejected.collect()} == {2: ["duplicate_starter"], 3: lost, None: lost}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not re.search(r"hashpartitioning\(match_id#\d+, (lineup_id|player_id|home_team|away_team)#\d+, \d", plan)
