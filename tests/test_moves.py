"""How often rows move on their way to a result."""

import datetime
import math
import random
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairline.functions import names
from fairline.operators import players, resolve
from fairline.plans import jobs
from fairline.plans.views import view
from fairline.sources import feeds

ORDERS = (
    "id AS o_orderkey", "id * 7919 % 9973 AS o_custkey", "date_add(date'1995-01-01', cast(id % 90 AS int)) AS o_orderdate",
    "concat(id % 5 + 1, '-X') AS o_orderpriority",
)


@pytest.fixture
def sorted_joins(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    held = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in held.items():
        spark.conf.set(name, value)


def moves(df, key):
    """Times that rows are asked to lie by ``key``, a move shared by several steps counted once."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum(bool(re.search(rf"Exchange hashpartitioning\({key}#\d+L?, \d+\), REPARTITION_BY_COL", x)) for x in lines if "ReusedExchange" not in x)


def slots_of(spark, path):
    spark.range(200).selectExpr(*ORDERS).write.parquet(f"{path}/orders.parquet")
    games = view(spark, str(path), "v_match")
    return players.slot_rows(games, view(spark, str(path), "v_lineup").withColumnRenamed("match_date", "date"))


def test_slots_move_once_to_lie_by_day(spark, tmp_path, sorted_joins):
    out = players.player_history_vectors(slots_of(spark, tmp_path))
    assert out.count() == 200 * 32 - 12 * 2
    assert moves(out, "date") == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((match_id#\d+L?, side|player_id#\d+, date)", plan)


def test_pairs_of_a_match_listed_on_several_days_are_summed_up_together(spark, tmp_path):
    slots = slots_of(spark, tmp_path).filter("match_id < 150").localCheckpoint()
    later = F.when(F.col("match_id").isin(7, 40) & (F.col("slot") > 3), F.date_add("date", 3)).otherwise(F.col("date"))
    split = slots.withColumn("date", later).localCheckpoint()
    got = players.player_history_vectors(split).filter("match_id = 40 AND side = 'home'").select("player_id", "lineup_familiarity").collect()
    # by definition: all pairs of the line-up that lie on one day, whatever the day
    pairs = players.pair_history(split).filter("match_id = 40 AND side = 'home'").collect()
    assert len({r["date"] for r in pairs}) == 2
    for row in got:
        own = [math.log1p(r["co_starts"]) for r in pairs if (r["a"] == row[0] and r["b_starter"]) or (r["b"] == row[0] and r["a_starter"])]
        assert row[1] == pytest.approx(sum(own) / len(own) if own and row[1] else 0.0)


OBS = ("match_id long, kickoff date, league string, team_id string, player_id string, lineup_role string, minutes_played double, minute_in double, minute_out double, "
       "position_original string, position_normalized string, source string, has_statistics boolean")


def test_observations_move_once_and_benches_lie_by_match(spark, sorted_joins):
    day = datetime.date(2024, 1, 1)
    squad = [(m, day + datetime.timedelta(m), "l", "T", f"p{i}", "starter" if i < 2 else "bench", 90.0, None, None, None, "M", "s", False) for m in (1, 2) for i in range(4)]
    matrix = players.temporal_player_matrix(spark.createDataFrame(squad, OBS))
    assert sorted((r["match_id"], r["player_id"], r["observations_value"]) for r in matrix.collect()) == [(m, f"p{i}", m - 1) for m in (1, 2) for i in range(4)]
    assert moves(matrix, "kickoff") == 1
    lineups = spark.createDataFrame([(m, "home", f"p{i}", "M", "starter" if i < 2 else "bench", i) for m in (1, 2, None) for i in range(3)],
                                    "match_id long, side string, player_id string, position string, lineup_role string, slot int")
    bench = players.assemble_bench(lineups, matrix)
    got = sorted((r["match_id"] or 0, r["bench_slot"], r["player_id"], r["origin"]) for r in bench.collect())
    assert got == [(0, 1, "p2", "lineup")] + [x for m in (1, 2) for x in ((m, 1, "p2", "lineup"), (m, 2, "p3", "store"))]
    assert moves(bench, "match_id") == 2


def test_the_store_is_attached_by_match(spark, sorted_joins):
    slots = spark.createDataFrame([(1, "home", "a"), (1, "home", "b"), (None, "away", "a")], "match_id long, side string, player_id string")
    store = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "match_id long, player_id string, fs double")
    out = players.attach_store(slots, store).groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("fs").alias("fs"))
    assert {tuple(r) for r in out.collect()} == {(1, "home", 3, 5.0), (None, "away", 1, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_crowded_blocks_meet_as_lists(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcde fc") for _ in range(rng.randint(0, 12))) for _ in range(20)] + [None, "a" * 62, "ab" * 40, "é日 é", "AB C"]
    day = datetime.date(2024, 1, 1)
    made = lambda n, ids: [(rng.randrange(ids), rng.choice([day, day, None]), rng.randint(0, 1), 0, rng.choice(pool), rng.choice(pool)) for _ in range(n)]
    schema = "id long, match_date date, home_goals int, away_goals int, home_name string, away_name string"
    canonical = spark.createDataFrame(made(90, 70), schema).withColumnRenamed("id", "match_id").localCheckpoint()
    source = spark.createDataFrame(made(80, 60), schema).selectExpr("concat('s', id) AS source_id", "*").drop("id").localCheckpoint()
    held = []
    monkeypatch.setattr(resolve, "stage", lambda df, name: held.append(df) or df)
    monkeypatch.setattr(resolve, "CROWD", 1000)
    columns = ["match_id", "mean_similarity", "runner_up_margin"]
    few = [sorted(map(tuple, part.select(columns).collect())) for part in resolve.reconcile_by_similarity(canonical, source)]
    monkeypatch.setattr(resolve, "CROWD", 16)
    crowd = [sorted(map(tuple, part.select(columns).collect())) for part in resolve.reconcile_by_similarity(canonical, source)]
    assert crowd == few and sum(map(len, few)) >= 40
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in held]
    assert "MapInArrow" not in plans[0] and "MapInArrow" in plans[1] and plans[1].count("collect_list") > 1
    ids = ["match_id", "source_id"]
    assert crowd[0] and held[0].select(ids).sort(ids).collect() == held[1].select(ids).sort(ids).collect()


def test_names_are_matched_only_where_their_longest_common_subsequence_may_do(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(names, "_ratio", lambda a, b: calls.append((a, b)) or SequenceMatcher(None, a, b).ratio())
    # an anagram shares all letters, but no order of them
    left, right = [{"id": 1, "_once": True, "_h": "abcdefgh", "_a": "xyz"}], [{"m": 7, "_h": "hgfedcba", "_a": "xyz"}, {"m": 8, "_h": "abcdefgx", "_a": "xyz"}]

    class Met:
        schema = spark.createDataFrame([], "_left array<struct<id long, _once boolean, _h string, _a string>>, _right array<struct<m long, _h string, _a string>>").schema

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([left]), pa.array([right])], names=["_left", "_right"])
            return [row for part in run(iter([batch])) for row in part.to_pylist()]

    assert names.likely_pairs(Met(), "id", "m", 1.5, 0.2) == [{"id": 1, "m": 8, "score": 1.875}]
    assert calls and all("hgfedcba" not in call for call in calls)


def test_texts_are_parsed_once_a_row(spark):
    side = '{"players":[%s]}' % ",".join('{"name":"p%d","number":%d}' % (i, i) for i in range(12))
    stats = "[%s]" % ",".join('{"Player":"p%d","Pos":"CB"}' % i for i in range(12))
    good = '{"id":"7","match_report":{"lineups":{"home":%s,"away":%s},"player_stats":{"home":%s,"away":%s}}}' % (side, side, stats, stats)
    texts = spark.createDataFrame([(1, good), (2, good.replace('"Player":"p3"', '"Player":"q"')), (3, "no json"), (4, None)], "k long, value string").localCheckpoint()
    reports = feeds.parsed(texts, "value", feeds.REPORT, "k")
    old = texts.select("k", F.from_json("value", feeds.REPORT).alias("r")).select("k", "r.*")
    assert reports.columns == old.columns and sorted(map(str, reports.collect())) == sorted(map(str, old.collect()))
    slots = jobs.report_slots(reports)
    assert slots.groupBy("external_id", "side", "position").count().sort("side").collect() == [("7", "away", "D", 11), ("7", "home", "D", 11)]
    assert slots._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_line_ups_move_once_for_their_aggregates(spark, tmp_path, sorted_joins):
    spark.range(60).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    games = view(spark, str(tmp_path), "v_match").withColumnRenamed("match_date", "date")
    out = players.prematch_player_features(games, view(spark, str(tmp_path), "v_lineup"))
    assert out.count() == 60
    assert moves(out, "match_id") == 1
    assert not re.search(r"Exchange hashpartitioning\(match_id#\d+L?, team", out._jdf.queryExecution().executedPlan().toString())


def test_starters_are_rebuilt_by_game(spark, sorted_joins):
    rows = [(g, c, f"{c}{i}") for g in (1, 2, 3) for c in "ab" for i in range(12 if (g, c) != (3, "b") else 11)]
    played = spark.createDataFrame(rows, "game_id long, club_id string, player_id string")
    subs = spark.createDataFrame([(1, "a", "a11"), (1, "b", "b3"), (2, "a", "a0"), (2, "a", "a0"), (3, "a", None)], "game_id long, club_id string, player_in_id string")
    places = spark.createDataFrame([(f"{c}{i}", "D") for c in "ab" for i in range(12)] + [("a1", ""), ("b7", None)], "player_id string, position string")
    out = resolve.rebuild_starters(played, subs, places)
    got = out.groupBy("game_id", "club_id", "formation_grid").count().sort("game_id", "club_id")
    assert [tuple(r) for r in got.collect()] == [(1, "a", "reconstructed:D", 11), (1, "b", "reconstructed:D", 11), (2, "a", "reconstructed:D", 11), (3, "b", "reconstructed:D", 11)]
    assert not re.search(r"Exchange hashpartitioning\(game_id#\d+L?, club_id", out._jdf.queryExecution().executedPlan().toString())
    listed = played.filter("game_id = 3").selectExpr("*", "'starting_lineup' AS type", "'M' AS position")
    both = jobs.external_slots(listed, played, subs, places).groupBy("game_id", "club_id", "position").count().sort("game_id", "club_id")
    assert [tuple(r) for r in both.collect()] == [(1, "a", "D", 11), (1, "b", "D", 11), (2, "a", "D", 11), (3, "b", "M", 11)]
