import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import json

from fairline.streaming import jobs
from fairline.operators import evaluate, history, market, players, quality, resolve, scores, strategy
from fairline.sources import feeds


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


SCHEMA = "match_id string, date date, season string, league string, home_team string, away_team string, home_goals int, away_goals int, result string, home_shots int, away_shots int"


def games(spark, rows):
    def result(h, a):
        return None if h is None else "H" if h > a else "A" if h < a else "D"

    return spark.createDataFrame([(i, d, s, g, h, a, hg, ag, result(hg, ag), hs, aws) for i, d, s, g, h, a, hg, ag, hs, aws in rows], SCHEMA)


HISTORY = [("1", day(0), "2324", "L", "A", "B", 0, 2, 6, 12), ("2", day(7), "2324", "L", "B", "A", 1, 1, 4, 5), ("3", day(14), "2324", "L", "A", "B", 3, 0, 9, 2)]


def by_id(df):
    return {r["match_id"]: r.asDict() for r in df.collect()}


def test_remove_margin(spark):
    row = market.remove_margin(spark.createDataFrame([(2.0, 3.4, 4.0)], "h double, d double, a double"), "h", "d", "a").first()
    assert row.margin == pytest.approx(1 / 2 + 1 / 3.4 + 1 / 4 - 1)
    assert row.p_home + row.p_draw + row.p_away == pytest.approx(1.0)


def test_calibration_error_value(spark):
    table = spark.createDataFrame([(75, 0.10), (25, -0.20)], "observations int, calibration_error double")
    assert market.expected_calibration_error(table).first()[0] == pytest.approx(0.125)


def test_rank_score_values(spark):
    df = spark.createDataFrame([("D", 0.5, 0.5, 0.0)], "result string, probability_home double, probability_draw double, probability_away double")
    assert evaluate.probability_metrics(df).first().rps == pytest.approx(0.125)


def test_form_of_second_game(spark):
    rows = by_id(history.build_prematch_features(games(spark, HISTORY)))
    second = rows["2"]
    assert second["home_matches_played"] == 1 and second["away_matches_played"] == 1
    assert second["home_points_5"] == 3.0 and second["away_points_5"] == 0.0
    assert second["home_rest_days"] == 7.0
    assert second["away_shots_for_5"] == 6.0 and second["away_shots_against_5"] == 12.0
    assert second["home_venue_points_5"] is None
    assert rows["1"]["home_points_5"] is None


def test_future_rows_change_nothing(spark):
    before = by_id(history.build_prematch_features(games(spark, HISTORY)))
    later = HISTORY + [("9", day(30), "2425", "L", "B", "A", 5, 0, 20, 1)]
    after = by_id(history.build_prematch_features(games(spark, later)))
    assert {k: after[k] for k in before} == before


def test_same_day_peers_are_invisible(spark):
    rows = HISTORY + [("4", day(14), "2324", "L", "B", "C", 2, 2, 3, 3), ("5", day(14), "2324", "L", "C", "A", 0, 1, 3, 3)]
    got = by_id(history.build_prematch_features(games(spark, rows)))
    assert got["3"]["home_matches_played"] == 2 == got["5"]["away_matches_played"]
    assert got["3"]["home_elo"] == got["5"]["away_elo"]


def test_elo_rules(spark):
    rated = by_id(history.elo_ratings(games(spark, HISTORY + [("4", day(200), "2425", "L", "A", "B", None, None, None, None)])))
    assert rated["1"]["home_elo"] == 1500.0 == rated["1"]["away_elo"]
    for row in rated.values():
        assert row["home_elo"] + row["away_elo"] == pytest.approx(3000.0)
    expected = 1 / (1 + 10 ** (-65 / 400))
    loser = 1500 + 20 * (1 + math.log1p(2)) * (0 - expected)
    assert rated["2"]["away_elo"] == pytest.approx(loser)
    # the first row of a new season is read after the pull to the mean
    third = rated["3"]
    exp3 = 1 / (1 + 10 ** (-(third["home_elo"] + 65 - third["away_elo"]) / 400))
    end = third["home_elo"] + 20 * (1 + math.log1p(3)) * (1 - exp3)
    assert rated["4"]["home_elo"] == pytest.approx(0.75 * end + 0.25 * 1500)


def test_fixture_features_reject_targets(spark):
    played = games(spark, HISTORY)
    with pytest.raises(ValueError):
        history.prepare_future_fixtures(played)
    fixtures = played.filter("match_id = '3'").select(F.lit("new").alias("match_id"), F.lit(day(40)).alias("date"), "season", "league", "home_team", "away_team")
    row = history.build_fixture_features(played, fixtures).first()
    assert row["home_matches_played"] == 3 and row["home_points_5"] == pytest.approx((0 + 1 + 3) / 3)


OBS = "match_id string, kickoff timestamp, league string, team_id int, player_id string, lineup_role string, minutes_played double, minute_in double, minute_out double, position_original string, position_normalized string, source string, has_statistics boolean"


def observation(match, when, role, minutes, team=1):
    return (match, when, "L", team, "p", role, minutes, None, None, None, "M", "s", False)


def test_zero_minutes_are_available_and_unknown_is_not(spark):
    start = dt.datetime(2024, 1, 1, 12)
    later = start + dt.timedelta(days=3)
    known = spark.createDataFrame([observation("a", start, "bench", 0.0), observation("b", later, "starter", 90.0)], OBS)
    row = by_id(players.temporal_player_matrix(known))["b"]
    assert row["mean_minutes_available"] and row["mean_minutes_value"] == 0.0 and row["mean_minutes_quality"] == "reported"
    unknown = spark.createDataFrame([observation("a", start, "bench", None), observation("b", later, "starter", 90.0, 2)], OBS)
    row = by_id(players.temporal_player_matrix(unknown))["b"]
    assert not row["mean_minutes_available"] and row["mean_minutes_value"] is None
    assert row["team_change_value"] and row["days_since_appearance_value"] == pytest.approx(3.0)
    assert by_id(players.temporal_player_matrix(unknown))["a"]["team_change_value"] is False


def test_winner_strength_is_one(spark):
    squad = [(m, t, f"{t}{i}", "starter" if i < 11 else "bench") for m in ("1", "2") for t in ("A", "B") for i in range(12)]
    lineups = spark.createDataFrame(squad, "match_id string, team string, player_id string, lineup_role string")
    rows = by_id(players.prematch_player_features(games(spark, HISTORY[:2]), lineups))
    assert rows["1"]["home_player_expected_strength"] is None
    assert rows["2"]["home_player_expected_strength"] == pytest.approx(1.0)
    assert rows["2"]["home_player_lineup_continuity"] == pytest.approx(1.0)
    assert rows["2"]["home_player_lineup_uncertainty"] == 0.0


def test_minutes_estimate(spark):
    df = spark.createDataFrame([(False, 60.0, None), (True, None, 60.0), (True, None, None), (False, None, None)], "s boolean, i double, o double")
    assert [r[0] for r in df.select(players.minutes_estimate(F.col("s"), F.col("i"), F.col("o"))).collect()] == [30.0, 60.0, 90.0, None]


def test_reliability_share(spark):
    rows = []
    for side in ("home", "away"):
        for slot in range(11):
            weak = side == "home" and slot < 5
            rows.append(("m", side, "starter", math.log1p(0 if weak else 9), 1.0, 1.0, 1.0, 0.0, math.log1p(0 if weak else 5), 1.0))
    df = spark.createDataFrame(rows, "match_id string, side string, lineup_role string, log_squad_observations double, fs_store_available double, fs_mean_minutes_available double, fs_mean_minute_in_available double, fs_mean_minute_out_available double, fs_observations_value double, fs_observations_quality double")
    assert players.reliability(df).first().match_reliability == pytest.approx(6 / 11)


def test_residual_targets_and_gate(spark):
    df = spark.createDataFrame([(2, 0, 1.5, 0.5)], "home_goals int, away_goals int, home_rate double, away_rate double")
    row = scores.residual_targets(df).first()
    assert row.home_target == pytest.approx(math.log(2.5 / 2.0)) and row.away_target == pytest.approx(math.log(0.5 / 1.0))
    with pytest.raises(Exception, match="positive"):
        scores.residual_targets(df.withColumn("home_rate", F.lit(0.0))).collect()
    gate = spark.createDataFrame([(0.9, -0.1, 0.0), (0.2, -0.1, 1.0)], "home_raw double, away_raw double, match_reliability double")
    low, full = scores.gate_corrections(gate).collect()
    assert low.home_correction_pre_gate == 0.35 and low.home_correction_post_gate == 0.0
    assert full.home_correction_post_gate == pytest.approx(0.2)
    with pytest.raises(Exception, match="within"):
        scores.gate_corrections(gate.withColumn("match_reliability", F.lit(1.5))).collect()


def test_score_grid_by_hand(spark):
    df = spark.createDataFrame([(1.4, 1.1, -0.08)], "home_rate double, away_rate double, rho double")
    row = scores.score_probabilities(df).first()
    pois = lambda r, k: math.exp(k * math.log(r) - r - math.lgamma(k + 1))
    tau = {(0, 0): 1 - 1.4 * 1.1 * -0.08, (0, 1): 1 + 1.4 * -0.08, (1, 0): 1 + 1.1 * -0.08, (1, 1): 1.08}
    cell = {(i, j): pois(1.4, i) * pois(1.1, j) * tau.get((i, j), 1.0) for i in range(11) for j in range(11)}
    assert row.probability_home == pytest.approx(sum(v for (i, j), v in cell.items() if i > j) / sum(cell.values()))
    assert row.probability_draw == pytest.approx(sum(v for (i, j), v in cell.items() if i == j) / sum(cell.values()))


FIXTURES = "external_id string, match_date date, league string, home_name string, away_name string, home_goals int, away_goals int"


def test_fuzzy_names_resolve_and_ambiguity_does_not(spark):
    ext = spark.createDataFrame([("e", day(1), "E", "Manchester United", "Leicester City", 1, 0)], FIXTURES)
    canon = spark.createDataFrame([("m", day(0), "E", "Man United", "Leicester", 1, 0), ("n", day(1), "E", "Arsenal", "Chelsea", 1, 0)], FIXTURES).withColumnRenamed("external_id", "match_id")
    assert [r.match_id for r in resolve.by_similar_names(ext, canon).collect()] == ["m"]
    twin = canon.unionByName(canon.filter("match_id = 'm'").withColumn("match_id", F.lit("twin")))
    assert resolve.by_similar_names(ext, twin).count() == 0
    assert resolve.by_similar_names(ext, canon.withColumn("match_date", F.lit(day(4)))).count() == 0


def test_similarity_quarantine(spark):
    canon = spark.createDataFrame([("m", day(0), "I", "Milan", "Torino", 2, 1), ("k", day(0), "I", "Roma", "Lazio", 0, 0)], FIXTURES).withColumnRenamed("external_id", "match_id")
    source = spark.createDataFrame([("s", day(0), "I", "Mailand", "Turin", 2, 1), ("t", day(0), "I", "Romano", "Lazip", 0, 0), ("u", day(0), "I", "Romana", "Lazia", 0, 0)], FIXTURES).withColumnRenamed("external_id", "source_id")
    good, doubtful, dropped = resolve.reconcile_by_similarity(canon, source)
    row = good.first()
    assert (row.match_id, row.source_id, row.runner_up_margin) == ("m", "s", 100.0)
    assert [r.match_id for r in doubtful.collect()] == ["k"] and dropped.count() == 0


def test_snapshots_replace_and_accumulate(spark):
    cols = "match_id string, bookmaker string, provider string, market string, timing string, timestamp string, odds double, batch int"
    old = spark.createDataFrame([("m", "b", "p", "1X2", "closing", None, 2.0, 0), ("m", "b", "p", "1X2", "snapshot", "t1", 3.0, 0)], cols)
    new = spark.createDataFrame([("m", "b", "p", "1X2", "closing", None, 2.5, 1), ("m", "b", "p", "1X2", "snapshot", "t2", 4.0, 1)], cols)
    once = resolve.replace_snapshots(old, new)
    assert sorted(r.odds for r in once.collect()) == [2.5, 3.0, 4.0]
    assert sorted(r.odds for r in resolve.replace_snapshots(once, new).collect()) == [2.5, 3.0, 4.0]


def test_nearest_reading(spark):
    probe = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 20, 45))], "match_id string, kickoff timestamp")
    hours = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 20), 9.0), ("m", dt.datetime(2024, 1, 1, 21), 7.5)], "match_id string, at timestamp, t double")
    assert resolve.nearest_in_time(probe, hours, ["match_id"], "kickoff", "at", ["t"]).first().t == 7.5


def test_ready_set_reasons(spark):
    matches = spark.createDataFrame([("1", "23", "A", "B", "H"), ("2", "23", "A", "B", "X"), ("3", "0910", "A", "B", "H")], "match_id string, season string, home_team string, away_team string, result string")
    rows = [("1", t, f"{t}1", "p", f"{t}{i}", "starter", "D" if (t, i) != ("B", 3) else None) for t in "AB" for i in range(11)]
    stored = spark.createDataFrame(rows, "match_id string, team_id string, lineup_id string, provider string, player_id string, lineup_role string, position string")
    chosen = quality.choose_lineups(quality.lineup_completeness(stored), ["p"])
    ready, rejected = quality.ready_set(matches, chosen, stored, ["0910"])
    assert ready.count() == 0
    assert {r.match_id: r.reasons for r in rejected.collect()} == {"1": ["away_starter_role_missing"], "2": ["invalid_result", "missing_away_lineup", "missing_home_lineup"]}


def test_missing_quote_timestamp_fails(spark):
    pred = spark.createDataFrame([("m", dt.datetime(2024, 1, 2))], "match_id string, prediction_cutoff timestamp")
    quotes = spark.createDataFrame([("m", "B", "H", 2.0, None)], "match_id string, bookmaker string, selection string, odds double, timestamp timestamp")
    with pytest.raises(ValueError):
        strategy.prices_at_cutoff(pred, quotes, "B")
    assert strategy.prices_at_cutoff(pred, quotes, "other").count() == 0


def test_rules_from_cells_equal_direct_filtering(spark):
    rows = [(f"m{i}", 0.4 + (i * 7 % 40) / 100, (i * 3 % 14) / 100 - 0.02, float(i * 37 % 260), "HDA"[i % 3], i % 4 == 0, (-1.0) ** i * (1 + i % 3)) for i in range(120)]
    bets = spark.createDataFrame(rows, "match_id string, model_probability double, edge double, absolute_elo_difference double, pick string, experienced boolean, profit double")
    found = {r.rule_id: r for r in strategy.search_rules(bets, 1).collect()}
    for number in (0, 1, 7, 129, 330, 1003):
        if number in found:
            r = found[number]
            rule = strategy.Rule(r.min_confidence, r.min_edge, r.min_abs_elo, r.picks, r.require_experience)
            direct = bets.filter(strategy.rule_condition(rule)).agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p")).first()
            assert (r.bets, r.profit) == (direct.n, pytest.approx(direct.p))
    assert 0 in found


def test_bad_odds_page_fails(spark):
    text = '{"response":[{"league":{"id":1,"season":2024},"fixture":{"id":5,"date":"2024-01-01"},"update":null,"bookmakers":[{"id":1,"name":"b","bets":[{"id":1,"values":[{"value":"Home","odd":"2.0"}]}]}]}]}'
    pages = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", feeds.ODDS_PAGE).alias("p")).select("p.*")
    with pytest.raises(Exception, match="update time"):
        feeds.odds_pages(pages)[0].collect()


def test_role_vocabularies(spark):
    df = spark.createDataFrame([(float(y),) for y in (1, 3, 8, 10)], "y double")
    assert [r[0] for r in df.select(feeds.role_from_depth("y")).collect()] == ["G", "D", "M", "F"]
    assert [r[0] for r in spark.range(11).select(feeds.role_from_slot(F.col("id"))).collect()] == ["F"] * 2 + ["M"] * 4 + ["D"] * 4 + ["G"]
    names = spark.createDataFrame([("Goalkeeper",), ("G",), ("Centre-Back",), ("m",), (None,)], "p string")
    assert [r[0] for r in names.select(players.department("p")).collect()] == ["goalkeeper", "goalkeeper", "defense", "midfield", "unknown"]


def _odds_page(fixture, updated, odd):
    values = [{"value": "Home", "odd": str(odd)}, {"value": "Away", "odd": "1.0"}]
    item = {"league": {"id": 1, "season": 2024}, "fixture": {"id": fixture, "date": "2024-02-01T15:00:00+00:00"}, "update": updated, "bookmakers": [{"id": 1, "name": "B", "bets": [{"id": 1, "values": values}]}]}
    return json.dumps({"errors": [], "paging": {"current": 1, "total": 1}, "response": [item]})


def test_collector_keeps_late_pages_and_rejects(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    runs = [
        [_odds_page(1, "2024-01-20T10:00:00+00:00", 2.0)],
        [_odds_page(1, "2024-01-20T10:00:00+00:00", 2.0), _odds_page(2, "2024-01-09T10:00:00+00:00", 3.0), _odds_page(2, "2013-01-09T10:00:00+00:00", 4.0)],
        [_odds_page(2, "2024-01-09T10:00:00+00:00", 3.0)],
    ]
    for k, pages in enumerate(runs):
        (landing / f"{k}.json").write_text("\n".join(pages))
        jobs.collect_odds(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.provider_fixture_id, r.decimal_odds) for r in stored.collect()) == [("1", 2.0), ("2", 3.0), ("2", 4.0)]
    assert spark.read.parquet(str(tmp_path / "out_rejected")).count() == 5
    manifest = spark.read.parquet(str(tmp_path / "out_manifest"))
    assert sorted((r.rows, r.fixtures, r.invalid_values, r.complete) for r in manifest.collect()) == [(1, 1, 1, True), (1, 1, 1, True), (3, 2, 3, True)]


def test_collector_goes_on_after_bad_pages_and_keeps_the_first_price(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    at = "2024-01-20T10:00:00+00:00"
    runs = [[_odds_page(1, at, 2.5), _odds_page(1, at, 2.25), _odds_page(7, None, 3.0)], [_odds_page(1, at, 9.0), _odds_page(1, at, 2.25), _odds_page(2, at, 4.0)]]
    for k, pages in enumerate(runs):
        (landing / f"{k}.json").write_text("\n".join(pages))
        jobs.collect_odds(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.provider_fixture_id, r.decimal_odds) for r in stored) == [("1", 2.25), ("2", 4.0)]
    assert all(r.provider == feeds.ODDS_PROVIDER and r.collected_at is not None for r in stored)
    rejected = spark.read.parquet(str(tmp_path / "out_rejected")).filter("reason <> 'price_not_above_one'").collect()
    assert sorted((r.reason, r.provider_fixture_id, r.decimal_odds) for r in rejected) == [("no_update_time", "7", None), ("other_price", "1", 2.5), ("other_price", "1", 9.0)]


def test_odds_manifest_counts_pages_once(spark):
    page = lambda current, total, fixture: _odds_page(fixture, "2024-01-20T10:00:00+00:00", 2.0).replace('"current": 1, "total": 1', f'"current": {current}, "total": {total}')
    rows = [("a", page(1, 2, 1)), ("a", page(2, 2, 2)), ("b", page(1, 3, 1)), ("b", page(1, 3, 1)), ("c", '{"response": []}')]
    pages = spark.createDataFrame(rows, "c string, v string").select("c", F.from_json("v", feeds.ODDS_PAGE).alias("p")).select("c", "p.*")
    got = {r.c: (r.pages_collected, r.pages_available, r.complete, r.fixtures, r.rows, r.invalid_values) for r in feeds.odds_manifest(pages, ["c"]).collect()}
    assert got == {"a": (2, 2, True, 2, 2, 2), "b": (1, 3, False, 1, 2, 2), "c": (1, 1, True, 0, 0, 0)}


def test_latest_quotes_survive_compaction(spark, tmp_path):
    schema = "match_id int, selection string, quoted_at timestamp, odds double"
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    for k in range(5):
        rows = [(1, "H", day(k), 2.0 + k), (2, "H", day(k), 3.0 + k), (9, "A", day(k), 4.0 + k)] if k != 3 else [(2, "D", day(0), 1.5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cutoffs = spark.createDataFrame([(1, day(1)), (2, day(30))], "match_id int, cutoff timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    jobs.track_latest_quotes(stream, cutoffs, target, str(tmp_path / "state"), compact_every=2).awaitTermination()
    assert sorted(r.upto for r in spark.read.parquet(f"{target}/snapshots").collect()) == [1, 3]
    assert sorted((r.match_id, r.selection, r.odds) for r in jobs.read_latest_quotes(spark, target).collect()) == [(1, "H", 3.0), (2, "D", 1.5), (2, "H", 7.0)]
    # an older change is in the snapshot, so its folder is not read any more
    assert jobs.read_latest_quotes(spark, target, before=2).count() == 3
    assert spark.read.parquet(f"{target}/late").count() == 2 and spark.read.parquet(f"{target}/no_cutoff").count() == 4


def test_collector_takes_pages_apart_once(spark, tmp_path, monkeypatch):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "0.json").write_text("\n".join([_odds_page(1, "2024-01-20T10:00:00+00:00", 2.0), _odds_page(2, None, 2.0)]))
    calls, take = [], feeds.odds_values
    for module in (feeds, jobs):
        monkeypatch.setattr(module, "odds_values", lambda *a: calls.append(a) or take(*a))
    jobs.collect_odds(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(calls) == 2  # one for the schema
    manifest = spark.read.parquet(str(tmp_path / "out_manifest")).first()
    assert (manifest.rows, manifest.fixtures, manifest.invalid_values, manifest.untimed_items) == (1, 1, 1, 1)
    assert "collection" not in spark.read.parquet(str(tmp_path / "out_rejected")).columns
