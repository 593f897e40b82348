"""Registered composite jobs (P1-P19) on their end tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import token_key
from ..functions.scalars import round6
from ..operators import market as m
from ..operators import players as pl
from ..operators import resolve as r
from ..operators.quality import evenly_spaced, fixture_coverage, lineup_backlog, modal_roles, payload_facts, payload_reasons
from ..plans import jobs
from ..plans.views import view
from ..session import table
from ..sources import feeds
from .evaluation import EDGE_SQL, GRID_SQL, METRIC_SQL, edge_inputs, int_key, metric_block, r6s, rated
from .history import matches
from .market import PRICED_SQL, PRICES, priced
from .players import LINEUP13, lineups, slots, squad_observations
from .quality import READY, payloads, stored_lineups
from .registry import query
from .resolution import FACTS, J7, canonical, external, facts, j7
from .sources import feed_payloads, line_numbers, report_frame, roster_frame, season_rows, wide_frame

P1_SQL = """rec AS (SELECT m.match_id AS source, substr(sha256(concat(league, '|', season, '|', CAST(match_date AS VARCHAR), '|', home_team, '|', away_team)), 1, 24) AS pid, match_id FROM v_match m),
 tr AS (SELECT source, pid, 'Market Average' AS bookmaker FROM rec WHERE match_id % 7 <> 0 UNION ALL SELECT source, pid, 'Bet365' FROM rec WHERE match_id % 3 <> 0)"""


@query("p1_season_load", P1_SQL + " SELECT (SELECT count(*) FROM v_match) AS matches, (SELECT 3 * count(*) FROM tr t JOIN (SELECT DISTINCT pid, pid AS p2 FROM rec) d ON d.pid = t.pid) AS odds_selections")
def p1(spark, sf):
    raw = season_rows(spark, sf).withColumnsRenamed({"season": "Season", "league": "League"})
    nothing = matches(spark, sf).select(F.col("match_id").cast("string").alias("match_id"), "date", "league", "home_team", "away_team").filter("false")
    mapping = nothing.select(F.lit("S").alias("provider"), F.col("match_id").alias("provider_match_id"), "match_id")
    stored = nothing.select("match_id", F.lit("").alias("bookmaker"), F.lit("").alias("provider"), F.lit("").alias("market"), F.lit("").alias("timing"), F.lit(None).cast("timestamp").alias("timestamp"))
    return jobs.load_seasons(raw, nothing, mapping, stored, "S", 1)["summary"]


def outcome(result):
    return result["status"].groupBy("status").agg(F.count(F.lit(1)).alias("games"))


def empty_store(spark, sf):
    rows = lineups(spark, sf).filter("false")
    stored = rows.select("match_id", F.lit(0).cast("long").alias("team_id"), F.lit("").alias("provider"), "player_id", "lineup_role", "position")
    registry = rows.select(F.lit("").alias("provider"), F.col("player_id").alias("provider_player_id"), "player_id")
    members = rows.select("player_id", F.lit(0).cast("long").alias("team_id"), F.lit("").alias("provider"))
    return stored, registry, members


def games_of(spark, sf):
    ext = external(spark, sf)
    return ext, ext.filter("external_id % 11 = 0").select("external_id")


def keyed(spark, sf, frame):
    """Provider payloads of the line-up views keyed by the external game id."""
    ids = external(spark, sf).select("external_id", F.col("true_match_id").alias("match_id"))
    return frame.join(ids, "match_id").drop("match_id")


def run(spark, sf, rows, resolver, provider, games=None, target=None):
    ext, done = games_of(spark, sf)
    stored, registry, members = empty_store(spark, sf)
    return jobs.import_lineups(ext if games is None else games, rows, canonical(spark, sf) if target is None else target, resolver, provider, stored, registry, members, done)


STATUS = """st AS (SELECT e.external_id, CASE WHEN e.external_id % 11 = 0 THEN 'already_imported' WHEN {incomplete} THEN 'incomplete_lineup' WHEN h.match_id IS NULL THEN 'unresolved' ELSE 'imported' END AS status
 FROM v_external e LEFT JOIN hit h ON h.external_id = e.external_id) SELECT status, count(*) AS games FROM st GROUP BY status"""
NEAR = "e.league = c.league AND e.external_home_id - 500000 = c.home_id AND e.external_away_id - 500000 = c.away_id AND abs(date_diff('day', e.match_date, c.match_date)) <= 1"
BY_IDS = f"hit AS (SELECT e.external_id, min(c.match_id) AS match_id FROM v_external e JOIN v_fixture c ON {NEAR} AND e.home_goals = c.home_goals AND e.away_goals = c.away_goals GROUP BY e.external_id HAVING count(*) = 1), "
BY_KEY = """c0 AS (SELECT match_date, lower(home_name) AS h, lower(away_name) AS a, max(match_id) AS match_id FROM v_fixture GROUP BY ALL),
 hit AS (SELECT e.external_id, c0.match_id FROM v_external e JOIN c0 ON c0.match_date = e.match_date AND c0.h = lower(substr(e.home_name, 4)) AND c0.a = lower(replace(e.away_name, ' Calcio', ''))), """
POSITIONS = "bad AS (SELECT match_id FROM v_lineup WHERE slot < 11 GROUP BY match_id HAVING count(*) <> 22 OR count(position) <> 22), "


@query("p2_coordinate_load", BY_IDS + STATUS.format(incomplete="e.true_match_id % 17 = 0"))
def p2(spark, sf):
    wide = keyed(spark, sf, wide_frame(spark, sf, "coordinates"))
    return outcome(run(spark, sf, jobs.coordinate_slots(wide), r.by_team_ids, "coordinates"))


@query("p3_named_slot_load")
def p3(spark, sf):
    wide = keyed(spark, sf, wide_frame(spark, sf, "named_slots"))
    known = modal_roles(lineups(spark, sf).select(F.lower("player_id").alias("key"), feeds.role_from_name("position").alias("role")), "key", "role")
    teams = lineups(spark, sf).select("match_id", "side", "team").distinct()
    rows, doubtful = jobs.named_slots(wide, known, keyed(spark, sf, teams))
    result = run(spark, sf, rows, r.by_similar_names, "slots")
    ext, _ = games_of(spark, sf)
    gated = jobs.create_or_unresolved(result["status"], ext, r.unmapped_league_seasons(canonical(spark, sf), result["mapping"]))
    counted = gated.groupBy("status").agg(F.count(F.lit(1)).alias("games"))
    return counted.unionByName(doubtful.groupBy(F.col("reason").alias("status")).agg(F.count(F.lit(1)).alias("games")))


@query("p4_external_load")
def p4(spark, sf):
    rows = keyed(spark, sf, lineups(spark, sf)).withColumnsRenamed({"external_id": "game_id", "side": "club_id"})
    listed = rows.filter("slot < 11 AND NOT (game_id % 6 = 0 AND slot = 2)").select("game_id", "club_id", "player_id", F.lit("starting_lineup").alias("type"), "position")
    played = rows.filter("slot < 13").select("game_id", "club_id", "player_id")
    subs = rows.filter("slot IN (11, 12)").select("game_id", "club_id", F.col("player_id").alias("player_in_id"))
    positions = rows.groupBy("player_id").agg(F.max("position").alias("position"))
    slots_ = jobs.external_slots(listed, played, subs, positions).select(
        F.col("game_id").alias("external_id"), F.col("club_id").alias("side"), F.col("player_id").alias("provider_player_id"), F.col("player_id").alias("player_name"), F.lit("starter").alias("lineup_role"),
        feeds.role_from_name("position").alias("position"))
    return outcome(run(spark, sf, slots_, r.resolve_waterfall, "external"))


@query("p5_gap_fill")
def p5(spark, sf):
    rows = feeds.wide_eleven(keyed(spark, sf, wide_frame(spark, sf, "named_positions")), ["external_id"], "named_positions").filter("player_name IS NOT NULL").select(
        "external_id", "side", F.col("player_name").alias("provider_player_id"), "player_name", F.lit("starter").alias("lineup_role"), feeds.role_from_name("position").alias("position"))
    can = canonical(spark, sf)
    sides = can.select("match_id", F.explode(F.array("home_name", "away_name")).alias("team"))
    held = can.filter("match_id % 3 <> 0").select("match_id", F.explode(F.array("home_name", "away_name")).alias("team")).join(lineups(spark, sf).filter("side = 'home' AND slot < 11").select("match_id", "lineup_role", "position"), "match_id")
    target = jobs.gap_targets(external(spark, sf), can, sides, held.withColumn("lineup_id", F.concat_ws("|", F.col("match_id"), "team")))
    return outcome(run(spark, sf, rows, r.by_similar_names, "gaps", target=target))


@query("p6_report_load")
def p6(spark, sf):
    reports = feeds.parsed(report_frame(spark, sf), "value", feeds.REPORT).withColumn("match_id", F.col("id").cast("long"))
    valid = jobs.report_slots(reports.drop("match_id")).withColumn("match_id", F.col("external_id").cast("long")).drop("external_id")
    return outcome(run(spark, sf, keyed(spark, sf, valid), r.by_similar_names, "reports"))


@query("p7_roster_load", POSITIONS + BY_KEY + STATUS.format(incomplete="EXISTS (SELECT 1 FROM bad WHERE bad.match_id = e.true_match_id)"))
def p7(spark, sf):
    parsed = feeds.parsed(keyed(spark, sf, roster_frame(spark, sf)), "payload", feeds.ROSTER, "external_id", "side")
    return outcome(run(spark, sf, jobs.roster_slots(parsed), lambda g, c: r.by_name_key(g, c, token_key), "rosters"))


@query("p8_feed_backfill", POSITIONS + BY_KEY + STATUS.format(incomplete="EXISTS (SELECT 1 FROM bad WHERE bad.match_id = e.true_match_id)"))
def p8(spark, sf):
    parsed = feeds.parsed(keyed(spark, sf, feed_payloads(spark, sf)), "payload", feeds.FEED_LINEUP, "external_id")
    rows, _ = jobs.feed_slots(parsed)
    return outcome(run(spark, sf, rows, r.by_name_key, "feed"))


@query("p9_payload_import", """v AS (SELECT match_id, league, CAST(match_id % 25 = 0 OR match_id % 14 = 0 OR match_id % 17 = 0 OR match_id % 9 = 0 AS INT) AS bad FROM v_match WHERE match_id % 3 = 0)
 SELECT league, count(CASE WHEN bad = 0 THEN 1 END) AS importable, count(CASE WHEN bad = 1 THEN 1 END) AS failed FROM v GROUP BY league""")
def p9(spark, sf):
    games = matches(spark, sf)
    worklist = lineup_backlog(games, games.filter("match_id % 3 = 0"), lineups(spark, sf).filter("false").select("match_id", F.col("team").alias("team_id")))
    judged = payload_reasons(payloads(spark, sf, worklist))
    return judged.groupBy("league").agg(F.count_if(F.size("reasons") == 0).alias("importable"), F.count_if(F.size("reasons") > 0).alias("failed"))


@query("p10_reconcile_all", J7 + " SELECT e.league, status, count(*) AS fixtures FROM st JOIN v_external e USING (external_id) GROUP BY ALL")
def p10(spark, sf):
    status = j7(spark, sf)
    leagues = external(spark, sf).select(F.col("external_id").alias("fixture_id"), "league")
    return jobs.reconcile_summary(status.join(leagues, "fixture_id"))


@query("p11_cutoff_manifest")
def p11(spark, sf):
    items = table(spark, sf, "lineitem")
    price = {"home": F.lit(1.2) + F.col("l_quantity") / 20, "draw": F.lit(2.5) + F.col("l_discount") * 10, "away": F.lit(1.5) + F.col("l_tax") * 40}
    books = line_numbers(items)
    measures = [F.max(F.when(F.col("l_linenumber") == int(b), p)).alias(f"{s}_b{n}_70") for n, b in enumerate(books, start=1) for s, p in price.items()]
    series = items.groupBy((F.col("l_orderkey") + 1000000000).alias("match_id")).agg(*measures)
    source = external(spark, sf).select(F.col("external_id").alias("source_id"), "match_date", "home_goals", "away_goals", "home_name", "away_name", F.col("match_date").cast("timestamp").alias("kickoff"))
    return jobs.cutoff_snapshot_with_manifest(series, canonical(spark, sf), source, books)["manifest"]


@query(
    "p12_weather",
    """SELECT match_id, CASE WHEN match_id % 4 = 0 THEN -1.0e0 WHEN match_id % 2 = 0 THEN 21.0e0 ELSE 12.0e0 END AS temperature_c FROM v_match""",
)
def p12(spark, sf):
    games = matches(spark, sf).select("match_id", F.when(F.col("match_id") % 2 == 0, F.expr("cast(date AS timestamp) + INTERVAL '20:45' HOUR TO MINUTE")).otherwise(F.expr("cast(date AS timestamp) + INTERVAL '12:30' HOUR TO MINUTE")).alias("kickoff"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(F.date_format("kickoff", "yyyy-MM-dd"), F.lit("T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00:00")))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h.cast("double"))
    hourly = games.select("match_id", F.struct(hours.alias("time"), numbers.alias("temperature_2m"), numbers.alias("precipitation"), numbers.alias("wind_speed_10m")).alias("hourly"))
    known = games.filter("match_id % 4 = 0").select("match_id", F.col("kickoff").alias("observed_at"), F.lit(-1.0).alias("temperature_c"), F.lit(0.0).alias("precipitation_mm"), F.lit(0.0).alias("wind_kph"))
    return jobs.attach_weather(games, known, hourly).select("match_id", "temperature_c")


@query(
    "p13_sampled_coverage",
    """o AS (SELECT match_id, league, season, row_number() OVER (PARTITION BY league, season ORDER BY match_date, match_id) - 1 AS p, count(*) OVER (PARTITION BY league, season) AS n FROM v_match),
 sm AS (SELECT match_id FROM o WHERE n <= 5 OR p IN (SELECT CAST(round_even(i * (o.n - 1) / 4.0e0, 0) AS BIGINT) FROM (SELECT unnest(range(5)) AS i))),
 f AS (SELECT match_id, league, season, count(DISTINCT side) AS sides, count(*) AS people, count(CASE WHEN NOT (slot = 12 AND match_id % 9 = 0) THEN 1 END) AS ids, count(position) AS pos FROM v_lineup WHERE NOT (side = 'away' AND match_id % 25 = 0) AND match_id IN (SELECT match_id FROM sm) GROUP BY ALL)
 SELECT league, season, count(*) AS fixtures, r6(avg(CASE WHEN sides = 2 THEN 1.0e0 ELSE 0.0e0 END)) AS two_lineups_rate, r6(avg(CASE WHEN sides = 2 AND match_id % 17 <> 0 THEN 1.0e0 ELSE 0.0e0 END)) AS complete_starting_xi_rate, r6(avg(CASE WHEN sides = 2 THEN 1.0e0 ELSE 0.0e0 END)) AS bench_rate,
 r6(avg(ids * 1.0e0 / people)) AS player_id_rate, r6(avg(pos * 1.0e0 / people)) AS position_rate, r6(avg(CASE WHEN sides = 2 AND match_id % 4 <> 0 THEN 1.0e0 ELSE 0.0e0 END)) AS formation_rate FROM f GROUP BY ALL""",
)
def p13(spark, sf):
    sample = evenly_spaced(matches(spark, sf), ["league", "season"], "date", ["match_id"], 5).select("match_id")
    out = fixture_coverage(payload_facts(payloads(spark, sf, sample)))
    return r6s(out, ["two_lineups_rate", "complete_starting_xi_rate", "bench_rate", "player_id_rate", "position_rate", "formation_rate"])


@query("p14_ready_set", READY + " SELECT league, season, count(*) AS total, count(CASE WHEN r1 + r2 + r3 + r4x + r5 + r6x = 0 THEN 1 END) AS ready FROM jd GROUP BY ALL")
def p14(spark, sf):
    games = matches(spark, sf).withColumn("result", F.when(F.col("match_id") % 31 != 0, F.col("result")))
    return jobs.ready_dataset(games, stored_lineups(spark, sf), ["alpha", "beta"], ["1995"])["coverage"]


@query(
    "p15_feature_store",
    FACTS + """, kn AS (SELECT f.*, m.match_date FROM ff f JOIN v_match m ON m.match_id = f.game_id WHERE game_id % 6 <> 0 AND club_id % 9 <> 0 AND NOT coalesce(minute_in > minute_out, false)),
 n AS (SELECT *, count(*) OVER w AS obs, count(CASE WHEN lineup_role = 'starter' THEN 1 END) OVER w AS starts, avg(minutes_played) OVER w AS mm FROM kn WINDOW w AS (PARTITION BY player_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
 SELECT game_id AS match_id, concat('i-', player_id) AS player_id, obs AS observations, r6(starts * 1.0e0 / nullif(obs, 0)) AS start_rate, r6(coalesce(mm, CASE WHEN starts > 0 THEN 90.0e0 END)) AS mean_minutes FROM n""",
)
def p15(spark, sf):
    games = matches(spark, sf)
    match_map = games.filter("match_id % 6 <> 0").select(F.col("match_id").alias("game_id"), "match_id")
    player_map = view(spark, sf, "v_obs").select("player_id").distinct().withColumn("internal_player_id", F.concat(F.lit("i-"), "player_id"))
    team_map = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("club_id"), F.col("s_suppkey").alias("team_id")).filter("club_id % 9 <> 0")
    out = jobs.player_feature_store(facts(spark, sf), match_map, player_map, team_map, games)["matrix"]
    return out.select("match_id", "player_id", F.col("observations_value").alias("observations"), round6("start_rate_value").alias("start_rate"), round6("mean_minutes_value").alias("mean_minutes"))


@query(
    "p16_attach_lineup_aggregates",
    LINEUP13 + " SELECT m.match_id, m.season, r6(h.strength) AS home_player_expected_strength, r6(a.continuity) AS away_player_lineup_continuity FROM v_match m LEFT JOIN agg h ON h.team = m.home_team AND h.match_date = m.match_date LEFT JOIN agg a ON a.team = m.away_team AND a.match_date = m.match_date",
)
def p16(spark, sf):
    games = matches(spark, sf)
    out = jobs.attach_lineup_aggregates(games.select("match_id", "season"), games, lineups(spark, sf))
    return out.select("match_id", "season", round6("home_player_expected_strength").alias("home_player_expected_strength"), round6("away_player_lineup_continuity").alias("away_player_lineup_continuity"))


@query("p17_candidate_evaluation", "SELECT season, concat('score_model_linear/', a) AS model, count(*) AS matches FROM v_match CROSS JOIN (SELECT unnest(['base', 'combined']) AS a) WHERE season > (SELECT min(season) FROM v_match) GROUP BY ALL")
def p17(spark, sf):
    store = pl.encode_temporal(pl.temporal_player_matrix(squad_observations(spark, sf)), ["match_id", "player_id"]).select(
        "match_id", "player_id", "fs_store_available", "fs_observations_value", "fs_observations_quality", "fs_mean_minutes_available", "fs_mean_minute_in_available", "fs_mean_minute_out_available")
    rates = rated(spark, sf).select("match_id", "season", "home_rate", "away_rate", "rho")
    out = jobs.evaluate_candidates(matches(spark, sf), slots(spark, sf), rates, store, ["career_strength", "fs_observations_value"], ["base", "combined"], ["linear"])
    return out["metrics"].select("season", "model", "matches")


@query(
    "p18_reference_comparison",
    METRIC_SQL.replace("FROM v_pred)", "FROM v_pred WHERE match_id % 4 <> 0)") + f", bs AS (SELECT * FROM {metric_block('season, model')}) SELECT model, CAST(sum(matches) AS BIGINT) AS matches, r6(sum(log_loss * matches) / sum(matches)) AS log_loss, r6(sum(ece * matches) / sum(matches)) AS ece FROM bs GROUP BY model",
)
def p18(spark, sf):
    renamed = view(spark, sf, "v_pred").withColumnsRenamed({"p_h": "probability_home", "p_d": "probability_draw", "p_a": "probability_away"})
    candidate, reference = renamed.filter("model = 'candidate'"), renamed.filter("model = 'reference' AND match_id % 4 <> 0")
    out = jobs.compare_references(candidate, {"reference": reference}, 2000, int_key())["means"]
    return r6s(out.select("model", "matches", "log_loss", "ece"), ["log_loss", "ece"])


@query(
    "p19_edge_research",
    EDGE_SQL + GRID_SQL + """, br AS (SELECT * FROM rs ORDER BY round(profit / bets, 12) DESC, bets DESC, rule_id LIMIT 1), al AS (SELECT 'discovery' AS period, * FROM di UNION ALL SELECT 'holdout', * FROM ho)
 SELECT period, count(*) AS bets, r4(sum(al.profit)) AS profit_units FROM al JOIN br ON mp >= mc AND edge >= me AND gap >= mg AND contains(picks, pick) AND (xi = 0 OR experienced) GROUP BY period""",
)
def p19(spark, sf):
    out = jobs.edge_research(*edge_inputs(spark, sf), "B1", 200, 5000, int_key())
    return out.summary.select("period", "bets", F.round("profit_units", 4).alias("profit_units"))


@query(
    "p_match_features",
    PRICED_SQL + """, mean AS (SELECT match_id, avg(CASE WHEN selection = 'H' THEN p END) AS ph FROM long WHERE timing = 'closing' GROUP BY match_id)
 SELECT m.match_id, r6(ph) AS market_home_probability FROM v_match m LEFT JOIN mean USING (match_id)""",
)
def p_features(spark, sf):
    rows, _ = m.normalize_snapshots(priced(spark, sf), PRICES, ["match_id", "market", "opening_or_closing"])
    return jobs.match_features(matches(spark, sf), rows).select("match_id", round6("market_home_probability").alias("market_home_probability"))

