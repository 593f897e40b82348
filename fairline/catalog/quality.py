"""Registered gates, censuses and coverage (Q1-Q11, G-A20 - G-A35, W2, T2, T4, T6, T8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..operators import players as pl
from ..operators import quality as q
from ..operators import scores as sc
from ..plans.views import view
from ..session import staging_dir, table
from .evaluation import r6s
from .history import matches
from .players import lineups, observations
from .registry import query


@query(
    "q1_contract_checks",
    """v AS (SELECT 1 AS missing_columns, 0 AS too_few_rows, (SELECT count(*) - count(DISTINCT (league, match_date)) FROM v_match) AS duplicate_keys, (SELECT count(*) FROM v_match WHERE result NOT IN ('H', 'D')) AS domain_result),
 c AS (SELECT 'missing_columns' AS "check", missing_columns AS violations FROM v UNION ALL SELECT 'too_few_rows', too_few_rows FROM v UNION ALL SELECT 'duplicate_keys', duplicate_keys FROM v UNION ALL SELECT 'domain_result', domain_result FROM v)
 SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
)
def q1(spark, sf):
    return q.contract_checks(matches(spark, sf), ["match_id", "result", "venue"], ["league", "date"], {"result": ["H", "D"]})


def ready_payload(spark, sf):
    """One JSON array of starters per side; some hold a repeated player, some are unreadable."""
    rows = lineups(spark, sf).filter("slot < 11")
    shown = F.when((F.col("slot") == 4) & (F.col("match_id") % 10 == 0), F.lit("twice")).when((F.col("slot") == 5) & (F.col("match_id") % 10 == 0), F.lit("twice")).otherwise(F.col("player_id"))
    one = rows.groupBy("match_id", "side").agg(F.to_json(F.collect_list(F.struct(shown.alias("player_id"), F.col("position")))).alias("payload"))
    broken = F.when(F.col("match_id") % 13 == 0, F.lit("{oops")).otherwise(F.col("payload"))
    wide = one.withColumn("payload", broken).groupBy("match_id").agg(
        F.max(F.when(F.col("side") == "home", F.col("payload"))).alias("home_starters"), F.max(F.when(F.col("side") == "away", F.col("payload"))).alias("away_starters"))
    return wide


@query(
    "q2_lineup_arrays",
    """l AS (SELECT match_id, concat(side, '_starters') AS column_name, count(*) AS n FROM v_lineup WHERE slot < 11 GROUP BY ALL)
 SELECT column_name, count(*) AS lineups, count(CASE WHEN match_id % 13 = 0 THEN 1 END) AS unreadable, count(CASE WHEN match_id % 13 <> 0 AND n <> 11 THEN 1 END) AS wrong_size, count(CASE WHEN match_id % 13 <> 0 AND match_id % 10 = 0 THEN 1 END) AS with_duplicates FROM l GROUP BY 1""",
)
def q2(spark, sf):
    return q.lineup_array_checks(ready_payload(spark, sf), ["home_starters", "away_starters"])


def store(spark, sf):
    return pl.temporal_player_matrix(observations(spark, sf))


@query(
    "q3_temporal_store",
    """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY line, l_extendedprice, l_partkey, team_id) AS rn FROM v_obs) WHERE rn = 1),
 n AS (SELECT *, count(*) OVER (PARTITION BY player_id ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS obs FROM d)
 SELECT count(*) AS rows, count(*) AS unique_keys, 0 AS duplicate_keys, count(CASE WHEN match_id % 5 = 0 THEN 1 END) AS orphan_rows, 0 AS invalid_identifiers, 0 AS invalid_kickoffs, r6(avg(CASE WHEN obs > 0 THEN 1.0e0 ELSE 0.0e0 END)) AS availability_rate FROM n""",
)
def q3(spark, sf):
    out = q.temporal_store_checks(store(spark, sf), matches(spark, sf).filter("match_id % 5 <> 0"), ["observations", "start_rate"])
    return r6s(out, ["availability_rate"])


@query(
    "q3_label_counts",
    """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY line, l_extendedprice, l_partkey, team_id) AS rn FROM v_obs) WHERE rn = 1),
 n AS (SELECT *, count(minutes_played) OVER (PARTITION BY player_id ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS known FROM d)
 SELECT 'mean_minutes_quality' AS column_name, CASE WHEN known > 0 THEN 'reported' ELSE 'proxy' END AS label, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'mean_minutes_fallback_kind', CASE WHEN known > 0 THEN 'none' ELSE 'starter_90' END, count(*) FROM n GROUP BY 2
 UNION ALL SELECT 'team_experience_quality', 'observed_interval', count(*) FROM n""",
)
def q3_labels(spark, sf):
    return q.label_counts(store(spark, sf), ["mean_minutes_quality", "mean_minutes_fallback_kind", "team_experience_quality"])


@query(
    "q4_numeric_checks",
    "SELECT count(CASE WHEN match_id % 97 = 3 THEN 1 END) AS infinite_values, count(CASE WHEN home_shots IS NULL THEN 1 END) AS missing_values, count(CASE WHEN result = 'H' THEN 1 END) AS result_H, count(CASE WHEN result = 'D' THEN 1 END) AS result_D, count(CASE WHEN result = 'A' THEN 1 END) AS result_A, 0 AS other_results FROM v_match",
)
def q4(spark, sf):
    rows = matches(spark, sf).withColumn("score", F.when(F.col("match_id") % 97 == 3, F.lit(float("inf"))).otherwise(1.0))
    return q.numeric_checks(rows, ["score", "home_shots"])


def cutoff_rows(spark, sf):
    games = matches(spark, sf).select("match_id", F.date_add("date", 40).cast("timestamp").alias("prediction_cutoff"))
    return view(spark, sf, "v_odds").filter("NOT (selection = 'D' AND seq = 4)").join(games, "match_id").select(
        "match_id", "bookmaker", "selection", "prediction_cutoff", F.when(F.col("seq") != 6, F.col("quoted_at").cast("timestamp")).alias("provider_updated_at"))


@query(
    "q5_cutoff_gate",
    """r AS (SELECT o.match_id, bookmaker, selection, CASE WHEN seq <> 6 THEN quoted_at END AS upd, m.match_date + INTERVAL '40 days' AS cut, m.league FROM v_odds o JOIN v_match m USING (match_id) WHERE NOT (selection = 'D' AND seq = 4)),
 g AS (SELECT match_id, bookmaker, count(DISTINCT selection) AS s, max(league) AS league FROM r GROUP BY ALL)
 SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(upd) FROM r) AS timestamped_rows, (SELECT count(*) FROM r WHERE upd <= cut) AS cutoff_valid_rows, count(*) AS markets, count(CASE WHEN s = 3 THEN 1 END) AS complete_markets,
 count(DISTINCT CASE WHEN league = '1' THEN match_id END) AS eligible_matches, 0 AS passed FROM g""",
)
def q5(spark, sf):
    out = q.cutoff_gate(cutoff_rows(spark, sf), matches(spark, sf).filter("league = '1'"))
    return out.withColumn("passed", F.col("passed").cast("int"))


@query("ga32_complete_markets", "SELECT match_id, bookmaker, count(DISTINCT selection) AS selections FROM v_odds WHERE NOT (selection = 'D' AND seq = 4) GROUP BY ALL HAVING count(DISTINCT selection) = 3")
def ga32(spark, sf):
    return q.complete_markets(cutoff_rows(spark, sf))


# Three providers list the same sides: one drops a starter now and then, one lists no positions.
STORED = """hd AS (SELECT l.match_id, l.season, l.league, l.team AS team_id, l.side, l.slot, l.player_id, l.position, CAST(k AS INT) AS k, CASE k WHEN 0 THEN 'gamma' WHEN 1 THEN 'alpha' ELSE 'beta' END AS provider, concat('L', CAST(k AS VARCHAR), '-', CAST(l.match_id AS VARCHAR), '-', l.side) AS lineup_id,
  CASE WHEN l.slot < 11 THEN 'starter' ELSE 'substitute' END AS lineup_role FROM v_lineup l CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE NOT (k = 1 AND l.match_id % 2 = 0 AND l.slot = 5) AND NOT (k = 2 AND l.match_id % 3 = 0) AND NOT (k = 0 AND l.match_id % 4 <> 1)),
 cp AS (SELECT match_id, lineup_id, team_id, side, provider, count(CASE WHEN lineup_role = 'starter' THEN 1 END) AS starters, count(CASE WHEN lineup_role = 'starter' AND position IS NULL THEN 1 END) AS starters_without_position, count(CASE WHEN lineup_role <> 'starter' THEN 1 END) AS bench FROM hd GROUP BY ALL),
 ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY CASE provider WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 ELSE 99 END, bench DESC, lineup_id) AS rn FROM cp WHERE starters = 11) WHERE rn = 1)"""


def stored_lineups(spark, sf):
    rows = lineups(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.filter("NOT (k = 1 AND match_id % 2 = 0 AND slot = 5) AND NOT (k = 2 AND match_id % 3 = 0) AND NOT (k = 0 AND match_id % 4 <> 1)")
    return rows.select(
        "match_id", "season", "league", "side", "player_id", "position", F.col("team").alias("team_id"), F.when(F.col("k") == 0, "gamma").when(F.col("k") == 1, "alpha").otherwise("beta").alias("provider"),
        F.concat(F.lit("L"), F.col("k").cast("string"), F.lit("-"), F.col("match_id").cast("string"), F.lit("-"), F.col("side")).alias("lineup_id"),
        F.when(F.col("slot") < 11, "starter").otherwise("substitute").alias("lineup_role"), F.when(F.col("slot") % 2 == 0, F.col("slot")).alias("shirt_number"), "timing_observed")


@query("ga22_lineup_completeness", STORED + " SELECT match_id, lineup_id, team_id, provider, starters, starters_without_position, bench FROM cp")
def ga22(spark, sf):
    return q.lineup_completeness(stored_lineups(spark, sf))


def chosen(spark, sf):
    return q.choose_lineups(q.lineup_completeness(stored_lineups(spark, sf)), ["alpha", "beta"])


@query("w2_choose_lineup", STORED + " SELECT match_id, team_id, lineup_id, provider, bench FROM ch")
def w2(spark, sf):
    return chosen(spark, sf).select("match_id", "team_id", "lineup_id", "provider", "bench")


READY = STORED + """, du AS (SELECT DISTINCT match_id FROM (SELECT h.match_id, h.player_id FROM hd h JOIN ch USING (lineup_id) WHERE h.lineup_role = 'starter' GROUP BY h.match_id, h.player_id HAVING count(*) > 1)),
 jd AS (SELECT m.match_id, m.league, m.season, CASE WHEN a.starters_without_position > 0 THEN 1 ELSE 0 END AS r1, CASE WHEN du.match_id IS NOT NULL THEN 1 ELSE 0 END AS r2, CASE WHEN h.starters_without_position > 0 THEN 1 ELSE 0 END AS r3,
  CASE WHEN m.match_id % 31 = 0 THEN 1 ELSE 0 END AS r4x, CASE WHEN a.lineup_id IS NULL THEN 1 ELSE 0 END AS r5, CASE WHEN h.lineup_id IS NULL THEN 1 ELSE 0 END AS r6x, h.lineup_id AS hl, a.bench AS ab
  FROM v_match m LEFT JOIN ch h ON h.match_id = m.match_id AND h.team_id = m.home_team LEFT JOIN ch a ON a.match_id = m.match_id AND a.team_id = m.away_team LEFT JOIN du ON du.match_id = m.match_id WHERE m.season <> '1995')"""


def judged(spark, sf):
    games = matches(spark, sf).withColumn("result", F.when(F.col("match_id") % 31 != 0, F.col("result")))
    return games, q.ready_set(games, chosen(spark, sf), stored_lineups(spark, sf), ["1995"])


@query(
    "q6_ready_set",
    READY + """ SELECT match_id, CASE WHEN r1 + r2 + r3 + r4x + r5 + r6x = 0 THEN 'ready' ELSE concat_ws(',', CASE WHEN r1 = 1 THEN 'away_starter_role_missing' END, CASE WHEN r2 = 1 THEN 'duplicate_starter' END, CASE WHEN r3 = 1 THEN 'home_starter_role_missing' END,
 CASE WHEN r4x = 1 THEN 'invalid_result' END, CASE WHEN r5 = 1 THEN 'missing_away_lineup' END, CASE WHEN r6x = 1 THEN 'missing_home_lineup' END) END AS outcome FROM jd""",
)
def q6(spark, sf):
    _, (ready, rejected) = judged(spark, sf)
    return ready.select("match_id", F.lit("ready").alias("outcome")).unionByName(rejected.select("match_id", F.array_join("reasons", ",").alias("outcome")))


@query(
    "ga24_reason_counts",
    READY + """ SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN r1 = 1 THEN 'away_starter_role_missing' END, CASE WHEN r2 = 1 THEN 'duplicate_starter' END, CASE WHEN r3 = 1 THEN 'home_starter_role_missing' END,
 CASE WHEN r4x = 1 THEN 'invalid_result' END, CASE WHEN r5 = 1 THEN 'missing_away_lineup' END, CASE WHEN r6x = 1 THEN 'missing_home_lineup' END], lambda x: x IS NOT NULL)) AS reason FROM jd) GROUP BY reason""",
)
def ga24(spark, sf):
    return q.reason_counts(judged(spark, sf)[1][1])


@query("ga23_coverage", READY + " SELECT league, season, count(*) AS total, count(CASE WHEN r1 + r2 + r3 + r4x + r5 + r6x = 0 THEN 1 END) AS ready FROM jd GROUP BY ALL")
def ga23(spark, sf):
    games, (ready, _) = judged(spark, sf)
    return q.coverage(games.filter("season <> '1995'"), ready)


@query(
    "q7_constraints",
    """SELECT 'odds' AS table_name, 'price_above_one' AS rule, count(CASE WHEN NOT odds > 1.5e0 THEN 1 END) AS violations FROM v_odds UNION ALL SELECT 'odds', 'timing_domain', count(CASE WHEN timing NOT IN ('opening', 'closing') THEN 1 END) FROM v_odds
 UNION ALL SELECT 'odds', 'unique:match_id,bookmaker,selection,timing', (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM v_odds GROUP BY match_id, bookmaker, selection, timing))""",
)
def q7(spark, sf):
    rules = {"price_above_one": "odds > 1.5e0", "timing_domain": "timing IN ('opening', 'closing')"}
    return q.constraint_violations(view(spark, sf, "v_odds"), "odds", rules, ["match_id", "bookmaker", "selection", "timing"])


@query(
    "q8_content_fingerprint",
    """d AS (SELECT CAST('0x' || substr(md5(concat(CAST(home_goals AS VARCHAR), chr(1), league, chr(1), CAST(match_id AS VARCHAR))), 1, 12) AS BIGINT) AS x FROM v_match)
 SELECT count(*) AS rows, CAST(sum(x) AS VARCHAR) AS digest_sum, bit_xor(x) AS digest_xor FROM d""",
)
def q8(spark, sf):
    return q.content_fingerprint(matches(spark, sf).select("match_id", "league", "home_goals"))


@query("q8_manifest_compare", "SELECT CAST(count(DISTINCT league) - 1 AS INT) AS same, 1 AS changed, count(*) AS matches FROM v_match")
def q8_manifest(spark, sf):
    root = staging_dir(spark, "manifest")
    games = matches(spark, sf)
    games.select("match_id", "season", "league").repartition("league").write.partitionBy("league").option("header", True).csv(root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root)
    now = files.select(F.regexp_extract("path", "/league=([^/]+)/[^/]+$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    recorded = now.withColumn("sha256", F.when(F.col("file") == "2", F.lit("other")).otherwise(F.col("sha256")))
    status = q.compare_manifest(now, recorded)
    total = games.agg(F.count(F.lit(1)).alias("matches")).scalar()
    return status.agg(F.count_if(F.col("status") == "same").cast("int").alias("same"), F.count_if(F.col("status") == "changed").cast("int").alias("changed")).withColumn("matches", total)


def payloads(spark, sf, only=None):
    """Nested line-up payload per match (of ``only``, if given); some sides lack a starter, a name or the second line-up."""
    rows = lineups(spark, sf)
    if only is not None:
        # before the payloads are built: Spark moves the join below their aggregates only if it can broadcast it
        rows = rows.join(only.select("match_id"), "match_id", "left_semi")
    who = F.struct(F.when(~((F.col("slot") == 12) & (F.col("match_id") % 9 == 0)), F.col("player_id")).alias("id"), F.col("player_id").alias("name"), F.col("position").alias("pos"))
    entry = F.struct(who.alias("player"))
    # a match's narrow rows move once; its payload is made and put together where they lie
    side = rows.repartition("match_id").groupBy("match_id", "league", "season", "side", "team").agg(
        F.collect_list(F.when(F.col("slot") < 11, entry)).alias("startXI"), F.collect_list(F.when(F.col("slot") >= 11, entry)).alias("substitutes"))
    name = F.when(~((F.col("side") == "away") & (F.col("match_id") % 14 == 0)), F.col("team"))
    packed = F.struct(F.struct(F.lit(1).cast("long").alias("id"), name.alias("name")).alias("team"), F.when(F.col("match_id") % 4 != 0, F.lit("4-3-3")).alias("formation"), "startXI", "substitutes")
    kept = side.filter("NOT (side = 'away' AND match_id % 25 = 0)")
    text = kept.groupBy("match_id", "league", "season").agg(F.to_json(F.collect_list(packed)).alias("payload"))
    return text.select("match_id", "league", "season", F.from_json("payload", q.LINEUP_PAYLOAD).alias("lineups"))


@query(
    "q9_payload_reasons",
    """SELECT match_id, concat_ws(',', CASE WHEN match_id % 25 = 0 THEN 'not_two_lineups' END, CASE WHEN match_id % 14 = 0 AND match_id % 25 <> 0 THEN 'team_name_missing' END, CASE WHEN match_id % 17 = 0 THEN 'starters_not_eleven' END, CASE WHEN match_id % 9 = 0 THEN 'player_incomplete' END) AS reasons FROM v_match""",
)
def q9(spark, sf):
    return q.payload_reasons(payloads(spark, sf)).select("match_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "ga25_fixture_coverage",
    """f AS (SELECT match_id, league, season, count(DISTINCT side) AS sides, count(*) AS people, count(CASE WHEN NOT (slot = 12 AND match_id % 9 = 0) THEN 1 END) AS ids, count(position) AS pos FROM v_lineup WHERE NOT (side = 'away' AND match_id % 25 = 0) GROUP BY ALL)
 SELECT league, season, count(*) AS fixtures, r6(avg(CASE WHEN sides = 2 THEN 1.0e0 ELSE 0.0e0 END)) AS two_lineups_rate, r6(avg(CASE WHEN sides = 2 AND match_id % 17 <> 0 THEN 1.0e0 ELSE 0.0e0 END)) AS complete_starting_xi_rate, r6(avg(CASE WHEN sides = 2 THEN 1.0e0 ELSE 0.0e0 END)) AS bench_rate,
 r6(avg(ids * 1.0e0 / people)) AS player_id_rate, r6(avg(pos * 1.0e0 / people)) AS position_rate, r6(avg(CASE WHEN sides = 2 AND match_id % 4 <> 0 THEN 1.0e0 ELSE 0.0e0 END)) AS formation_rate FROM f GROUP BY ALL""",
)
def ga25(spark, sf):
    out = q.fixture_coverage(q.payload_facts(payloads(spark, sf)))
    return r6s(out, ["two_lineups_rate", "complete_starting_xi_rate", "bench_rate", "player_id_rate", "position_rate", "formation_rate"])


@query(
    "ga26_feed_audit",
    """m AS (SELECT match_id, max(season) AS season, count(CASE WHEN side = 'home' AND slot < 11 THEN 1 END) AS hs, count(CASE WHEN side = 'away' AND slot < 11 THEN 1 END) AS aws FROM v_lineup GROUP BY match_id),
 p AS (SELECT season, avg(CASE WHEN position IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS rr, count(minute_in) AS subs FROM v_lineup GROUP BY season)
 SELECT m.season, count(*) AS sampled_matches, r6(avg(CASE WHEN hs = 11 AND aws = 11 THEN 1.0e0 ELSE 0.0e0 END)) AS complete_starting_xi_rate, r6(max(rr)) AS role_rate, max(subs) AS substitutions FROM m JOIN p USING (season) GROUP BY m.season""",
)
def ga26(spark, sf):
    rows = lineups(spark, sf)
    size = lambda side, low, high: F.count_if((F.col("side") == side) & F.col("slot").between(low, high))
    games = rows.groupBy("match_id").agg(
        F.max("season").alias("season"), size("home", 0, 10).alias("home_starters"), size("away", 0, 10).alias("away_starters"), size("home", 11, 15).alias("home_bench"), size("away", 11, 15).alias("away_bench"),
        F.lit(True).alias("formation_available"))
    people = rows.select("season", "player_id", F.col("position").alias("role"), F.col("minute_in").isNotNull().alias("entered"))
    return r6s(q.feed_audit(games, people), ["complete_starting_xi_rate", "role_rate"]).select("season", "sampled_matches", "complete_starting_xi_rate", "role_rate", "substitutions")


@query(
    "ga27_even_sample",
    """o AS (SELECT match_id, league, season, row_number() OVER (PARTITION BY league, season ORDER BY match_date, match_id) - 1 AS p, count(*) OVER (PARTITION BY league, season) AS n FROM v_match)
 SELECT league, season, match_id FROM o WHERE n <= 7 OR p IN (SELECT CAST(round_even(i * (o.n - 1) / 6.0e0, 0) AS BIGINT) FROM (SELECT unnest(range(7)) AS i))""",
)
def ga27(spark, sf):
    return q.evenly_spaced(matches(spark, sf), ["league", "season"], "date", ["match_id"], 7).select("league", "season", "match_id")


@query(
    "ga28_modal_roles",
    """c AS (SELECT player_id, position_normalized AS role, count(*) AS n FROM v_obs WHERE position_normalized IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, role) AS rn FROM c) SELECT player_id, role, n FROM r WHERE rn = 1""",
)
def ga28(spark, sf):
    rows = view(spark, sf, "v_obs").withColumn("role", F.col("position_normalized"))
    return q.modal_roles(rows, "player_id", "role")


@query(
    "ga29_ambiguous_identities",
    """b AS (SELECT l_partkey AS name, l_suppkey // 20 AS team, l_orderkey FROM lineitem), a AS (SELECT name, count(DISTINCT team) AS teams FROM b GROUP BY name HAVING count(DISTINCT team) > 1) SELECT a.name, a.teams, count(*) AS rows FROM a JOIN b USING (name) GROUP BY ALL""",
)
def ga29(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.floor(F.col("l_suppkey") / 20).alias("team"), "l_orderkey")
    names, carried = q.ambiguous_identities(rows, "name", "team")
    return carried.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).join(names, "name")


@query(
    "ga20_not_null_census",
    """SELECT 'total' AS level, NULL AS source, NULL AS league, NULL AS season, count(*) AS rows, count(minutes_played) AS minutes_played, count(minute_in) AS minute_in, count(position_original) AS position_original FROM v_obs
 UNION ALL SELECT 'group', source, league, season, count(*), count(minutes_played), count(minute_in), count(position_original) FROM v_obs GROUP BY source, league, season""",
)
def ga20(spark, sf):
    return q.not_null_census(view(spark, sf, "v_obs"), ["minutes_played", "minute_in", "position_original"], ["source", "league", "season"])


@query(
    "ga21_raw_census",
    STORED + """ SELECT provider, count(*) AS rows, count(CASE WHEN lineup_role = 'starter' THEN 1 END) AS starters, count(CASE WHEN lineup_role <> 'starter' THEN 1 END) AS bench, count(position) AS with_position, count(CASE WHEN slot % 2 = 0 THEN 1 END) AS with_shirt_number,
 count(CASE WHEN match_id % 3 <> 0 THEN 1 END) AS with_timing, count(DISTINCT concat(match_id, '|', player_id)) AS player_matches FROM hd GROUP BY provider""",
)
def ga21(spark, sf):
    return q.raw_census(stored_lineups(spark, sf))


@query("ga30_mapping_coverage", "SELECT league, season, count(*) AS matches, count(CASE WHEN match_id % 3 = 0 THEN 1 END) AS mapped FROM v_match GROUP BY ALL")
def ga30(spark, sf):
    games = matches(spark, sf)
    return q.mapping_coverage(games, games.filter("match_id % 3 = 0"))


BACKLOG = "s AS (SELECT match_id, count(DISTINCT team) AS n FROM v_lineup WHERE match_id % 4 <> 0 AND NOT (match_id % 5 = 0 AND side = 'away') GROUP BY 1), b AS (SELECT m.match_id, m.match_date, coalesce(n, 0) AS stored FROM v_match m LEFT JOIN s USING (match_id) WHERE m.match_id % 3 = 0 AND coalesce(n, 0) <> 2)"


def backlog(spark, sf, limit=None):
    games = matches(spark, sf)
    held = lineups(spark, sf).filter("match_id % 4 <> 0 AND NOT (match_id % 5 = 0 AND side = 'away')").select("match_id", F.col("team").alias("team_id"))
    return q.lineup_backlog(games, games.filter("match_id % 3 = 0"), held, limit)


@query("ga31_lineup_backlog", BACKLOG + " SELECT match_id, stored FROM b")
def ga31(spark, sf):
    return backlog(spark, sf).select("match_id", "stored")


@query("t2_limited_worklist", BACKLOG + " SELECT match_id, stored FROM b ORDER BY match_date, match_id LIMIT 25")
def t2(spark, sf):
    return backlog(spark, sf, 25).select("match_id", "stored")


@query(
    "ga35_season_quality",
    """a AS (SELECT q.*, m.season, CASE WHEN m.match_id % 8 <> 0 THEN m.result END AS res, CASE WHEN seq <> 2 THEN odds_h END AS oh FROM v_quote q JOIN v_match m USING (match_id))
 SELECT season, count(*) AS matches, count(res) AS results, r6(avg(CASE WHEN oh IS NULL THEN 1.0e0 ELSE 0.0e0 END)) AS missing_odds_h, r6(avg(1.0e0/oh + 1.0e0/odds_d + 1.0e0/odds_a - 1.0e0)) AS mean_margin FROM a GROUP BY season""",
)
def ga35(spark, sf):
    games = matches(spark, sf).select("match_id", "season", F.when(F.col("match_id") % 8 != 0, F.col("result")).alias("result"))
    rows = view(spark, sf, "v_quote").withColumn("odds_h", F.when(F.col("seq") != 2, F.col("odds_h"))).join(games, "match_id")
    rows = rows.withColumn("margin", 1.0 / F.col("odds_h") + 1.0 / F.col("odds_d") + 1.0 / F.col("odds_a") - 1.0)
    return r6s(q.season_quality(rows, ["odds_h"]), ["missing_odds_h", "mean_margin"])


@query("q11_pool_checks", "SELECT count(*) AS matches FROM v_match")
def q11(spark, sf):
    rows = lineups(spark, sf).withColumn("department", pl.department("position")).withColumn("v", F.coalesce("minutes_played", F.lit(0.0)))
    pools = pl.pool_players(rows, ["v"])
    return sc.check_pools(pools, ["difference_starter_all_v_mean"]).agg(F.count(F.lit(1)).alias("matches"))


@query("t4_top_five_per_group", "r AS (SELECT match_id, bookmaker, odds, selection, seq, row_number() OVER (PARTITION BY bookmaker ORDER BY odds DESC, match_id, seq, selection) AS rn FROM v_odds) SELECT bookmaker, match_id, r6(odds) AS odds, selection, seq FROM r WHERE rn <= 5")
def t4(spark, sf):
    order = Window.partitionBy("bookmaker").orderBy(F.col("odds").desc(), "match_id", "seq", "selection")
    return view(spark, sf, "v_odds").withColumn("_rn", F.row_number().over(order)).filter("_rn <= 5").select("bookmaker", "match_id", round6("odds").alias("odds"), "selection", "seq")


@query("t6_union_with_drift", "SELECT kind, count(*) AS n, count(home_goals) AS with_goals, count(selection) AS with_selection FROM (SELECT 'match' AS kind, home_goals, NULL AS selection FROM v_match UNION ALL SELECT 'odds', NULL, selection FROM v_odds) t GROUP BY kind")
def t6(spark, sf):
    left = matches(spark, sf).select(F.lit("match").alias("kind"), "home_goals")
    right = view(spark, sf, "v_odds").select(F.lit("odds").alias("kind"), "selection")
    return left.unionByName(right, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("home_goals").alias("with_goals"), F.count("selection").alias("with_selection"))


@query("t8_distinct_teams", "SELECT DISTINCT league, team FROM (SELECT league, home_team AS team FROM v_match UNION ALL SELECT league, away_team FROM v_match) t")
def t8(spark, sf):
    return matches(spark, sf).select("league", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()

