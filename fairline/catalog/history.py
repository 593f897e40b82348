"""Registered team-history queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..operators import history as h
from ..operators import market as m
from ..plans.views import view
from .market import PRICED_SQL, PRICES, priced
from .registry import query


def matches(spark, sf):
    return view(spark, sf, "v_match").withColumnRenamed("match_date", "date")


def form_only(spark, sf):
    return h.team_form(h.team_rows(matches(spark, sf)))


TEAM_SQL = """
tm AS (SELECT match_id, match_date, league, home_team AS team, 'home' AS side, home_goals AS gf, away_goals AS ga, home_shots AS sf, home_shots_on_target AS tf,
  away_shots_on_target AS ta, home_corners AS cf, home_yellow_cards AS yc FROM v_match
 UNION ALL SELECT match_id, match_date, league, away_team, 'away', away_goals, home_goals, away_shots, away_shots_on_target, home_shots_on_target, away_corners, away_yellow_cards FROM v_match),
nm AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts, CASE WHEN sf > 0 THEN gf * 1.0e0 / sf END AS conv,
 CASE WHEN sf > 0 THEN tf * 1.0e0 / sf END AS acc, row_number() OVER (PARTITION BY league, team ORDER BY match_date, match_id) AS r,
 row_number() OVER (PARTITION BY league, team, side ORDER BY match_date, match_id) AS rs FROM tm),
pr AS (SELECT league, team, match_date, max(prior) AS prior, max(prior_home) AS ph, max(prior_away) AS pa, max(last_day) AS last_day FROM (
 SELECT league, team, match_date, count(*) OVER w AS prior, count(CASE WHEN side = 'home' THEN 1 END) OVER w AS prior_home,
  count(CASE WHEN side = 'away' THEN 1 END) OVER w AS prior_away, max(match_date) OVER w AS last_day FROM tm
 WINDOW w AS (PARTITION BY league, team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)) GROUP BY ALL)
"""
HISTORY_JOIN = "FROM pr p LEFT JOIN nm x ON x.league = p.league AND x.team = p.team AND x.r BETWEEN p.prior - 9 AND p.prior GROUP BY p.league, p.team, p.match_date"
KEYS = "p.league, p.team, CAST(p.match_date AS VARCHAR) AS date"


def day_text():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


@query(
    "w5_rolling_form",
    TEAM_SQL + f"""SELECT {KEYS}, r6(avg(CASE WHEN x.r > p.prior - 5 THEN x.pts END)) AS points_5, r6(avg(x.pts)) AS points_10,
 r6(avg(CASE WHEN x.r > p.prior - 5 THEN x.gf END)) AS goals_for_5, r6(avg(x.ga)) AS goals_against_10, r6(avg(CASE WHEN x.r > p.prior - 5 THEN x.sf END)) AS shots_for_5,
 r6(avg(x.sf)) AS shots_for_10, r6(avg(x.ta)) AS shots_on_target_against_10, r6(avg(x.cf)) AS corners_for_10, r6(avg(CASE WHEN x.r > p.prior - 5 THEN x.yc END)) AS yellow_cards_5,
 r6(avg(CASE WHEN x.r > p.prior - 5 THEN x.conv END)) AS shot_conversion_5, r6(avg(x.acc)) AS shot_accuracy_10 {HISTORY_JOIN}""",
)
def w5(spark, sf):
    names = ["points_5", "points_10", "goals_for_5", "goals_against_10", "shots_for_5", "shots_for_10", "shots_on_target_against_10",
             "corners_for_10", "yellow_cards_5", "shot_conversion_5", "shot_accuracy_10"]
    return form_only(spark, sf).select("league", "team", day_text(), *[round6(n).alias(n) for n in names])


EWM = "sum(power(0.65e0, p.prior - x.r) * {0}) / sum(CASE WHEN {0} IS NOT NULL THEN power(0.65e0, p.prior - x.r) END)"


@query(
    "w6_weighted_form",
    TEAM_SQL + f"SELECT {KEYS}, r6({EWM.format('x.pts')}) AS points_ewm, r6({EWM.format('(x.gf - x.ga)')}) AS goal_difference_ewm, "
    f"r6({EWM.format('(x.tf - x.ta)')}) AS shots_on_target_difference_ewm {HISTORY_JOIN}",
)
def w6(spark, sf):
    names = ["points_ewm", "goal_difference_ewm", "shots_on_target_difference_ewm"]
    return form_only(spark, sf).select("league", "team", day_text(), *[round6(n).alias(n) for n in names])


@query(
    "w7_rest_days",
    TEAM_SQL + f"SELECT {KEYS}, prior AS matches_played, CAST(date_diff('day', last_day, match_date) AS DOUBLE) AS rest_days FROM pr p",
)
def w7(spark, sf):
    return form_only(spark, sf).select("league", "team", day_text(), "matches_played", "rest_days")


def venue_sql(side: str, prior: str) -> str:
    return f"""v{side} AS (SELECT p.league, p.team, p.match_date, avg(CASE WHEN x.rs > p.{prior} - 5 THEN x.pts END) AS p5, avg(x.pts) AS p10,
 avg(CASE WHEN x.rs > p.{prior} - 5 THEN x.gf - x.ga END) AS g5, avg(x.gf - x.ga) AS g10 FROM pr p LEFT JOIN nm x ON x.league = p.league AND x.team = p.team
 AND x.side = '{side}' AND x.rs BETWEEN p.{prior} - 9 AND p.{prior} GROUP BY ALL)"""


@query(
    "w8_venue_form",
    TEAM_SQL + f", {venue_sql('home', 'ph')}, {venue_sql('away', 'pa')} " + f"""SELECT {KEYS}, r6(h.p5) AS home_venue_points_5, r6(h.p10) AS home_venue_points_10,
 r6(h.g5) AS home_venue_goal_difference_5, r6(h.g10) AS home_venue_goal_difference_10, r6(a.p5) AS away_venue_points_5, r6(a.g10) AS away_venue_goal_difference_10
 FROM pr p JOIN vhome h USING (league, team, match_date) JOIN vaway a USING (league, team, match_date)""",
)
def w8(spark, sf):
    names = ["home_venue_points_5", "home_venue_points_10", "home_venue_goal_difference_5", "home_venue_goal_difference_10",
             "away_venue_points_5", "away_venue_goal_difference_10"]
    return form_only(spark, sf).select("league", "team", day_text(), *[round6(n).alias(n) for n in names])


# The rating recursion, one league row per step; state is a list of twenty ratings.
ELO_SQL = """
eo AS (SELECT *, CAST(substr(home_team, 2) AS INT) + 1 AS hi, CAST(substr(away_team, 2) AS INT) + 1 AS ai,
 row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS i FROM v_match),
"""
ELO_RECURSION = """
er AS (
 SELECT league, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DATE) AS d, CAST(NULL AS VARCHAR) AS season,
  CAST(NULL AS DOUBLE) AS he, CAST(NULL AS DOUBLE) AS ae, [1500.0e0 FOR x IN range(20)] AS cur, [1500.0e0 FOR x IN range(20)] AS snap FROM (SELECT DISTINCT league FROM eo)
 UNION ALL
 SELECT league, i, match_id, match_date, season, snap[hi], snap[ai],
  [CASE WHEN k = hi THEN x + chg WHEN k = ai THEN x - chg ELSE x END FOR x, k IN cur], snap FROM (
  SELECT *, 20.0e0 * (1.0e0 + ln(1.0e0 + abs(home_goals - away_goals))) * ((CASE WHEN home_goals > away_goals THEN 1.0e0 WHEN home_goals = away_goals THEN 0.5e0 ELSE 0.0e0 END)
   - 1.0e0/(1.0e0 + power(10.0e0, -(cur[hi] + 65.0e0 - cur[ai])/400.0e0))) AS chg FROM (
   SELECT n.league, n.i, n.match_id, n.match_date, n.season, n.hi, n.ai, n.home_goals, n.away_goals,
    CASE WHEN s.season IS NOT NULL AND s.season <> n.season THEN [0.75e0 * x + 0.25e0 * 1500.0e0 FOR x IN s.cur] ELSE s.cur END AS cur,
    CASE WHEN s.d = n.match_date THEN s.snap WHEN s.season IS NOT NULL AND s.season <> n.season THEN [0.75e0 * x + 0.25e0 * 1500.0e0 FOR x IN s.cur] ELSE s.cur END AS snap
   FROM er s JOIN eo n ON n.league = s.league AND n.i = s.i + 1)))
"""


@query(
    "w10_elo",
    ELO_SQL + ELO_RECURSION + """SELECT match_id, r4(he) AS home_elo, r4(ae) AS away_elo, r4(he + 65 - ae) AS elo_difference,
 r6(1/(1 + power(10.0e0, -(he + 65 - ae)/400.0e0))) AS elo_expected_home FROM er WHERE i > 0""",
)
def w10(spark, sf):
    return h.elo_ratings(matches(spark, sf)).select(
        "match_id", F.round("home_elo", 4).alias("home_elo"), F.round("away_elo", 4).alias("away_elo"),
        F.round("elo_difference", 4).alias("elo_difference"), round6("elo_expected_home").alias("elo_expected_home"),
    )


@query(
    "w11_match_features",
    ELO_SQL + ELO_RECURSION + """, rated AS (SELECT match_id AS mid, he, ae FROM er WHERE i > 0),""" + TEAM_SQL + """,
 op AS (SELECT t.*, CASE WHEN t.side = 'home' THEN e.ae ELSE e.he END AS oe FROM nm t JOIN rated e ON e.mid = t.match_id),
 ft AS (SELECT p.league, p.team, p.match_date, p.prior, p.last_day, avg(CASE WHEN x.r > p.prior - 5 THEN x.oe END) AS oe5, avg(x.oe) AS oe10, avg(x.pts) AS p10
  FROM pr p LEFT JOIN op x ON x.league = p.league AND x.team = p.team AND x.r BETWEEN p.prior - 9 AND p.prior GROUP BY ALL)
 SELECT m.match_id, m.season, m.result, r4(e.he) AS home_elo, r4(h.oe5) AS home_opponent_elo_5, r4(a.oe10) AS away_opponent_elo_10, r6(h.p10) AS home_points_10,
  a.prior AS away_matches_played, CAST(date_diff('day', h.last_day, m.match_date) AS DOUBLE) AS home_rest_days
 FROM v_match m JOIN rated e ON e.mid = m.match_id JOIN ft h ON h.league = m.league AND h.team = m.home_team AND h.match_date = m.match_date
 JOIN ft a ON a.league = m.league AND a.team = m.away_team AND a.match_date = m.match_date""",
)
def w11(spark, sf):
    out = h.build_prematch_features(matches(spark, sf))
    return out.select(
        "match_id", "season", "result", F.round("home_elo", 4).alias("home_elo"), F.round("home_opponent_elo_5", 4).alias("home_opponent_elo_5"),
        F.round("away_opponent_elo_10", 4).alias("away_opponent_elo_10"), round6("home_points_10").alias("home_points_10"), "away_matches_played", "home_rest_days",
    )


@query(
    "w12_fixture_features",
    """played AS (SELECT * FROM v_match WHERE season < '2001'), fx AS (SELECT * FROM v_match WHERE season >= '2001'),
 tm AS (SELECT match_id, match_date, league, home_team AS team, home_goals AS gf, away_goals AS ga FROM played UNION ALL SELECT match_id, match_date, league, away_team, away_goals, home_goals FROM played),
 nm AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts, row_number() OVER (PARTITION BY league, team ORDER BY match_date DESC, match_id DESC) AS r FROM tm),
 ft AS (SELECT league, team, count(*) AS n, max(match_date) AS last_day, avg(CASE WHEN r <= 5 THEN pts END) AS p5 FROM nm GROUP BY league, team)
 SELECT f.match_id, h.n AS home_matches_played, r6(h.p5) AS home_points_5, r6(a.p5) AS away_points_5, CAST(date_diff('day', a.last_day, f.match_date) AS DOUBLE) AS away_rest_days
 FROM fx f LEFT JOIN ft h ON h.league = f.league AND h.team = f.home_team LEFT JOIN ft a ON a.league = f.league AND a.team = f.away_team""",
)
def w12(spark, sf):
    games = matches(spark, sf)
    fixtures = games.filter("season >= '2001'").select("match_id", "date", "season", "league", "home_team", "away_team")
    out = h.build_fixture_features(games.filter("season < '2001'"), fixtures)
    return out.select(
        "match_id", "home_matches_played", round6("home_points_5").alias("home_points_5"), round6("away_points_5").alias("away_points_5"), "away_rest_days"
    )


def season_file(spark, sf):
    """Raw season rows with text dates, padded names and a few broken lines."""
    key = F.col("match_id")
    return view(spark, sf, "v_match").select(
        F.when(key % 41 == 0, F.lit("unknown")).otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("Date"),
        F.col("season").alias("Season"), F.col("league").alias("League"),
        F.concat(F.lit("  Club  "), F.col("home_team"), F.lit(" ")).alias("HomeTeam"), F.concat(F.lit("Club "), F.col("away_team")).alias("AwayTeam"),
        F.when(key % 43 == 0, F.lit("x")).otherwise(F.col("home_goals").cast("string")).alias("FTHG"), F.col("away_goals").alias("FTAG"),
        F.col("result").alias("FTR"), F.col("home_shots").alias("HS"), F.lit(2.0).alias("AvgCH"), F.lit(3.4).alias("AvgCD"), (F.lit(4.0) + key % 3).alias("AvgCA"),
    )


@query(
    "b3_prepare_modeling_matches",
    """src AS (SELECT *, concat(league, '|', season, '|', CAST(match_date AS VARCHAR), '|', CASE WHEN home_team = 'T1' THEN 'Uno' ELSE concat('Club ', home_team) END, '|',
  CASE WHEN away_team = 'T1' THEN 'Uno' ELSE concat('Club ', away_team) END) AS id FROM v_match WHERE match_id % 41 <> 0 AND match_id % 43 <> 0),
 one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY home_goals, away_goals, result) AS rn FROM src)
 SELECT id AS match_id, home_goals, away_goals, result FROM one WHERE rn = 1""",
)
def b3(spark, sf):
    return h.prepare_modeling_matches(season_file(spark, sf), {"Club T1": "Uno"}).select("match_id", "home_goals", "away_goals", "result")


@query(
    "b4_future_fixtures",
    """SELECT DISTINCT concat('fixture|', league, '|', season, '|', CAST(match_date AS VARCHAR), 'T00:00:00|', home_team, '|', away_team) AS match_id, home_team, away_team FROM v_match""",
)
def b4(spark, sf):
    raw = matches(spark, sf).select("date", "season", "league", F.concat(F.lit(" "), "home_team").alias("home_team"), "away_team").distinct()
    return h.prepare_future_fixtures(raw).select("match_id", "home_team", "away_team")


@query("b5_select_matches", "SELECT league, season, count(*) AS n, sum(home_goals) AS goals FROM v_match WHERE league IN ('1', '2') AND season IN ('1996', '1997', '1998') GROUP BY ALL")
def b5(spark, sf):
    out = h.select_matches(matches(spark, sf), ["1", "2"], ["1996", "1997", "1998"])
    return out.groupBy("league", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query(
    "b21_performance_ratios",
    """SELECT match_id, r6(CASE WHEN home_shots > 0 THEN home_goals * 1.0e0 / home_shots END) AS home_conversion, r6(CASE WHEN away_shots > 0 THEN away_shots_on_target * 1.0e0 / away_shots END) AS away_accuracy FROM v_match""",
)
def b21(spark, sf):
    rows = h.team_rows(matches(spark, sf))
    return rows.groupBy("match_id").agg(
        round6(F.max(F.when(F.col("side") == "home", F.col("shot_conversion")))).alias("home_conversion"),
        round6(F.max(F.when(F.col("side") == "away", F.col("shot_accuracy")))).alias("away_accuracy"),
    )


@query(
    "j2_closing_means",
    PRICED_SQL + """, mean AS (SELECT match_id, avg(CASE WHEN selection = 'H' THEN p END) AS ph, avg(CASE WHEN selection = 'D' THEN p END) AS pd,
 avg(CASE WHEN selection = 'A' THEN p END) AS pa, avg(margin) AS mg FROM long WHERE timing = 'closing' GROUP BY match_id)
 SELECT m.match_id, r6(ph) AS market_home_probability, r6(pd) AS market_draw_probability, r6(pa) AS market_away_probability, r6(mg) AS market_margin
 FROM v_match m LEFT JOIN mean USING (match_id)""",
)
def j2(spark, sf):
    rows, _ = m.normalize_snapshots(priced(spark, sf), PRICES, ["match_id", "market", "opening_or_closing"])
    names = ["market_home_probability", "market_draw_probability", "market_away_probability", "market_margin"]
    return h.canonical_matches(matches(spark, sf), rows).select("match_id", *[round6(n).alias(n) for n in names])


@query(
    "t1_chronological_order",
    "SELECT match_id, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS position FROM v_match",
)
def t1(spark, sf):
    prior = h.prior_totals(matches(spark, sf), matches(spark, sf), ["league"], "date", [h.running_count("before")])
    within = Window.partitionBy("league", "date").orderBy("match_id")
    ranked = matches(spark, sf).withColumn("_rn", F.row_number().over(within)).join(prior, ["league", "date"])
    return ranked.select("match_id", (F.col("before") + F.col("_rn")).alias("position"))

