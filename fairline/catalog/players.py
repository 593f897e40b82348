"""Registered player queries (B16, B19, B20, W1, W13-W17, J24, J26, G-A33, G-A34, M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..functions.temporal import keep_latest
from ..operators import players as p
from ..plans.views import view
from ..session import stage
from .history import matches
from .registry import query


def lineups(spark, sf):
    return view(spark, sf, "v_lineup").withColumnRenamed("match_date", "date")


def observations(spark, sf):
    obs = view(spark, sf, "v_obs")
    order = [F.col(c) for c in ("line", "l_extendedprice", "l_partkey", "team_id")]
    # one row per (match, player), written once: the matrix starts several walks from it
    return stage(keep_latest(obs, ["match_id", "player_id"], order, first=True), "observations")


def squad_observations(spark, sf):
    """Squads as observations of a second provider; a quarter of the matches is unknown to it."""
    squad = view(spark, sf, "v_squad").filter("match_id % 4 <> 0")
    return squad.select(
        "match_id", F.col("match_date").alias("kickoff"), "league", F.col("team").alias("team_id"), "player_id", "lineup_role",
        "minutes_played", "minute_in", "minute_out", F.col("position").alias("position_original"),
        F.substring(p.department("position"), 1, 1).alias("position_normalized"), F.lit("S").alias("source"), F.lit(False).alias("has_statistics"),
    )


def slots(spark, sf):
    return p.slot_rows(matches(spark, sf), lineups(spark, sf))


def sided(df, names, how=F.sum):
    """Compact check: per match and side, the rounded sums of many columns."""
    return df.groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("n"), *[F.round(how(n), 4).alias(n) for n in names])


DEPT = """CASE WHEN position = 'Goalkeeper' THEN 'goalkeeper' WHEN position = 'Centre-Back' THEN 'defense' WHEN position = 'Central Midfield' THEN 'midfield'
 WHEN position = 'Left Winger' THEN 'attack' ELSE 'unknown' END"""


@query(
    "b16_departments",
    f"SELECT season, CASE position WHEN 'Goalkeeper' THEN 'goalkeeper' WHEN 'Centre-Back' THEN 'centre_back' WHEN 'Central Midfield' THEN 'central_midfield' WHEN 'Left Winger' THEN 'winger' ELSE 'other' END AS bucket, {DEPT} AS department, count(*) AS n FROM v_lineup GROUP BY ALL",
)
def b16(spark, sf):
    rows = lineups(spark, sf)
    return rows.groupBy("season", p.position_bucket("position").alias("bucket"), p.department("position").alias("department")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b19_position_quality",
    "SELECT line, r6(avg(CASE WHEN line % 4 = 0 THEN 1.0e0 WHEN line % 4 = 1 THEN 0.6e0 WHEN line % 4 = 2 THEN 0.8e0 WHEN position_normalized IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END)) AS quality FROM v_obs GROUP BY line",
)
def b19(spark, sf):
    kind = F.col("line") % 4
    grid = F.when(kind == 0, F.lit("Reported:Left Winger")).when(kind == 1, F.lit("reconstructed:x")).when(kind == 2, F.lit("4:2"))
    rows = view(spark, sf, "v_obs").withColumn("q", p.position_quality(grid, F.col("position_normalized")))
    return rows.groupBy("line").agg(round6(F.avg("q")).alias("quality"))


OBS = """
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY line, l_extendedprice, l_partkey, team_id) AS rn FROM v_obs) WHERE rn = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY kickoff, match_id) AS r, count(*) OVER w AS n,
 count(CASE WHEN lineup_role = 'starter' THEN 1 END) OVER w AS starts, count(CASE WHEN lineup_role = 'bench' THEN 1 END) OVER w AS benches,
 count(minute_in) OVER w AS entries, avg(minutes_played) OVER w AS mean_min, count(minutes_played) OVER w AS min_n, avg(minute_in) OVER w AS mean_in, avg(minute_out) OVER w AS mean_out,
 count(CASE WHEN has_statistics THEN 1 END) OVER w AS stat_n, count(position_normalized) OVER w AS labelled,
 count(*) OVER (PARTITION BY player_id, team_id ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS team_n,
 count(*) OVER (PARTITION BY player_id, league ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS league_n
 FROM d WINDOW w AS (PARTITION BY player_id ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
known AS (SELECT player_id, minutes_played, row_number() OVER (PARTITION BY player_id ORDER BY kickoff, match_id) AS kr FROM d WHERE minutes_played IS NOT NULL),
rec AS (SELECT q.match_id, q.player_id, avg(k.minutes_played) AS recent FROM num q JOIN known k ON k.player_id = q.player_id AND k.kr BETWEEN q.min_n - 4 AND q.min_n GROUP BY ALL),
modal AS (SELECT match_id, player_id, max(c) AS modal FROM (SELECT q.match_id, q.player_id, h.position_normalized, count(*) AS c FROM num q JOIN d h ON h.player_id = q.player_id AND h.kickoff < q.kickoff
 AND h.position_normalized IS NOT NULL GROUP BY ALL) GROUP BY ALL),
tm AS (SELECT q.*, l.kickoff AS last_kickoff, l.team_id AS last_team, l.position_original AS last_original, l.position_normalized AS last_normalized, l.source AS last_source, rec.recent, modal.modal
 FROM num q LEFT JOIN num l ON l.player_id = q.player_id AND l.r = q.n LEFT JOIN rec ON rec.match_id = q.match_id AND rec.player_id = q.player_id
 LEFT JOIN modal ON modal.match_id = q.match_id AND modal.player_id = q.player_id)
"""


@query(
    "w14_temporal_matrix",
    OBS + """SELECT match_id, player_id, team_id, n AS observations, starts, benches, CAST(n > 0 AS INT) AS available, r6(starts * 1.0e0 / nullif(n, 0)) AS start_rate, r6(entries * 1.0e0 / nullif(n, 0)) AS sub_entry_rate,
 r6(CASE WHEN min_n > 0 THEN mean_min WHEN starts > 0 THEN 90.0e0 END) AS mean_minutes, r6(CASE WHEN min_n > 0 THEN recent WHEN starts > 0 THEN 90.0e0 END) AS recent_minutes,
 CAST(min_n > 0 OR starts > 0 AS INT) AS minutes_available, CASE WHEN min_n > 0 THEN 'reported' ELSE 'proxy' END AS minutes_quality, CASE WHEN min_n > 0 THEN 'none' ELSE 'starter_90' END AS minutes_fallback,
 r6(mean_in) AS mean_minute_in, r6(mean_out) AS mean_minute_out, CAST(date_diff('day', last_kickoff, kickoff) AS DOUBLE) AS days_since, team_n AS team_experience, league_n AS league_experience,
 CAST(coalesce(last_team <> team_id, false) AS INT) AS team_change, last_original AS position_original, last_normalized AS position_normalized, coalesce(last_source, 'none') AS position_source,
 r6(modal * 1.0e0 / nullif(labelled, 0)) AS role_stability, stat_n AS statistics FROM tm""",
)
def w14(spark, sf):
    out = p.temporal_player_matrix(observations(spark, sf))
    v = lambda n: F.col(f"{n}_value")
    return out.select(
        "match_id", "player_id", "team_id", v("observations").alias("observations"), v("starts").alias("starts"), v("benches").alias("benches"),
        F.col("observations_available").cast("int").alias("available"), round6(v("start_rate")).alias("start_rate"), round6(v("sub_entry_rate")).alias("sub_entry_rate"),
        round6(v("mean_minutes")).alias("mean_minutes"), round6(v("recent_minutes")).alias("recent_minutes"),
        F.col("mean_minutes_available").cast("int").alias("minutes_available"), F.col("mean_minutes_quality").alias("minutes_quality"),
        F.col("recent_minutes_fallback_kind").alias("minutes_fallback"), round6(v("mean_minute_in")).alias("mean_minute_in"),
        round6(v("mean_minute_out")).alias("mean_minute_out"), v("days_since_appearance").alias("days_since"), v("team_experience").alias("team_experience"),
        v("league_experience").alias("league_experience"), v("team_change").cast("int").alias("team_change"), v("position_original").alias("position_original"),
        v("position_normalized").alias("position_normalized"), F.col("position_original_source").alias("position_source"),
        round6(v("role_stability")).alias("role_stability"), v("player_statistics_observations").alias("statistics"),
    )


@query(
    "b20_encode_temporal",
    OBS + """SELECT match_id, player_id, r6(ln(1 + n)) AS fs_observations_value, r6(CASE WHEN min_n > 0 THEN mean_min WHEN starts > 0 THEN 90.0e0 ELSE 0.0e0 END / 90.0e0) AS fs_mean_minutes_value,
 CASE WHEN min_n > 0 THEN 1.0e0 ELSE 0.5e0 END AS fs_mean_minutes_quality, CASE WHEN min_n > 0 THEN 0.0e0 ELSE 1.0e0 END AS fs_mean_minutes_fallback,
 r6(ln(1 + least(coalesce(date_diff('day', last_kickoff, kickoff), 0), 365))) AS fs_days_since_appearance_value, 0.7e0 AS fs_team_experience_quality,
 CASE WHEN last_original = 'Left Winger' THEN 1.0e0 ELSE 0.0e0 END AS fs_position_winger, CASE WHEN last_original IN ('Right-Back') THEN 1.0e0 ELSE 0.0e0 END AS fs_position_full_back,
 CASE WHEN n > 0 THEN 1.0e0 ELSE 0.0e0 END AS fs_position_available FROM tm""",
)
def b20(spark, sf):
    out = p.encode_temporal(p.temporal_player_matrix(observations(spark, sf)))
    exact = ["fs_mean_minutes_quality", "fs_mean_minutes_fallback", "fs_team_experience_quality", "fs_position_winger", "fs_position_full_back", "fs_position_available"]
    near = ["fs_observations_value", "fs_mean_minutes_value", "fs_days_since_appearance_value"]
    return out.select("match_id", "player_id", *exact, *[round6(n).alias(n) for n in near])


LINEUP13 = """
lu AS (SELECT match_id, team, player_id, max(CASE WHEN lineup_role = 'starter' THEN 1 ELSE 0 END) AS st, max(CASE WHEN lineup_role = 'starter' THEN 0 ELSE 1 END) AS bn FROM v_lineup GROUP BY ALL),
valid AS (SELECT match_id, team FROM lu GROUP BY ALL HAVING sum(st) = 11),
sides2 AS (SELECT match_id, match_date, home_team AS team, home_goals AS gf, away_goals AS ga FROM v_match UNION ALL SELECT match_id, match_date, away_team, away_goals, home_goals FROM v_match),
tg AS (SELECT b.*, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS r FROM sides2 b JOIN valid USING (match_id, team)),
dayn AS (SELECT team, match_date, count(*) AS c FROM tg GROUP BY ALL),
pr AS (SELECT q.team, q.match_date, coalesce(sum(d.c), 0) AS prior FROM (SELECT DISTINCT team, match_date FROM sides2) q LEFT JOIN dayn d ON d.team = q.team AND d.match_date < q.match_date GROUP BY ALL),
win AS (SELECT q.team, q.match_date, least(q.prior, 10) AS games, q.prior - g.r AS age, g.match_id, g.pts, g.gf, g.ga FROM pr q JOIN tg g ON g.team = q.team AND g.r BETWEEN q.prior - 9 AND q.prior),
seen AS (SELECT w.team, w.match_date, l.player_id, sum(st) * 1.0e0 / max(games) AS ps, sum(bn) * 1.0e0 / max(games) AS pb, coalesce(avg(CASE WHEN st = 1 THEN pts / 3.0e0 END), 0) AS s,
 coalesce(avg(CASE WHEN st = 1 THEN gf END), 0) AS atk, coalesce(-avg(CASE WHEN st = 1 THEN ga END), 0) AS de, max(CASE WHEN age = 0 THEN st ELSE 0 END) AS latest
 FROM win w JOIN lu l ON l.match_id = w.match_id AND l.team = w.team GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY team, match_date ORDER BY pb DESC, player_id) AS br FROM seen),
agg AS (SELECT team, match_date, sum(ps * s) / nullif(sum(ps), 0) AS strength, sum(ps * atk) / nullif(sum(ps), 0) AS attack, sum(ps * de) / nullif(sum(ps), 0) AS defense,
 sum(CASE WHEN br <= 5 THEN pb * s END) / nullif(sum(CASE WHEN br <= 5 THEN pb END), 0) AS bench, sum(ps * latest) / nullif(sum(latest), 0) AS continuity,
 avg(CASE WHEN ps > 0 AND ps < 1 THEN -(ps * ln(ps) + (1 - ps) * ln(1 - ps)) / ln(2.0e0) ELSE 0.0e0 END) AS uncertainty FROM rk GROUP BY ALL)
"""


@query(
    "w13_lineup_aggregates",
    LINEUP13 + """SELECT m.match_id, r6(h.strength) AS home_player_expected_strength, r6(h.attack) AS home_player_expected_attack, r6(a.defense) AS away_player_expected_defense,
 r6(h.bench) AS home_player_bench_quality, r6(a.bench) AS away_player_bench_quality, r6(h.continuity) AS home_player_lineup_continuity, r6(a.uncertainty) AS away_player_lineup_uncertainty
 FROM v_match m LEFT JOIN agg h ON h.team = m.home_team AND h.match_date = m.match_date LEFT JOIN agg a ON a.team = m.away_team AND a.match_date = m.match_date""",
)
def w13(spark, sf):
    out = p.prematch_player_features(matches(spark, sf), lineups(spark, sf))
    names = ["home_player_expected_strength", "home_player_expected_attack", "away_player_expected_defense", "home_player_bench_quality",
             "away_player_bench_quality", "home_player_lineup_continuity", "away_player_lineup_uncertainty"]
    return out.select("match_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "w1_best_lineup",
    """hd AS (SELECT match_id, team, side, concat('L', CAST(k AS VARCHAR), '-', CAST(match_id AS VARCHAR), side) AS lineup_id, CASE k WHEN 0 THEN 'gamma' WHEN 1 THEN 'alpha' ELSE 'beta' END AS provider, k,
  CASE WHEN k = 1 AND match_id % 2 = 0 THEN 1 ELSE 0 END AS short FROM (SELECT DISTINCT match_id, team, side FROM v_lineup) CROSS JOIN (VALUES (0),(1),(2)) AS t(k)),
 cnt AS (SELECT h.lineup_id, count(*) AS n FROM hd h JOIN v_lineup l ON l.match_id = h.match_id AND l.side = h.side AND l.lineup_role = 'starter' AND NOT (h.short = 1 AND l.slot = 5) GROUP BY ALL),
 rk AS (SELECT h.*, row_number() OVER (PARTITION BY match_id, team ORDER BY CASE provider WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 ELSE 2 END, lineup_id) AS rn FROM hd h JOIN cnt USING (lineup_id) WHERE n = 11)
 SELECT match_id, team, lineup_id, provider FROM rk WHERE rn = 1""",
)
def w1(spark, sf):
    rows = lineups(spark, sf)
    heads = rows.select("match_id", F.col("team").alias("team_id"), "side").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    heads = heads.withColumn("lineup_id", F.concat(F.lit("L"), F.col("k").cast("string"), F.lit("-"), F.col("match_id").cast("string"), F.col("side")))
    heads = heads.withColumn("provider", F.when(F.col("k") == 0, "gamma").when(F.col("k") == 1, "alpha").otherwise("beta"))
    players = heads.join(rows.select("match_id", "side", "slot", "lineup_role"), ["match_id", "side"])
    players = players.filter(~((F.col("k") == 1) & (F.col("match_id") % 2 == 0) & (F.col("slot") == 5))).select("lineup_id", "lineup_role")
    return p.best_lineup(heads, players, ["alpha", "beta"]).select("match_id", F.col("team_id").alias("team"), "lineup_id", "provider")


SLOTS = f"""
sl AS (SELECT l.*, {DEPT} AS department, CASE WHEN l.side = 'home' THEN m.home_goals ELSE m.away_goals END AS gf, CASE WHEN l.side = 'home' THEN m.away_goals ELSE m.home_goals END AS ga,
 CASE WHEN timing_observed AND minutes_played IS NOT NULL THEN minutes_played WHEN lineup_role = 'starter' THEN 90.0e0 ELSE 0.0e0 END AS mins, lineup_role = 'starter' AS s FROM v_lineup l JOIN v_match m USING (match_id)),
nu AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts, count(*) OVER w AS obs, count(CASE WHEN s THEN 1 END) OVER w AS starts,
 sum(CASE WHEN s THEN (CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) ELSE 0 END) OVER w AS spts, sum(CASE WHEN s THEN gf ELSE 0 END) OVER w AS sgf, sum(mins) OVER w AS smins,
 count(CASE WHEN timing_observed THEN 1 END) OVER w AS real_n, avg(minute_in) OVER w AS mi, avg(CASE WHEN NOT s AND timing_observed THEN CASE WHEN minute_in IS NOT NULL OR mins > 0 THEN 1.0e0 ELSE 0.0e0 END END) OVER w AS entry,
 max(match_date) OVER w AS last_day, count(*) OVER (PARTITION BY player_id, league ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS league_n,
 count(*) OVER (PARTITION BY player_id, department ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS dept_n,
 row_number() OVER (PARTITION BY player_id ORDER BY match_date, match_id, side DESC) AS r, CASE WHEN s THEN row_number() OVER (PARTITION BY player_id, s ORDER BY match_date, match_id, side DESC) END AS rs
 FROM sl WINDOW w AS (PARTITION BY player_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
rm AS (SELECT q.match_id, q.side, q.player_id, avg(h.mins) AS rmin FROM nu q JOIN nu h ON h.player_id = q.player_id AND h.r BETWEEN q.obs - 4 AND q.obs GROUP BY ALL),
rf AS (SELECT q.match_id, q.side, q.player_id, avg(h.pts) AS rpts, avg(h.ga) AS rga FROM nu q JOIN nu h ON h.player_id = q.player_id AND h.rs BETWEEN q.starts - 4 AND q.starts GROUP BY ALL)
"""
PAIRS = """
pp AS (SELECT a.match_id, a.side, a.match_date, a.player_id AS a, b.player_id AS b, a.s AS sa, b.s AS sb, CASE WHEN a.timing_observed AND b.timing_observed THEN least(a.mins, b.mins) END AS sh
 FROM sl a JOIN sl b ON a.match_id = b.match_id AND a.side = b.side AND a.player_id < b.player_id),
ph AS (SELECT *, count(CASE WHEN sa AND sb THEN 1 END) OVER w AS co, avg(sh) OVER w AS msh FROM pp
 WINDOW w AS (PARTITION BY a, b ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
pv AS (SELECT match_id, side, a AS player_id, co, msh FROM ph WHERE sb UNION ALL SELECT match_id, side, b, co, msh FROM ph WHERE sa),
mt AS (SELECT match_id, side, player_id, avg(ln(1.0e0 + co)) AS fam, avg(msh) AS sh, count(msh) * 1.0e0 / count(*) AS cov FROM pv GROUP BY ALL)
"""


@query(
    "j24_pair_history",
    SLOTS + "," + PAIRS + "SELECT match_id, side, count(*) AS n, sum(co) AS co_starts, r4(sum(msh)) AS shared FROM ph GROUP BY ALL",
)
def j24(spark, sf):
    pairs = p.pair_history(slots(spark, sf))
    mean = F.try_divide(F.col("shared_sum"), F.col("shared_n"))
    return pairs.groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("co_starts").alias("co_starts"), F.round(F.sum(mean), 4).alias("shared"))


W15_NAMES = ("career_strength", "career_goals_for", "log_starts", "log_days_since", "recent_strength", "recent_goals_against", "league_experience_share", "role_stability",
             "lineup_familiarity", "start_rate", "bench_entry_rate", "average_minutes", "recent_minutes", "minute_in_mean", "minutes_real_coverage", "shared_minutes", "shared_minutes_coverage")


@query(
    "w15_history_vectors",
    SLOTS + "," + PAIRS + """, vec AS (SELECT q.match_id, q.side, q.player_id, obs > 0 AS seen, spts / (3.0e0 * greatest(starts, 1)) AS career_strength, sgf * 1.0e0 / greatest(starts, 1) AS career_goals_for, ln(1.0e0 + starts) AS log_starts,
  ln(1.0e0 + least(date_diff('day', last_day, match_date), 365)) AS log_days_since, rpts / 3.0e0 AS recent_strength, rga AS recent_goals_against, league_n * 1.0e0 / nullif(obs, 0) AS league_experience_share,
  dept_n * 1.0e0 / nullif(obs, 0) AS role_stability, fam AS lineup_familiarity, starts * 1.0e0 / nullif(obs, 0) AS start_rate, entry AS bench_entry_rate, smins / nullif(obs, 0) / 90.0e0 AS average_minutes, rmin / 90.0e0 AS recent_minutes,
  mi / 90.0e0 AS minute_in_mean, real_n * 1.0e0 / nullif(obs, 0) AS minutes_real_coverage, sh / 90.0e0 AS shared_minutes, cov AS shared_minutes_coverage
  FROM nu q LEFT JOIN rm USING (match_id, side, player_id) LEFT JOIN rf USING (match_id, side, player_id) LEFT JOIN mt USING (match_id, side, player_id))
 SELECT match_id, side, count(*) AS n, """ + ", ".join(f"r4(sum(CASE WHEN seen THEN coalesce({n}, 0) ELSE 0 END)) AS {n}" for n in W15_NAMES) + " FROM vec GROUP BY ALL",
)
def w15(spark, sf):
    return sided(p.player_history_vectors(slots(spark, sf)), W15_NAMES)


@query(
    "w16_bench_assembly",
    """obs AS (SELECT match_id, side, team, player_id, slot, lineup_role FROM v_squad WHERE match_id % 4 <> 0),
 listed AS (SELECT match_id, side, player_id, slot AS place, 0 AS origin FROM v_lineup WHERE lineup_role <> 'starter'),
 extra AS (SELECT o.match_id, o.side, o.player_id, 0 AS place, 1 AS origin FROM obs o WHERE o.lineup_role = 'bench' AND NOT EXISTS
  (SELECT 1 FROM v_lineup l WHERE l.match_id = o.match_id AND l.side = o.side AND l.player_id = o.player_id)),
 al AS (SELECT * FROM listed UNION ALL SELECT * FROM extra),
 rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY origin, place, player_id) AS bench_slot FROM al)
 SELECT match_id, side, bench_slot, player_id, CASE origin WHEN 0 THEN 'lineup' ELSE 'store' END AS origin FROM rk WHERE bench_slot <= 12""",
)
def w16(spark, sf):
    store = p.temporal_player_matrix(squad_observations(spark, sf)).select(
        "match_id", "player_id", "team_id", "current_lineup_role", "current_position_normalized"
    )
    return p.assemble_bench(lineups(spark, sf), store).select("match_id", "side", "bench_slot", "player_id", "origin")


@query(
    "w17_minutes_estimate",
    """SELECT match_id, side, r4(sum(CASE WHEN lineup_role = 'starter' THEN greatest(least(coalesce(minute_out, 90), 90), 0) WHEN minute_in IS NOT NULL THEN greatest(least(coalesce(minute_out, 90), 90) - least(minute_in, 90), 0) END)) AS minutes FROM v_lineup GROUP BY ALL""",
)
def w17(spark, sf):
    estimate = p.minutes_estimate(F.col("lineup_role") == "starter", F.col("minute_in"), F.col("minute_out"))
    return lineups(spark, sf).groupBy("match_id", "side").agg(F.round(F.sum(estimate), 4).alias("minutes"))


def store_slots(spark, sf):
    """Line-up slots with history vectors and encoded store columns."""
    store = p.encode_temporal(p.temporal_player_matrix(squad_observations(spark, sf)), ["match_id", "player_id"])
    return p.attach_store(p.player_history_vectors(slots(spark, sf)), store)


STORE = """
so AS (SELECT * FROM v_squad WHERE match_id % 4 <> 0),
sn AS (SELECT match_id, side, player_id, count(*) OVER w AS n, count(minutes_played) OVER w AS mn, count(CASE WHEN lineup_role = 'starter' THEN 1 END) OVER w AS st, count(minute_in) OVER w AS mi, count(minute_out) OVER w AS mo FROM so
 WINDOW w AS (PARTITION BY player_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
"""


@query(
    "j26_attach_store",
    STORE + """att AS (SELECT l.match_id, l.side, count(*) AS n, count(s.player_id) AS attached, r4(sum(ln(1.0e0 + s.n))) AS fs_observations_value FROM v_lineup l LEFT JOIN sn s USING (match_id, side, player_id) GROUP BY ALL) SELECT * FROM att""",
)
def j26(spark, sf):
    store = p.encode_temporal(p.temporal_player_matrix(squad_observations(spark, sf)), ["match_id", "player_id"])
    out = p.attach_store(lineups(spark, sf), store)
    return out.groupBy("match_id", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count("fs_store_available").alias("attached"), F.round(F.sum("fs_observations_value"), 4).alias("fs_observations_value")
    )


@query(
    "m10_reliability",
    STORE + SLOTS + """, tr AS (SELECT q.match_id, q.side, avg(least(q.obs / 5.0e0, 1.0e0)) AS depth, avg(CASE WHEN (s2.mn > 0 OR s2.st > 0) AND (s2.mi > 0 OR s2.mo > 0) THEN 1.0e0 ELSE 0.0e0 END) AS timing,
 avg(CASE WHEN s2.n >= 5 THEN 1.0e0 ELSE 0.0e0 END) AS solid FROM nu q LEFT JOIN sn s2 USING (match_id, side, player_id) WHERE q.s GROUP BY ALL),
 tl AS (SELECT *, least(depth, timing, solid) AS rel FROM tr)
 SELECT match_id, r6(max(CASE WHEN side = 'home' THEN depth END)) AS home_history_depth, r6(max(CASE WHEN side = 'away' THEN timing END)) AS away_timing_coverage,
  r6(max(CASE WHEN side = 'home' THEN solid END)) AS home_reliable_starters, r6(min(rel)) AS match_reliability FROM tl GROUP BY match_id""",
)
def m10(spark, sf):
    names = ["home_history_depth", "away_timing_coverage", "home_reliable_starters", "match_reliability"]
    return p.reliability(store_slots(spark, sf)).select("match_id", *[round6(n).alias(n) for n in names])


@query(
    "ga33_player_pools",
    f"""sl AS (SELECT *, {DEPT} AS department, coalesce(minutes_played, 0) AS v FROM v_lineup)
 SELECT match_id, r6(avg(CASE WHEN side = 'home' AND slot < 11 THEN v END)) AS home_starter_all_v_mean, r6(coalesce(stddev_pop(CASE WHEN side = 'away' AND slot < 11 THEN v END), 0)) AS away_starter_all_v_std,
 r6(coalesce(avg(CASE WHEN side = 'home' AND slot >= 11 AND department = 'midfield' THEN v END), 0)) AS home_bench_midfield_v_mean,
 CAST(count(CASE WHEN side = 'home' AND slot < 11 AND department = 'attack' THEN 1 END) - count(CASE WHEN side = 'away' AND slot < 11 AND department = 'attack' THEN 1 END) AS DOUBLE) AS difference_starter_attack_count,
 r6(coalesce(avg(CASE WHEN side = 'home' AND slot < 11 AND department = 'defense' THEN v END), 0) - coalesce(avg(CASE WHEN side = 'away' AND slot < 11 AND department = 'defense' THEN v END), 0)) AS difference_starter_defense_v_mean
 FROM sl GROUP BY match_id""",
)
def ga33(spark, sf):
    rows = lineups(spark, sf).withColumn("department", p.department("position")).withColumn("v", F.coalesce("minutes_played", F.lit(0.0)))
    names = ["home_starter_all_v_mean", "away_starter_all_v_std", "home_bench_midfield_v_mean", "difference_starter_attack_count", "difference_starter_defense_v_mean"]
    return p.pool_players(rows, ["v"]).select("match_id", *[round6(n).alias(n) for n in names])


@query(
    "ga34_availability_rates",
    STORE + SLOTS + """SELECT CASE WHEN q.s THEN 'starter' ELSE 'bench' END AS slot_group, count(*) AS slots, r6(avg(CASE WHEN q.obs > 0 THEN 1.0e0 ELSE 0.0e0 END)) AS history_rate,
 r6(avg(coalesce(q.real_n * 1.0e0 / nullif(q.obs, 0), 0))) AS real_minutes_rate, r6(avg(CASE WHEN s2.player_id IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END)) AS store_rate,
 r6(avg(CASE WHEN s2.mn > 0 OR s2.st > 0 THEN 1.0e0 ELSE 0.0e0 END)) AS minutes_available_rate FROM nu q LEFT JOIN sn s2 USING (match_id, side, player_id) GROUP BY 1""",
)
def ga34(spark, sf):
    out = p.availability_rates(store_slots(spark, sf))
    return out.select("slot_group", "slots", *[round6(c).alias(c) for c in ("history_rate", "real_minutes_rate", "store_rate", "minutes_available_rate")])
