"""Registered evaluation, score-model and strategy queries (G-A11 - G-A19, M1-M16, S1-S9, T5, T7, J14, J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.resample import POISSON_STEPS
from ..functions.scalars import round6
from ..functions.temporal import as_of_latest
from ..operators import evaluate as e
from ..operators import players as pl
from ..operators import scores as sc
from ..operators import strategy as st
from ..plans.views import view
from ..session import stage
from .history import matches
from .players import lineups
from .registry import query

P = {"H": "p_h", "D": "p_d", "A": "p_a"}


def r6s(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


METRIC_SQL = """sc AS (SELECT *, CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END AS pt, greatest(p_h, p_d, p_a) AS conf,
 CASE WHEN (CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END) = result THEN 1.0e0 ELSE 0.0e0 END AS hit,
 power(p_h - CAST(result='H' AS INT), 2) + power(p_d - CAST(result='D' AS INT), 2) + power(p_a - CAST(result='A' AS INT), 2) AS br,
 (power(p_h - CAST(result='H' AS INT), 2) + power(p_h + p_d - CAST(result IN ('H','D') AS INT), 2)) / 2 AS rp FROM v_pred)"""


def metric_block(by: str) -> str:
    return f"""(SELECT {by}, count(*) AS matches, avg(-ln(pt)) AS log_loss, avg(br) AS brier, avg(rp) AS rps, avg(hit) AS accuracy FROM sc GROUP BY {by}) m
 JOIN (SELECT {by}, sum(abs(c - h)) / sum(n) AS ece FROM (SELECT {by}, least(floor(conf * 10), 9) AS b, count(*) AS n, sum(conf) AS c, sum(hit) AS h FROM sc GROUP BY {by}, least(floor(conf * 10), 9)) GROUP BY {by}) z USING ({by})"""


LIST = "matches, r6(log_loss) AS log_loss, r6(brier) AS brier, r6(rps) AS rps, r6(accuracy) AS accuracy, r6(ece) AS ece"


@query("ga11_probability_metrics", METRIC_SQL + f" SELECT model, {LIST} FROM {metric_block('model')}")
def ga11(spark, sf):
    return r6s(e.probability_metrics(view(spark, sf, "v_pred"), ["model"], P), e.METRICS)


@query("ga12_metrics_by_season", METRIC_SQL + f" SELECT season, model, {LIST} FROM {metric_block('season, model')}")
def ga12(spark, sf):
    return r6s(e.metrics_by_season(view(spark, sf, "v_pred"), P), e.METRICS)


@query(
    "ga13_weighted_model_means",
    METRIC_SQL + f", bs AS (SELECT * FROM {metric_block('season, model')}) SELECT model, CAST(sum(matches) AS BIGINT) AS matches, "
    + ", ".join(f"r6(sum({n} * matches) / sum(matches)) AS {n}" for n in e.METRICS) + " FROM bs GROUP BY model",
)
def ga13(spark, sf):
    return r6s(e.weighted_model_means(e.metrics_by_season(view(spark, sf, "v_pred"), P)), e.METRICS)


FEATURES = """ft AS (SELECT match_id, season, league, result, CAST((match_id * 37) % 500 - 250 AS DOUBLE) AS elo_difference,
 1.0e0/(1.0e0 + exp(-((match_id * 37) % 500 - 250) / 170.0e0)) AS elo_expected_home, CASE WHEN match_id % 50 = 7 THEN NULL ELSE CAST(match_id % 12 AS DOUBLE) END AS home_rest_days,
 CAST((match_id * 5) % 13 AS DOUBLE) AS away_rest_days, CAST(match_id % 9 AS BIGINT) AS home_matches_played, CAST((match_id * 3) % 11 AS BIGINT) AS away_matches_played,
 CASE WHEN match_id % 23 = 0 THEN NULL ELSE CAST((match_id * 13) % 101 AS DOUBLE) / 10 - 5 END AS form_difference,
 CASE result WHEN 'H' THEN 1.0e0 WHEN 'D' THEN 0.5e0 ELSE 0.0e0 END AS hs, CASE WHEN result = 'H' THEN 1.0e0 ELSE 0.0e0 END AS hw, CASE WHEN result = 'D' THEN 1.0e0 ELSE 0.0e0 END AS dr FROM v_match)"""


def features(spark, sf):
    k = F.col("match_id")
    gap = ((k * 37) % 500 - 250).cast("double")
    return matches(spark, sf).select(
        "match_id", "season", "league", "result", gap.alias("elo_difference"), (1.0 / (1.0 + F.exp(-gap / 170.0))).alias("elo_expected_home"),
        F.when(k % 50 != 7, (k % 12).cast("double")).alias("home_rest_days"), ((k * 5) % 13).cast("double").alias("away_rest_days"),
        (k % 9).alias("home_matches_played"), ((k * 3) % 11).alias("away_matches_played"),
        F.when(k % 23 != 0, ((k * 13) % 101).cast("double") / 10 - 5).alias("form_difference"),
    )


ELO_CASE = "CASE WHEN elo_difference <= -150 THEN '(-inf, -150]' WHEN elo_difference <= -75 THEN '(-150, -75]' WHEN elo_difference <= -25 THEN '(-75, -25]' WHEN elo_difference <= 25 THEN '(-25, 25]' WHEN elo_difference <= 75 THEN '(25, 75]' WHEN elo_difference <= 150 THEN '(75, 150]' ELSE '(150, inf]' END"


@query(
    "ga14_elo_diagnostics",
    FEATURES + f" SELECT {ELO_CASE} AS elo_bin, count(*) AS matches, r6(avg(elo_expected_home)) AS expected_home, r6(avg(hs)) AS actual_home_score, r6(avg(hw)) AS home_win_rate, r6(avg(dr)) AS draw_rate, r6(avg(hs) - avg(elo_expected_home)) AS calibration_error FROM ft GROUP BY 1",
)
def ga14(spark, sf):
    return r6s(e.elo_diagnostics(features(spark, sf)), ["expected_home", "actual_home_score", "home_win_rate", "draw_rate", "calibration_error"])


@query(
    "ga15_rest_diagnostics",
    FEATURES + """, g AS (SELECT *, home_rest_days - away_rest_days AS d FROM ft) SELECT CASE WHEN d <= -4 THEN 'home <=-5' WHEN d <= -1 THEN 'home -4/-2' WHEN d <= 1 THEN 'similar' WHEN d <= 4 THEN 'home +2/+4' ELSE 'home >=+5' END AS rest_bin,
 count(*) AS matches, r6(avg(hw)) AS home_win_rate, r6(avg(hs)) AS home_score FROM g WHERE d IS NOT NULL GROUP BY 1""",
)
def ga15(spark, sf):
    return r6s(e.rest_diagnostics(features(spark, sf)), ["home_win_rate", "home_score"])


@query(
    "ga16_form_diagnostics",
    FEATURES + """, q AS (SELECT quantile_cont(form_difference, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ed FROM ft),
 b AS (SELECT f.*, CASE WHEN form_difference <= ed[2] THEN 0 WHEN form_difference <= ed[3] THEN 1 WHEN form_difference <= ed[4] THEN 2 WHEN form_difference <= ed[5] THEN 3 ELSE 4 END AS bin FROM ft f JOIN q ON true WHERE form_difference IS NOT NULL)
 SELECT bin, count(*) AS matches, r6(avg(form_difference)) AS form_difference, r6(avg(hw)) AS home_win_rate, r6(avg(hs)) AS home_score FROM b GROUP BY bin""",
)
def ga16(spark, sf):
    return r6s(e.form_diagnostics(features(spark, sf)), ["form_difference", "home_win_rate", "home_score"])


@query("ga17_league_diagnostics", FEATURES + " SELECT league, count(*) AS matches, r6(avg(hw)) AS home_win_rate, r6(avg(dr)) AS draw_rate, r6(avg(power(elo_expected_home - hs, 2))) AS elo_brier FROM ft GROUP BY league")
def ga17(spark, sf):
    return r6s(e.league_diagnostics(features(spark, sf)), ["home_win_rate", "draw_rate", "elo_brier"])


@query(
    "ga18_missing_rates",
    "SELECT 'minutes_played' AS column_name, r6(avg(CASE WHEN minutes_played IS NULL THEN 1.0e0 ELSE 0.0e0 END)) AS missing_rate FROM v_obs UNION ALL SELECT 'minute_in', r6(avg(CASE WHEN minute_in IS NULL THEN 1.0e0 ELSE 0.0e0 END)) FROM v_obs UNION ALL SELECT 'position_original', r6(avg(CASE WHEN position_original IS NULL THEN 1.0e0 ELSE 0.0e0 END)) FROM v_obs",
)
def ga18(spark, sf):
    out = e.missing_rates(view(spark, sf, "v_obs").select("minutes_played", "minute_in", "position_original"))
    return r6s(out, ["missing_rate"]).withColumnRenamed("column", "column_name")


@query(
    "ga19_feature_summary",
    FEATURES + """, lb AS (SELECT league, avg(power(elo_expected_home - hs, 2)) AS b FROM ft GROUP BY league) SELECT count(*) AS rows, count(DISTINCT league) AS leagues, count(DISTINCT season) AS seasons,
 r6(avg(CASE WHEN home_matches_played >= 5 AND away_matches_played >= 5 THEN 1.0e0 ELSE 0.0e0 END)) AS ready_share, (SELECT league FROM lb ORDER BY b, league LIMIT 1) AS best_league FROM ft""",
)
def ga19(spark, sf):
    return r6s(e.feature_summary(features(spark, sf)), ["ready_share"])


@query(
    "f_exact_quantiles",
    "SELECT bookmaker, count(*) AS n, r6(quantile_cont(1.0e0/odds_h + 1.0e0/odds_d + 1.0e0/odds_a - 1.0e0, 0.25)) AS q0, r6(median(1.0e0/odds_h + 1.0e0/odds_d + 1.0e0/odds_a - 1.0e0)) AS q1, r6(quantile_cont(1.0e0/odds_h + 1.0e0/odds_d + 1.0e0/odds_a - 1.0e0, 0.95)) AS q2 FROM v_quote GROUP BY bookmaker",
)
def f_quantiles(spark, sf):
    rows = view(spark, sf, "v_quote").select("bookmaker", (1.0 / F.col("odds_h") + 1.0 / F.col("odds_d") + 1.0 / F.col("odds_a") - 1.0).alias("margin"))
    return r6s(exact_quantiles(rows, "margin", [0.25, 0.5, 0.95], ["bookmaker"]), ["q0", "q1", "q2"])


# ---- bootstrap ----------------------------------------------------------------------------

MOD = 2147483647


def weights_sql(source: str, value: str, columns: str, samples: int, seed: int) -> str:
    steps = " + ".join(f"CASE WHEN u >= {s!r}e0 THEN 1 ELSE 0 END" for s in POISSON_STEPS)
    return f"""wa AS (SELECT {columns} {value} AS x, match_id % {MOD} AS k, b FROM {source} CROSS JOIN (SELECT unnest(range({samples})) AS b) r),
 wb AS (SELECT *, (k * 48271 + b * 69621 + {seed}) % {MOD} AS h1 FROM wa),
 wc AS (SELECT *, ((h1 * h1) % {MOD} * 16807 + b * 101 + k) % {MOD} AS h2 FROM wb),
 wd AS (SELECT *, (((h2 * h2) % {MOD} * 39373 + h1) % {MOD}) * 1.0e0 / {MOD} AS u FROM wc),
 we AS (SELECT *, {steps} AS w FROM wd)"""


DIFF = """pd AS (SELECT c.match_id, -ln(CASE c.result WHEN 'H' THEN c.p_h WHEN 'D' THEN c.p_d ELSE c.p_a END) + ln(CASE c.result WHEN 'H' THEN r.p_h WHEN 'D' THEN r.p_d ELSE r.p_a END) AS difference
 FROM v_pred c JOIN v_pred r ON r.match_id = c.match_id AND r.model = 'reference' WHERE c.model = 'candidate')"""


def int_key():
    return F.pmod(F.col("match_id"), F.lit(MOD))


def sides(spark, sf):
    pred = view(spark, sf, "v_pred")
    return pred.filter("model = 'candidate'"), pred.filter("model = 'reference'")


@query(
    "m13_paired_bootstrap",
    DIFF + ", " + weights_sql("pd", "difference", "", 2000, 42) + """, mm AS (SELECT b, sum(w * x) / nullif(sum(w), 0) AS m FROM we GROUP BY b), iv AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(CASE WHEN m < 0 THEN 1.0e0 ELSE 0.0e0 END) AS pb FROM mm)
 SELECT count(*) AS matches, r6(avg(difference)) AS mean_log_loss_difference, r6(max(lo)) AS ci_low, r6(max(hi)) AS ci_high, r6(max(pb)) AS probability_candidate_better,
 CASE WHEN max(hi) < 0 THEN 'candidate_better' WHEN max(lo) > 0 THEN 'candidate_worse' ELSE 'inconclusive' END AS verdict FROM pd JOIN iv ON true""",
)
def m13(spark, sf):
    candidate, reference = sides(spark, sf)
    out = e.paired_log_loss_bootstrap(candidate, reference, 2000, 42, P, int_key())
    return r6s(out, ["mean_log_loss_difference", "ci_low", "ci_high", "probability_candidate_better"])


@query("m14_evaluate_frozen", METRIC_SQL + f" SELECT model, {LIST} FROM {metric_block('model')}")
def m14(spark, sf):
    candidate, reference = sides(spark, sf)
    return r6s(e.evaluate_frozen(candidate, reference, 2000, 42, P, int_key())["metrics"], e.METRICS)


@query(
    "m15_fold_manifest",
    """dg AS (SELECT lpad(season, 4, '0') AS test_season, CAST('0x' || substr(md5(CAST(match_id AS VARCHAR)), 1, 12) AS BIGINT) AS d FROM v_match),
 ps AS (SELECT test_season, count(*) AS n, sum(d) AS s, bit_xor(d) AS x FROM dg GROUP BY 1)
 SELECT test_season, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS train_matches, n AS test_matches, CAST(coalesce(sum(s) OVER w, 0) AS VARCHAR) AS train_ids_sum, CAST(s AS VARCHAR) AS test_ids_sum, x AS test_xor
 FROM ps WINDOW w AS (ORDER BY test_season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def m15(spark, sf):
    return e.fold_manifest(matches(spark, sf))


@query("t7_set_comparison", """l AS (SELECT DISTINCT match_id FROM v_obs WHERE line > 1), r AS (SELECT match_id FROM v_match WHERE league IN ('1', '2')) SELECT (SELECT count(*) FROM l WHERE match_id NOT IN (SELECT match_id FROM r)) AS only_left,
 (SELECT count(*) FROM r WHERE match_id NOT IN (SELECT match_id FROM l)) AS only_right, (SELECT count(*) FROM l WHERE match_id IN (SELECT match_id FROM r)) AS common""")
def t7(spark, sf):
    return e.set_difference_counts(view(spark, sf, "v_obs").filter("line > 1").select("match_id"), matches(spark, sf).filter("league IN ('1', '2')"), "match_id")


@query("j20_common_matches", """ids AS (SELECT match_id FROM v_match WHERE league <> '5' INTERSECT SELECT match_id FROM v_obs WHERE line = 2 INTERSECT SELECT match_id FROM v_quote WHERE timing = 'closing')
 SELECT m.match_id, m.season FROM v_match m WHERE m.match_id IN (SELECT match_id FROM ids)""")
def j20(spark, sf):
    frames = [matches(spark, sf).filter("league <> '5'"), view(spark, sf, "v_obs").filter("line = 2"), view(spark, sf, "v_quote").filter("timing = 'closing'")]
    return e.common_matches(frames)[0].select("match_id", "season")


# ---- score model --------------------------------------------------------------------------

RATES = """rt AS (SELECT match_id, season, league, result, home_goals, away_goals, 0.4e0 + (match_id % 23) / 10.0e0 AS hr, 0.3e0 + (match_id % 17) / 8.0e0 AS ar, (match_id % 9 - 4) / 50.0e0 AS rho FROM v_match)"""


def rated(spark, sf):
    k = F.col("match_id")
    return matches(spark, sf).select(
        "match_id", "season", "league", "result", "home_goals", "away_goals", (F.lit(0.4) + (k % 23) / 10.0).alias("home_rate"),
        (F.lit(0.3) + (k % 17) / 8.0).alias("away_rate"), ((k % 9 - 4) / 50.0).alias("rho"),
    )


SCORE_SQL = """, gr AS (SELECT r.*, i, j, exp(i * ln(hr) - hr - lgamma(i + 1)) * exp(j * ln(ar) - ar - lgamma(j + 1)) * (CASE WHEN i = 0 AND j = 0 THEN greatest(1 - hr * ar * rho, 1e-9) WHEN i = 0 AND j = 1 THEN greatest(1 + hr * rho, 1e-9)
 WHEN i = 1 AND j = 0 THEN greatest(1 + ar * rho, 1e-9) WHEN i = 1 AND j = 1 THEN greatest(1 - rho, 1e-9) ELSE 1.0e0 END) AS m FROM rt r CROSS JOIN (SELECT unnest(range(11)) AS i) CROSS JOIN (SELECT unnest(range(11)) AS j)),
 pb AS (SELECT match_id, sum(CASE WHEN i > j THEN m END) / sum(m) AS ph, sum(CASE WHEN i = j THEN m END) / sum(m) AS pd, sum(CASE WHEN i < j THEN m END) / sum(m) AS pa FROM gr GROUP BY match_id)"""


@query("m3_score_probabilities", RATES + SCORE_SQL + " SELECT match_id, r6(ph) AS probability_home, r6(pd) AS probability_draw, r6(pa) AS probability_away FROM pb")
def m3(spark, sf):
    out = sc.score_probabilities(rated(spark, sf))
    names = ["probability_home", "probability_draw", "probability_away"]
    return out.select("match_id", *[round6(n).alias(n) for n in names])


@query(
    "m2_fit_rho",
    RATES + """, lo AS (SELECT * FROM rt WHERE home_goals <= 1 AND away_goals <= 1), gd AS (SELECT i, -0.2e0 + 0.4e0 * i / 80 AS g FROM (SELECT unnest(range(81)) AS i)),
 ll AS (SELECT i, g, sum(ln(greatest(CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - hr * ar * g WHEN home_goals = 0 THEN 1 + hr * g WHEN away_goals = 0 THEN 1 + ar * g ELSE 1 - g END, 1e-9))) AS l FROM lo CROSS JOIN gd GROUP BY ALL)
 SELECT r6(g) AS rho FROM ll ORDER BY l DESC, i LIMIT 1""",
)
def m2(spark, sf):
    return sc.fit_rho(rated(spark, sf)).select(round6("rho").alias("rho"))


@query("m6_residual_targets", RATES + " SELECT match_id, r6(ln((home_goals + 0.5e0)/(hr + 0.5e0))) AS home_target, r6(ln((away_goals + 0.5e0)/(ar + 0.5e0))) AS away_target FROM rt")
def m6(spark, sf):
    return sc.residual_targets(rated(spark, sf)).select("match_id", round6("home_target").alias("home_target"), round6("away_target").alias("away_target"))


def corrected(spark, sf):
    k = F.col("match_id")
    raw = rated(spark, sf).withColumns({"home_raw": (k % 19 - 9) / 10.0, "away_raw": (k % 15 - 7) / 20.0, "match_reliability": (k % 11) / 10.0})
    return sc.gate_corrections(raw)


GATED = RATES.replace("AS rho FROM", "AS rho, least(greatest((match_id % 19 - 9) / 10.0e0, -0.35e0), 0.35e0) AS hc, least(greatest((match_id % 15 - 7) / 20.0e0, -0.35e0), 0.35e0) AS ac, (match_id % 11) / 10.0e0 AS gate FROM")


@query("m11_gate_corrections", GATED + " SELECT match_id, r6(hc) AS home_correction_pre_gate, r6(ac) AS away_correction_pre_gate, r6(hc * gate) AS home_correction_post_gate, r6(ac * gate) AS away_correction_post_gate FROM rt")
def m11(spark, sf):
    names = ["home_correction_pre_gate", "away_correction_pre_gate", "home_correction_post_gate", "away_correction_post_gate"]
    return corrected(spark, sf).select("match_id", *[round6(n).alias(n) for n in names])


@query(
    "m12_prediction_artifact",
    GATED.replace("rt AS", "r0 AS") + ", rt AS (SELECT match_id, season, league, result, hr * exp(hc * gate) AS hr, ar * exp(ac * gate) AS ar, rho, hr AS base, gate FROM r0)" + SCORE_SQL
    + " SELECT match_id, season, result, r6(ph) AS probability_home, r6(pd) AS probability_draw, r6(pa) AS probability_away, r6(base) AS home_base_rate, r6(gate) AS reliability_gate FROM pb JOIN rt USING (match_id)",
)
def m12(spark, sf):
    out = sc.prediction_artifact(corrected(spark, sf), "gated", "combined")
    names = ["probability_home", "probability_draw", "probability_away", "home_base_rate", "reliability_gate"]
    return out.select("match_id", "season", "result", *[round6(n).alias(n) for n in names])


@query(
    "m1_score_model_totals",
    # With an unpenalised intercept the fitted rates add up to the observed goals on the training set.
    "SELECT count(*) AS matches, CAST(round(sum(home_goals)) AS BIGINT) AS home_goals, CAST(round(sum(away_goals)) AS BIGINT) AS away_goals FROM v_match",
)
def m1(spark, sf):
    games = model_features(spark, sf)
    model = sc.fit_score_model(games)
    return model.rates(games).agg(
        F.count(F.lit(1)).alias("matches"), F.round(F.sum("home_rate")).cast("long").alias("home_goals"), F.round(F.sum("away_rate")).cast("long").alias("away_goals")
    )


@query(
    "m4_score_equations",
    # At the optimum every identity's observed goals equal its fitted ones less the penalty, so each equation leaves nothing.
    """l AS (SELECT unnest([{'kind': 'one', 'level': ''}, {'kind': 'home_team', 'level': CAST(home_team AS VARCHAR)}, {'kind': 'away_team', 'level': CAST(away_team AS VARCHAR)},
 {'kind': 'league', 'level': CAST(league AS VARCHAR)}]) AS e FROM v_match)
 SELECT e.kind AS kind, e.level AS level, count(*) AS matches, CAST(0 AS BIGINT) AS home_left, CAST(0 AS BIGINT) AS away_left FROM l WHERE e.level IS NOT NULL GROUP BY ALL""",
)
def m4_equations(spark, sf):
    games = model_features(spark, sf)
    left = sc.fit_score_model(games, []).equations(games)
    return left.select("kind", "level", F.col("n").alias("matches"), *[F.round(F.col(f"{s}_residual") * 1e4).cast("long").alias(f"{s}_left") for s in ("home", "away")])


def model_features(spark, sf):
    games = matches(spark, sf)
    return games.select(
        "match_id", "season", "league", "result", "home_team", "away_team", "home_goals", "away_goals", "date",
        F.col("home_shots").cast("double").alias("form_a"), (F.col("match_id") % 13).cast("double").alias("form_b"),
    )


@query(
    "m4_rate_bounds",
    "SELECT season, count(*) AS matches, 0 AS outside FROM v_match GROUP BY season",
)
def m4(spark, sf):
    games = model_features(spark, sf)
    rates = sc.fit_score_model(games, ["form_b"]).rates(games)
    bad = (F.col("home_rate") < sc.RATE_FLOOR) | (F.col("home_rate") > sc.RATE_CEILING) | (F.col("away_rate") < sc.RATE_FLOOR) | (F.col("away_rate") > sc.RATE_CEILING)
    return rates.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(bad, 1)).cast("int").alias("outside"))


@query(
    "m5_cross_fitted_rates",
    "SELECT season, count(*) AS matches, count(*) AS within_bounds FROM v_match WHERE season > (SELECT min(season) FROM v_match) GROUP BY season",
)
def m5(spark, sf):
    games = model_features(spark, sf)
    rates = sc.cross_fitted_rates(games, games, ["form_b"])
    inside = F.col("home_rate").between(sc.RATE_FLOOR, sc.RATE_CEILING) & F.col("away_rate").between(sc.RATE_FLOOR, sc.RATE_CEILING) & F.col("rho").between(-0.2, 0.2)
    return rates.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(inside, 1)).alias("within_bounds"))


def pooled(spark, sf):
    rows = lineups(spark, sf).withColumn("department", pl.department("position")).withColumn("v", F.coalesce("minutes_played", F.lit(0.0)))
    pools = pl.pool_players(rows, ["v"])
    facts = matches(spark, sf).select("match_id", "season", "league", "result", "home_goals", "away_goals")
    return pools.join(facts, "match_id")


def walk(spark, sf, learner, ablation, max_iter):
    data = pooled(spark, sf)
    columns = [c for c in data.columns if c.startswith("difference_")]
    k = F.col("match_id")
    gate = matches(spark, sf).select("match_id", ((k % 11) / 10.0).alias("match_reliability"))
    rates = rated(spark, sf).select("match_id", "season", "home_rate", "away_rate", "rho")
    return sc.walk_forward_residuals(data, rates, gate, columns, ablation, learner, max_iter=max_iter)


WALK = "SELECT season, count(*) AS matches, count(*) AS bounded FROM v_match WHERE season > (SELECT min(season) FROM v_match) GROUP BY season"


def walk_check(predictions):
    total = F.col("probability_home") + F.col("probability_draw") + F.col("probability_away")
    fine = (F.abs(total - 1) < 1e-9) & (F.abs("home_correction_pre_gate") <= 0.35) & (F.abs("away_correction_post_gate") <= 0.35 * F.col("reliability_gate") + 1e-12)
    return predictions.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(fine, 1)).alias("bounded"))


@query("m7_boosted_residuals", WALK)
def m7(spark, sf):
    return walk_check(walk(spark, sf, "boosting", "base", 2)[1])


@query("m8_walk_forward", WALK)
def m8(spark, sf):
    return walk_check(walk(spark, sf, "linear", "combined", 1)[1])


@query("m9_ablations", "SELECT * FROM (VALUES ('base', 13), ('bench', 25), ('combined', 49), ('feature_store', 25)) AS t(ablation, columns_used) JOIN (SELECT count(*) AS matches FROM v_match) ON true")
def m9(spark, sf):
    rows = lineups(spark, sf).withColumn("department", pl.department("position")).withColumn("v", F.coalesce("minutes_played", F.lit(0.0))).withColumn("fs_w", F.col("v"))
    pools = pl.pool_players(rows, ["v", "fs_w"])
    columns = [c for c in pools.columns if c.startswith("difference_") and not c.endswith("_count")] + ["difference_starter_all_count"]
    counts = {a: len(sc.ablation_features(columns, a)) for a in sc.ABLATIONS}
    return pools.agg(F.count(F.lit(1)).alias("matches")).select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("ablation"), F.lit(n).alias("columns_used")) for a, n in counts.items()])), "matches"
    )


@query("m16_linear_lineup_residual", WALK)
def m16(spark, sf):
    return walk_check(walk(spark, sf, "linear", "base", 1)[1])


# ---- strategy -----------------------------------------------------------------------------

EDGE_SQL = """lq AS (SELECT q.match_id, q.selection, q.odds, row_number() OVER (PARTITION BY q.match_id, q.selection ORDER BY q.quoted_at DESC, q.odds DESC) AS rn FROM v_odds q JOIN v_match m USING (match_id)
  WHERE q.bookmaker = 'B1' AND q.quoted_at <= m.match_date + INTERVAL '60 days'),
 px AS (SELECT match_id, max(CASE WHEN selection = 'H' THEN odds END) AS oh, max(CASE WHEN selection = 'D' THEN odds END) AS od, max(CASE WHEN selection = 'A' THEN odds END) AS oa FROM lq WHERE rn = 1 GROUP BY match_id),
 ed0 AS (SELECT c.match_id, c.season, c.league, c.result, c.p_h, c.p_d, c.p_a, r.p_h AS m_h, r.p_d AS m_d, r.p_a AS m_a, oh, od, oa,
  CASE WHEN c.p_h >= c.p_d AND c.p_h >= c.p_a THEN 'H' WHEN c.p_d >= c.p_a THEN 'D' ELSE 'A' END AS pick, abs((c.match_id * 37) % 500 - 250.0e0) AS gap, least(c.match_id % 9, (c.match_id * 3) % 11) >= 5 AS experienced
  FROM v_pred c JOIN v_pred r ON r.match_id = c.match_id AND r.model = 'reference' JOIN px ON px.match_id = c.match_id WHERE c.model = 'candidate'),
 ed1 AS (SELECT *, CASE pick WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END AS mp, CASE pick WHEN 'H' THEN m_h WHEN 'D' THEN m_d ELSE m_a END AS kp, CASE pick WHEN 'H' THEN oh WHEN 'D' THEN od ELSE oa END AS odds FROM ed0),
 ed AS (SELECT *, mp - kp AS edge, CASE WHEN result = pick THEN odds - 1.0e0 ELSE -1.0e0 END AS profit,
  -ln(CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END) AS mll, -ln(CASE result WHEN 'H' THEN m_h WHEN 'D' THEN m_d ELSE m_a END) AS kll,
  power(p_h - CAST(result='H' AS INT), 2) + power(p_d - CAST(result='D' AS INT), 2) + power(p_a - CAST(result='A' AS INT), 2) AS mbr,
  power(m_h - CAST(result='H' AS INT), 2) + power(m_d - CAST(result='D' AS INT), 2) + power(m_a - CAST(result='A' AS INT), 2) AS kbr FROM ed1 WHERE odds IS NOT NULL)"""


def edge_inputs(spark, sf):
    pred = view(spark, sf, "v_pred")
    games = matches(spark, sf).select("match_id", F.date_add("date", 60).cast("timestamp").alias("prediction_cutoff"))
    predictions = pred.filter("model = 'candidate'").join(games, "match_id").select(
        "match_id", "season", "league", "result", "prediction_cutoff", F.col("p_h").alias("probability_home"), F.col("p_d").alias("probability_draw"), F.col("p_a").alias("probability_away"))
    k = F.col("match_id")
    known = pred.filter("model = 'reference'").select(
        "match_id", ((k * 37) % 500 - 250).cast("double").alias("elo_difference"), (k % 9).alias("home_matches_played"), ((k * 3) % 11).alias("away_matches_played"),
        F.col("p_h").alias("market_home_probability"), F.col("p_d").alias("market_draw_probability"), F.col("p_a").alias("market_away_probability"))
    quotes = view(spark, sf, "v_odds").select("match_id", "bookmaker", "selection", "odds", F.col("quoted_at").cast("timestamp").alias("timestamp"))
    return predictions, known, quotes


def edges(spark, sf):
    return st.edge_dataset(*edge_inputs(spark, sf), bookmaker="B1")


def staged_edges(spark, sf):
    """For queries that split the seasons first: the join runs once."""
    return stage(edges(spark, sf), "edges")


@query(
    "s1_edge_dataset",
    EDGE_SQL + " SELECT match_id, pick, r6(mp) AS model_probability, r6(kp) AS market_probability, r6(edge) AS edge, r6(odds) AS odds, r6(profit) AS profit, gap AS absolute_elo_difference, CAST(experienced AS INT) AS experienced FROM ed",
)
def s1(spark, sf):
    return edges(spark, sf).select(
        "match_id", "pick", round6("model_probability").alias("model_probability"), round6("market_probability").alias("market_probability"), round6("edge").alias("edge"),
        round6("odds").alias("odds"), round6("profit").alias("profit"), "absolute_elo_difference", F.col("experienced").cast("int").alias("experienced"),
    )


@query("s2_pivot_prices", EDGE_SQL + " SELECT match_id, r6(oh) AS odds_H, r6(od) AS odds_D, r6(oa) AS odds_A FROM px")
def s2(spark, sf):
    predictions, _, quotes = edge_inputs(spark, sf)
    return r6s(st.prices_at_cutoff(predictions, quotes, "B1"), ["odds_H", "odds_D", "odds_A"])


RULE = st.Rule(0.45, 0.02, 50.0, "HA", True)


@query("s3_rule_filter", EDGE_SQL + " SELECT match_id, pick FROM ed WHERE mp >= 0.45e0 AND edge >= 0.02e0 AND gap >= 50 AND pick IN ('H', 'A') AND experienced")
def s3(spark, sf):
    return edges(spark, sf).filter(st.rule_condition(RULE)).select("match_id", "pick")


@query(
    "s4_bet_metrics",
    EDGE_SQL + " SELECT season, r6(avg(mll)) AS model_log_loss, r6(avg(kll)) AS market_log_loss, r6(avg(mll) - avg(kll)) AS log_loss_delta, r6(avg(mbr)) AS model_brier, r6(avg(kbr)) AS market_brier, r6(avg(mbr) - avg(kbr)) AS brier_delta FROM ed GROUP BY season",
)
def s4(spark, sf):
    return r6s(st.bet_metrics(edges(spark, sf), ["season"]), ["model_log_loss", "market_log_loss", "log_loss_delta", "model_brier", "market_brier", "brier_delta"])


GRID_SQL = """, ru AS (SELECT (((ci * 8 + ei) * 5 + gi) * 4 + pi) * 2 + xi AS rule_id, [0.0e0, 0.45e0, 0.50e0, 0.55e0, 0.60e0, 0.65e0, 0.70e0, 0.75e0][ci + 1] AS mc, [0.0e0, 0.01e0, 0.02e0, 0.03e0, 0.04e0, 0.05e0, 0.075e0, 0.10e0][ei + 1] AS me,
  [0.0e0, 50.0e0, 100.0e0, 150.0e0, 200.0e0][gi + 1] AS mg, ['HDA', 'HA', 'H', 'A'][pi + 1] AS picks, xi
  FROM (SELECT unnest(range(8)) AS ci) CROSS JOIN (SELECT unnest(range(8)) AS ei) CROSS JOIN (SELECT unnest(range(5)) AS gi) CROSS JOIN (SELECT unnest(range(4)) AS pi) CROSS JOIN (SELECT unnest(range(2)) AS xi)),
 di AS (SELECT * FROM ed WHERE season NOT IN (SELECT DISTINCT season FROM ed ORDER BY season DESC LIMIT 2)), ho AS (SELECT * FROM ed WHERE season IN (SELECT DISTINCT season FROM ed ORDER BY season DESC LIMIT 2)),
 rs AS (SELECT rule_id, mc, me, mg, picks, xi, count(*) AS bets, CAST(sum(CAST(profit AS DECIMAL(38,12))) AS DOUBLE) AS profit FROM ru JOIN di ON mp >= mc AND edge >= me AND gap >= mg AND contains(picks, pick) AND (xi = 0 OR experienced) GROUP BY ALL HAVING count(*) >= 200)"""


@query("s5_rule_search", EDGE_SQL + GRID_SQL + " SELECT rule_id, mc AS min_confidence, me AS min_edge, mg AS min_abs_elo, picks, xi AS require_experience, bets, r4(profit) AS profit, r4(profit / bets) AS roi FROM rs")
def s5(spark, sf):
    discovery, _, _ = st.split_seasons(staged_edges(spark, sf))
    out = st.search_rules(discovery).withColumn("require_experience", F.col("require_experience").cast("int"))
    return r6s(out, ["profit", "roi"], 4)


@query("t5_best_rule", EDGE_SQL + GRID_SQL + " SELECT rule_id, bets, r4(profit / bets) AS roi FROM rs ORDER BY round(profit / bets, 9) DESC, bets DESC, rule_id LIMIT 1")
def t5(spark, sf):
    discovery, _, _ = st.split_seasons(staged_edges(spark, sf))
    rules = st.search_rules(discovery).withColumn("roi", F.round("roi", 9))
    return st.best_rule(rules).select("rule_id", "bets", F.round("roi", 4).alias("roi"))


CELLS_SQL = """, cl AS (SELECT *, CASE WHEN mp >= 0.75e0 THEN 7 WHEN mp >= 0.70e0 THEN 6 WHEN mp >= 0.65e0 THEN 5 WHEN mp >= 0.60e0 THEN 4 WHEN mp >= 0.55e0 THEN 3 WHEN mp >= 0.50e0 THEN 2 WHEN mp >= 0.45e0 THEN 1 ELSE 0 END AS c,
 CASE WHEN edge >= 0.10e0 THEN 7 WHEN edge >= 0.075e0 THEN 6 WHEN edge >= 0.05e0 THEN 5 WHEN edge >= 0.04e0 THEN 4 WHEN edge >= 0.03e0 THEN 3 WHEN edge >= 0.02e0 THEN 2 WHEN edge >= 0.01e0 THEN 1 ELSE 0 END AS e,
 CASE WHEN gap >= 200 THEN 4 WHEN gap >= 150 THEN 3 WHEN gap >= 100 THEN 2 WHEN gap >= 50 THEN 1 ELSE 0 END AS g, CAST(experienced AS INT) AS x0 FROM di WHERE edge >= 0)"""


@query(
    "s6_rule_intervals",
    EDGE_SQL + GRID_SQL + CELLS_SQL + ", " + weights_sql("cl", "profit", "c, e, g, pick, x0,", 1000, 20260725) + """,
 cb AS (SELECT c, e, g, pick, x0, b, sum(w) AS sw, sum(w * x) AS sx FROM we GROUP BY ALL),
 rb AS (SELECT rule_id, b, sum(sx) / nullif(sum(sw), 0) AS m FROM (SELECT *, rule_id // 320 AS ci, (rule_id // 40) % 8 AS ei, (rule_id // 8) % 5 AS gi FROM ru) r JOIN cb ON c >= ci AND e >= ei AND g >= gi AND contains(picks, pick) AND x0 >= xi GROUP BY ALL)
 SELECT rule_id, r4(quantile_cont(m, 0.025)) AS discovery_ci_low, r4(quantile_cont(m, 0.975)) AS discovery_ci_high FROM rb GROUP BY rule_id""",
)
def s6(spark, sf):
    discovery, _, _ = st.split_seasons(staged_edges(spark, sf))
    return r6s(st.rule_intervals(discovery, key=int_key()), ["discovery_ci_low", "discovery_ci_high"], 4)


HELD = "hb AS (SELECT 'holdout' AS period, * FROM ho WHERE mp >= 0.45e0 AND edge >= 0.02e0 AND pick IN ('H', 'A') UNION ALL SELECT 'discovery', * FROM di WHERE mp >= 0.45e0 AND edge >= 0.02e0 AND pick IN ('H', 'A'))"
HELD_RULE = st.Rule(0.45, 0.02, 0.0, "HA", False)


def period_sql(by: str, source: str) -> str:
    return (
        weights_sql(source, "profit", f"{by},", 5000, 20260725)
        + f""", iv AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT {by}, b, sum(w * x) / nullif(sum(w), 0) AS m FROM we GROUP BY ALL) GROUP BY {by})
 SELECT h.{by}, count(*) AS bets, r4(sum(profit)) AS profit_units, r6(avg(profit)) AS roi, r6(max(lo)) AS ci_low, r6(max(hi)) AS ci_high, r6(avg(mll) - avg(kll)) AS log_loss_delta, r6(avg(mbr) - avg(kbr)) AS brier_delta
 FROM {source} h JOIN iv USING ({by}) GROUP BY h.{by}"""
    )


def held_bets(spark, sf):
    discovery, holdout, seasons = st.split_seasons(staged_edges(spark, sf))
    both = discovery.withColumn("period", F.lit("discovery")).unionByName(holdout.withColumn("period", F.lit("holdout")))
    return both.filter(st.rule_condition(HELD_RULE)), seasons


def summary_view(df, by):
    out = df.select(by, "bets", "profit_units", "roi", "ci_low", "ci_high", "log_loss_delta", "brier_delta")
    return r6s(out, ["roi", "ci_low", "ci_high", "log_loss_delta", "brier_delta"]).withColumn("profit_units", F.round("profit_units", 4))


@query("s7_period_summary", EDGE_SQL + GRID_SQL + ", " + HELD + ", " + period_sql("period", "hb"))
def s7(spark, sf):
    bets, _ = held_bets(spark, sf)
    return summary_view(st.period_summary(bets, ["period"], 5000, key=int_key()), "period")


@query("s8_season_stability", EDGE_SQL + GRID_SQL + ", " + HELD + ", hs AS (SELECT * FROM hb WHERE period = 'holdout'), " + period_sql("season", "hs"))
def s8(spark, sf):
    bets, _ = held_bets(spark, sf)
    return summary_view(st.period_summary(bets.filter("period = 'holdout'"), ["season"], 5000, key=int_key()), "season")


@query(
    "s9_promotion",
    EDGE_SQL + GRID_SQL + ", " + HELD + ", hs AS (SELECT * FROM hb WHERE period = 'holdout'), " + weights_sql("hs", "profit", "", 5000, 20260725)
    + """, iv AS (SELECT quantile_cont(m, 0.025) AS lo FROM (SELECT b, sum(w * x) / nullif(sum(w), 0) AS m FROM we GROUP BY b)), ss AS (SELECT season, avg(profit) AS r FROM hs GROUP BY season)
 SELECT count(*) AS bets, (SELECT count(*) FROM ss) AS seasons, CAST(count(*) > 0 AND max(lo) > 0 AND (avg(mll) < avg(kll) OR avg(mbr) < avg(kbr)) AND (SELECT count(*) FROM ss) = 2 AND (SELECT min(r) FROM ss) > 0 AS INT) AS promoted FROM hs JOIN iv ON true""",
)
def s9(spark, sf):
    bets, seasons = held_bets(spark, sf)
    summary = st.period_summary(bets, ["period"], 5000, key=int_key())
    stability = st.period_summary(bets.filter("period = 'holdout'"), ["season"], 5000, key=int_key())
    return st.promotion(summary, stability, seasons).select("bets", "seasons", F.col("promoted").cast("int").alias("promoted"))


@query(
    "j14_as_of_latest",
    """cu AS (SELECT DISTINCT user_id AS match_id, TIMESTAMP '2024-01-16 12:00:00' AS cutoff FROM events), ok AS (SELECT s.*, row_number() OVER (PARTITION BY s.match_id, s.selection ORDER BY s.quoted_at DESC, s.odds DESC) AS rn FROM v_snap s JOIN cu USING (match_id) WHERE quoted_at <= cutoff)
 SELECT match_id, selection, r6(odds) AS odds FROM ok WHERE rn = 1""",
)
def j14(spark, sf):
    quotes = view(spark, sf, "v_snap").withColumn("quoted_at", F.col("quoted_at").cast("timestamp"))
    probes = quotes.select("match_id").distinct().withColumn("cutoff", F.lit("2024-01-16 12:00:00").cast("timestamp"))
    out = as_of_latest(probes, quotes, ["match_id"], ["selection"], "cutoff", "quoted_at", ["odds"])
    return out.select("match_id", "selection", round6("odds").alias("odds"))

