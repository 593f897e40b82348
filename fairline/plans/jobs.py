"""Composite jobs: chains of operators from landed tables to end tables.

Each job takes DataFrames and returns DataFrames; nothing runs until they are read or written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import join_checked
from ..functions.names import strip_accents
from ..functions.scalars import natural_key_id
from ..operators import evaluate, history, market, players, quality, resolve, scores, strategy
from ..operators.resolve import load_lineups, matches_without
from ..session import lie_together, stage
from ..sources import feeds

Resolver = Callable[[DataFrame, DataFrame], DataFrame]


def load_seasons(raw: DataFrame, matches: DataFrame, mapping: DataFrame, odds: DataFrame, provider: str, batch: int) -> dict[str, DataFrame]:
    """Season files -> contract -> match identity -> price snapshots replacing earlier sets."""
    contract = feeds.season_matches(raw)
    valid = contract.filter("reason IS NULL")
    identity = resolve.upsert_matches(matches, mapping, valid, provider)
    known = identity["records"].select("provider_match_id", "match_id").distinct()
    triples = feeds.bookmaker_snapshots(valid.select("provider_match_id", *[c for c in raw.columns if c in valid.columns and c not in {"provider_match_id"}]), ["provider_match_id"])
    priced, _ = market.normalize_snapshots(
        triples.join(known, "provider_match_id"), {"H": "odds_h", "D": "odds_d", "A": "odds_a"}, ["match_id", "bookmaker", "market", "timing"])
    incoming = priced.withColumns({"provider": F.lit(provider), "timestamp": F.lit(None).cast("timestamp"), "batch": F.lit(batch)})
    stored = resolve.replace_snapshots(odds, incoming)
    summary = identity["records"].agg(F.count(F.lit(1)).alias("matches")).withColumn("odds_selections", incoming.agg(F.count(F.lit(1))).scalar())
    return {**identity, "odds": stored, "summary": summary, "quarantine": contract.filter("reason IS NOT NULL")}


def import_lineups(
    games: DataFrame,
    slots: DataFrame,
    canonical: DataFrame,
    resolver: Resolver,
    provider: str,
    stored: DataFrame,
    registry: DataFrame,
    memberships: DataFrame,
    done: DataFrame,
    player_id: Column | None = None,
) -> dict[str, DataFrame]:
    """Provider games and their player rows into canonical line-ups.

    ``games`` has external_id and what the resolver needs; ``slots`` external_id, side,
    provider_player_id, player_name, lineup_role and position.  Games in ``done`` are skipped; a
    game needs two elevens of distinct starters with positions; unresolved games are reported."""
    open_games = games.join(done.select("external_id"), "external_id", "left_anti")
    starter = F.col("lineup_role") == "starter"
    placed = F.count(F.when(starter & (F.coalesce(F.trim("position"), F.lit("")) != ""), 1))
    sides = slots.groupBy("external_id", "side").agg(
        F.count(F.when(starter, 1)).alias("n"), F.count_distinct(F.when(starter, F.col("provider_player_id"))).alias("ids"), placed.alias("placed"))
    complete = sides.filter("n = 11 AND ids = 11 AND placed = 11").groupBy("external_id").agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2").select("external_id")
    # narrow tables that several outputs start from: written once rather than derived for each
    complete = stage(complete, "complete")
    usable = stage(open_games.join(complete, "external_id", "left_semi"), "usable")
    found = stage(resolver(usable, canonical).filter("match_id IS NOT NULL").select("external_id", "match_id"), "resolved")
    teams = canonical.select("match_id", F.col("match_date").alias("match_day"), F.inline(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id")), F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id")))))
    side_key = F.concat_ws("|", F.col("external_id").cast("string"), F.col("side"))
    mapped = found.join(teams, "match_id").select("external_id", "match_day", side_key.alias("provider_team_id"), "team_id")
    days = found.join(canonical.select("match_id", F.col("match_date").alias("match_day")), "match_id").select("external_id", "match_day")
    incoming = slots.join(days, "external_id").select(
        F.col("external_id").alias("provider_match_id"), side_key.alias("provider_team_id"), "provider_player_id", "player_name", "lineup_role", "position", "match_day")
    made = natural_key_id(F.lit(provider), "provider_player_id") if player_id is None else player_id
    loaded = load_lineups(
        stored, incoming, found.withColumnRenamed("external_id", "provider_match_id"), mapped.select("provider_team_id", "team_id"), registry, memberships, provider, made)
    status = games.select("external_id").join(done.select("external_id", F.lit(True).alias("_done")).distinct(), "external_id", "left")
    status = status.join(complete.withColumn("_complete", F.lit(True)), "external_id", "left").join(found, "external_id", "left")
    label = (
        F.when(F.col("_done"), "already_imported").when(F.col("_complete").isNull(), "incomplete_lineup").when(F.col("match_id").isNull(), "unresolved").otherwise("imported")
    )
    return {**loaded, "mapping": found, "status": status.select("external_id", label.alias("status"), "match_id")}


def coordinate_slots(wide: DataFrame) -> DataFrame:
    """Elevens with tactical coordinates: the role follows from depth."""
    rows = feeds.wide_eleven(wide, ["external_id"], "coordinates").filter("player_id IS NOT NULL")
    return rows.select(
        "external_id", "side", F.col("player_id").alias("provider_player_id"), F.col("player_id").alias("player_name"), F.lit("starter").alias("lineup_role"), feeds.role_from_depth("y").alias("position"))


def named_slots(wide: DataFrame, known_roles: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, quarantine) for elevens listed by name: the modal role of the name, else its slot's.

    A name seen with several teams is ambiguous; games listing one are quarantined."""
    rows = feeds.wide_eleven(wide, ["external_id"], "named_slots").filter("player_name IS NOT NULL AND trim(player_name) <> ''")
    rows = rows.withColumn("key", strip_accents(F.trim("player_name"))).join(teams, ["external_id", "side"])
    _, doubtful = quality.ambiguous_identities(rows, "key", "team")
    tainted = doubtful.select("external_id").distinct()
    fine = rows.join(tainted, "external_id", "left_anti").join(known_roles.select(F.col("key"), F.col("role").alias("_known")), "key", "left")
    slots = fine.select(
        "external_id", "side", F.col("key").alias("provider_player_id"), "player_name", F.lit("starter").alias("lineup_role"),
        F.coalesce("_known", feeds.role_from_slot("slot")).alias("position"), F.when(F.col("_known").isNotNull(), "history").otherwise("slot").alias("method"))
    return slots, doubtful.select("external_id", "side", "player_name", F.lit("ambiguous_player_identity").alias("reason"))


def create_or_unresolved(status: DataFrame, games: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Unresolved games may create a match only where the league-season has nothing left to map."""
    gated = status.join(games.select("external_id", "league", "season"), "external_id").join(unmapped, ["league", "season"], "left")
    action = F.when(F.col("status") != "unresolved", F.col("status")).when(F.col("unmapped").isNull(), "create").otherwise("unresolved")
    return gated.select("external_id", "league", "season", action.alias("status"))


def external_slots(lineups: DataFrame, appearances: DataFrame, substitutions: DataFrame, positions: DataFrame) -> DataFrame:
    """Listed starters; sides without exactly eleven are rebuilt from appearances and substitutions."""
    listed = lie_together(lineups.filter("type = 'starting_lineup'").select("game_id", "club_id", "player_id", "position"), "game_id")
    full = listed.groupBy("game_id", "club_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 11").select("game_id", "club_id")
    kept = listed.join(full, ["game_id", "club_id"], "left_semi").select("game_id", "club_id", "player_id", "position", F.concat(F.lit("reported:"), "position").alias("formation_grid"))
    missing = appearances.join(full, ["game_id", "club_id"], "left_anti")
    rebuilt = resolve.rebuild_starters(missing, substitutions, positions).select("game_id", "club_id", "player_id", "position", "formation_grid")
    return kept.unionByName(rebuilt)


def gap_targets(games: DataFrame, canonical: DataFrame, sides: DataFrame, stored: DataFrame) -> DataFrame:
    """Canonical matches that still lack a complete eleven, and only the games near those days."""
    return canonical.join(resolve.lacking_complete_eleven(sides, stored), "match_id", "left_semi")


def report_slots(reports: DataFrame) -> DataFrame:
    """Player rows of valid nested reports."""
    rows = feeds.report_players(reports.filter(quality.report_is_valid()))
    return rows.select(
        F.col("id").alias("external_id"), "side", strip_accents("player_name").alias("provider_player_id"), "player_name", F.lit("starter").alias("lineup_role"), F.col("role").alias("position"))


def roster_slots(rosters: DataFrame) -> DataFrame:
    rows = feeds.roster_players(rosters, ["external_id", "side"])
    return rows.select("external_id", "side", F.col("player_id").cast("string").alias("provider_player_id"), "player_name", "lineup_role", "position")


def feed_slots(lineups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(player rows, timing rows) of feed line-ups."""
    rows = feeds.feed_players(lineups, ["external_id"])
    slots = rows.select(
        "external_id", "side", F.col("player_id").alias("provider_player_id"), F.col("player").alias("player_name"),
        F.when(F.col("lineup_role") == "starter", "starter").otherwise("substitute").alias("lineup_role"), F.col("role").alias("position"))
    timing = rows.select("external_id", "side", F.col("player_id").alias("provider_player_id"), "minute_in", "minute_out", F.col("minutes_estimated").alias("minutes_played"))
    return slots, timing


def reconcile_summary(fixtures: DataFrame) -> DataFrame:
    """Reconciled fixtures counted by league and status."""
    return fixtures.groupBy("league", "status").agg(F.count(F.lit(1)).alias("fixtures"))


def cutoff_snapshot_with_manifest(series: DataFrame, canonical: DataFrame, source: DataFrame, bookmakers: Sequence[str]) -> dict[str, DataFrame]:
    """Similarity reconciliation -> prices one hour before kickoff -> one-row manifest and quarantine."""
    accepted, doubtful, _ = resolve.reconcile_by_similarity(canonical, source)
    mapped = accepted.join(source.select("source_id", "kickoff"), "source_id")
    rows = feeds.cutoff_snapshot(series, mapped, bookmakers)
    complete = quality.complete_markets(rows).agg(F.count(F.lit(1))).scalar()
    manifest = rows.agg(F.count_distinct("match_id").alias("canonical_matches_reconciled"), F.count(F.lit(1)).alias("rows"))
    manifest = manifest.withColumns({"complete_match_bookmaker_markets": complete, "quarantined_mappings": doubtful.agg(F.count(F.lit(1))).scalar()})
    return {"rows": rows, "manifest": manifest, "quarantine": doubtful}


def attach_weather(matches: DataFrame, weather: DataFrame, hourly: DataFrame) -> DataFrame:
    """Matches without weather get the landed hourly reading nearest to kickoff."""
    missing = matches_without(matches.select("match_id", "kickoff"), weather)
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temperature_c"), F.col("hourly.precipitation").alias("precipitation_mm"), F.col("hourly.wind_speed_10m").alias("wind_kph"))
    readings = hourly.select("match_id", F.explode(zipped).alias("h")).select(
        "match_id", F.try_to_timestamp("h.time").alias("observed_at"), "h.temperature_c", "h.precipitation_mm", "h.wind_kph")
    near = resolve.nearest_in_time(missing, readings, ["match_id"], "kickoff", "observed_at", ["temperature_c", "precipitation_mm", "wind_kph"])
    return weather.unionByName(near.drop("kickoff"), allowMissingColumns=True)


def ready_dataset(matches: DataFrame, stored: DataFrame, priority: Sequence[str], warmup: Sequence[str]) -> dict[str, DataFrame]:
    """Completeness -> choice -> gate -> coverage, reasons and raw census."""
    chosen = quality.choose_lineups(quality.lineup_completeness(stored), priority)
    ready, rejected = quality.ready_set(matches, chosen, stored, warmup)
    return {
        "ready": ready, "quarantine": rejected, "reasons": quality.reason_counts(rejected), "census": quality.raw_census(stored),
        "coverage": quality.coverage(matches.filter(~F.col("season").isin(*warmup)), ready),
    }


def player_feature_store(facts: DataFrame, match_map: DataFrame, player_map: DataFrame, team_map: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Merged facts -> internal ids -> temporal matrix and census."""
    good, bad = resolve.translate_ids(facts, match_map, player_map, team_map)
    observations = good.join(matches.select("match_id", F.col("date").alias("kickoff"), "league", "season"), "match_id").select(
        "match_id", "kickoff", "league", "season", "team_id", F.col("internal_player_id").alias("player_id"), "lineup_role", "minutes_played", "minute_in", "minute_out",
        "position_original", F.lower(players.department("position_original")).alias("position_normalized"), F.lit("reported").alias("source"), F.col("statistics").isNotNull().alias("has_statistics"))
    census = quality.not_null_census(observations, ["minutes_played", "minute_in", "minute_out", "position_original"], ["source", "league", "season"])
    return {"matrix": players.temporal_player_matrix(observations), "census": census, "quarantine": bad}


def attach_lineup_aggregates(features: DataFrame, matches: DataFrame, lineups: DataFrame, lookback: int = 10) -> DataFrame:
    return join_checked(features, players.prematch_player_features(matches, lineups, lookback), ["match_id"], "left")


def evaluate_candidates(
    matches: DataFrame, slots: DataFrame, rates: DataFrame, store: DataFrame, features: Sequence[str], ablations: Sequence[str] = scores.ABLATIONS,
    learners: Sequence[str] = ("boosting", "linear"), max_iter: int = 100,
) -> dict[str, DataFrame]:
    """Gates -> history vectors with store columns -> reliability and pools -> walk-forward folds of
    every learner and ablation -> season metrics."""
    checks = quality.contract_checks(matches, ["match_id", "date", "season", "league", "home_goals", "away_goals", "result"], ["match_id"], {"result": ["H", "D", "A"]})
    if not checks.filter("status = 'FAIL'").isEmpty():
        raise ValueError("preflight failed; no model is fitted")
    vectors = players.attach_store(players.player_history_vectors(slots), store)
    vectors = stage(vectors, "vectors")
    reliability = stage(players.reliability(vectors), "reliability")
    pooled = players.pool_players(vectors, features).join(matches.select("match_id", "season", "league", "result", "home_goals", "away_goals"), "match_id")
    pooled, rates = stage(pooled, "pooled"), stage(rates, "rates")
    columns = [c for c in pooled.columns if c.startswith(("home_starter", "away_starter", "difference_", "home_bench", "away_bench"))]
    predictions = []
    for learner in learners:
        for ablation in ablations:
            _, part = scores.walk_forward_residuals(pooled, rates, reliability, columns, ablation, learner, f"score_model_{learner}", max_iter=max_iter)
            predictions.append(part.withColumn("model", F.concat_ws("/", "model", "feature_ablation")))
    everything = reduce(DataFrame.unionByName, predictions)
    return {"checks": checks, "predictions": everything, "metrics": evaluate.metrics_by_season(everything)}


def base_rate_predictions(rates: DataFrame, matches: DataFrame, model: str = "score_model") -> DataFrame:
    scored = scores.score_probabilities(rates.join(matches.select("match_id", "league", "result"), "match_id"))
    return scored.select("match_id", "season", "league", "result", F.lit(model).alias("model"), "probability_home", "probability_draw", "probability_away")


def compare_references(candidate: DataFrame, references: dict[str, DataFrame], samples: int = 2000, key: Column | None = None) -> dict[str, DataFrame]:
    """Candidate against every reference on the matches all of them predict."""
    frames = evaluate.common_matches([candidate, *references.values()])
    columns = ["match_id", "season", "league", "result", "model", "probability_home", "probability_draw", "probability_away"]
    together = reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])
    by_season = evaluate.metrics_by_season(together)
    evidence = [
        evaluate.paired_log_loss_bootstrap(frames[0], frame, samples, key=key).withColumn("reference", F.lit(name)) for name, frame in zip(references, frames[1:], strict=True)
    ]
    return {"by_season": by_season, "means": evaluate.weighted_model_means(by_season), "evidence": reduce(DataFrame.unionByName, evidence)}


def edge_research(predictions: DataFrame, features: DataFrame, quotes: DataFrame, bookmaker: str, minimum_bets: int = 200, samples: int = 5000, key: Column | None = None):
    return strategy.discover_edges(strategy.edge_dataset(predictions, features, quotes, bookmaker), None, minimum_bets, samples, key)


def match_features(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """Canonical matches with closing probabilities, ratings and form: the table models train on."""
    return history.build_prematch_features(history.canonical_matches(matches, odds))
