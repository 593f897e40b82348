"""Entity resolution: keys, maps, tolerant dates, fuzzy names - and no guessing.

Every resolver returns a status or a reason for the rows it does not resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ROUNDING, closest_pairs, common_letters_ratio, compact_key, indel_by_places, letter_places, letter_tokens, likely_pairs, team_key, token_key
from ..functions.scalars import natural_key_id
from ..functions.temporal import keep_latest
from ..session import lie_together, stage


def register_names(existing: DataFrame, names: DataFrame, name: str, key: str, kind: str) -> DataFrame:
    """Get-or-create a dimension: known rows stay, new names get an id derived from the name."""
    new = names.select(name).filter(F.col(name).isNotNull()).distinct().join(existing.select(name), name, "left_anti")
    return existing.select(key, name).unionByName(new.select(natural_key_id(F.lit(kind), name).alias(key), name))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, newest wins; a row of the incoming batch replaces the stored one whole."""
    newest = keep_latest(incoming, keys, [F.col(c) for c in order])
    return existing.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest, allowMissingColumns=True)


def upsert_matches(matches: DataFrame, mapping: DataFrame, incoming: DataFrame, provider: str) -> dict[str, DataFrame]:
    """Identify records by the provider's map, else by (day, league, sides), else create the match.

    Returns ``records`` (with match_id and how it was found), ``matches`` and ``mapping``.  A new match's id is its natural key: 24 hex
    digits, or a number made of the first fifteen where ``match_id`` is BIGINT; narrower ids cannot hold one and fail."""
    natural = ["day", "league", "home_team", "away_team"]
    records = incoming.withColumn("day", F.to_date("date"))
    mine = mapping.filter(F.col("provider") == provider).select("provider_match_id", F.col("match_id").alias("_mapped"))
    known = matches.select(F.to_date("date").alias("day"), "league", "home_team", "away_team", F.col("match_id").alias("_natural"))
    found = records.join(mine, "provider_match_id", "left").join(known, natural, "left")
    created = natural_key_id(*[F.col(c) for c in natural])
    id_type = matches.schema["match_id"].dataType
    if isinstance(id_type, T.IntegralType):
        # fifteen hex digits of the key always fit a BIGINT
        created = F.conv(F.substring(created, 1, 15), 16, 10)
    found = found.withColumn("match_id", F.coalesce("_mapped", "_natural", created.cast(id_type)))
    found = found.withColumn("method", F.when(F.col("_mapped").isNotNull(), "mapped").when(F.col("_natural").isNotNull(), "natural_key").otherwise("created"))
    found = found.drop("_mapped", "_natural")
    new = keep_latest(found.filter("method = 'created'"), ["match_id"], [F.col("provider_match_id")], first=True)
    columns = ["match_id", "date", "league", "home_team", "away_team"]
    fresh = found.filter("method <> 'mapped'").select(F.lit(provider).alias("provider"), "provider_match_id", "match_id").distinct()
    return {
        "records": found,
        "matches": matches.select(*columns).unionByName(new.select(*columns)),
        "mapping": mapping.select("provider", "provider_match_id", "match_id").unionByName(fresh),
    }


def replace_snapshots(existing: DataFrame, incoming: DataFrame, batch: str = "batch") -> DataFrame:
    """Opening and closing sets replace the earlier set of the same market; ``snapshot`` rows
    accumulate and only the same timestamp replaces itself.  A NULL timestamp equals itself."""
    stamp = F.when(F.col("timing") == "snapshot", F.coalesce(F.col("timestamp").cast("string"), F.lit(""))).otherwise("*")
    keys = ["match_id", "bookmaker", "provider", "market", "timing", "_stamp"]
    marked = incoming.withColumn("_stamp", stamp)
    newest = marked.groupBy(*keys).agg(F.max(batch).alias(batch))
    kept = marked.join(newest, [*keys, batch], "left_semi")
    untouched = existing.withColumn("_stamp", stamp).join(newest.select(*keys), keys, "left_anti")
    return untouched.unionByName(kept, allowMissingColumns=True).drop("_stamp")


def resolve_teams(provider_teams: DataFrame, teams: DataFrame, team_map: DataFrame | None = None) -> DataFrame:
    """Provider team -> canonical team of its league by normalised name, only when exactly one fits."""
    candidates = teams.select("league", "team_id", "team_name").distinct().withColumn("_key", token_key("team_name"))
    unique = candidates.groupBy("league", "_key").agg(F.count(F.lit(1)).alias("candidates"), F.min("team_id").alias("_by_name"))
    out = provider_teams.withColumn("_key", token_key("provider_team_name")).join(unique, ["league", "_key"], "left")
    if team_map is not None:
        out = out.join(team_map.select("provider_team_id", F.col("team_id").alias("_by_map")), "provider_team_id", "left")
    else:
        out = out.withColumn("_by_map", F.lit(None).cast(teams.schema["team_id"].dataType))
    named = F.when(F.col("candidates") == 1, F.col("_by_name"))
    return out.withColumn("team_id", F.coalesce("_by_map", named)).withColumn(
        "method", F.when(F.col("_by_map").isNotNull(), "mapped").when(named.isNotNull(), "normalized_exact").otherwise("unresolved")
    ).drop("_key", "_by_name", "_by_map", "candidates")


def reconcile_fixtures(fixtures: DataFrame, leagues: DataFrame, matches: DataFrame, mapping: DataFrame, team_map: DataFrame | None = None) -> DataFrame:
    """Each provider fixture with its status and, when mapped, the canonical match.

    Order of reasons: unsupported_league, already_mapped, team_unresolved, match_not_found,
    match_not_unique, mapped."""
    base = fixtures.join(leagues.select("provider_league_id", "league"), "provider_league_id", "left")
    base = base.join(mapping.select("fixture_id", F.col("match_id").alias("_known")), "fixture_id", "left")
    teams = matches.select("league", F.col("home_team_id").alias("team_id"), F.col("home_team").alias("team_name")).unionByName(
        matches.select("league", F.col("away_team_id").alias("team_id"), F.col("away_team").alias("team_name"))
    )
    listed = base.select("league", F.inline(F.array(
        F.struct(F.col("home_provider_id").alias("provider_team_id"), F.col("home_name").alias("provider_team_name")),
        F.struct(F.col("away_provider_id").alias("provider_team_id"), F.col("away_name").alias("provider_team_name")),
    ))).filter("league IS NOT NULL").distinct()
    # a team may be listed under several spellings: any may resolve it, but they must agree
    resolved = resolve_teams(listed, teams, team_map).groupBy("league", "provider_team_id").agg(
        F.when(F.min("team_id") == F.max("team_id"), F.min("team_id")).alias("team_id")
    )
    for side in ("home", "away"):
        part = resolved.select("league", F.col("provider_team_id").alias(f"{side}_provider_id"), F.col("team_id").alias(f"{side}_team_id"))
        base = base.join(part, ["league", f"{side}_provider_id"], "left")
    keys = ["league", "day", "home_team_id", "away_team_id"]
    hits = matches.withColumn("day", F.to_date("date")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"), F.min("match_id").alias("_match"))
    out = base.withColumn("day", F.to_date("date")).join(hits, keys, "left")
    status = (
        F.when(F.col("league").isNull(), "unsupported_league").when(F.col("_known").isNotNull(), "already_mapped")
        .when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), "team_unresolved")
        .when(F.col("_hits").isNull(), "match_not_found").when(F.col("_hits") > 1, "match_not_unique").otherwise("mapped")
    )
    out = out.withColumn("status", status)
    match = F.when(F.col("status") == "mapped", F.col("_match")).when(F.col("status") == "already_mapped", F.col("_known"))
    return out.select("fixture_id", "league", "status", match.alias("match_id"))


def near_days(df: DataFrame, day: str = "match_date", days: int = 1) -> DataFrame:
    """Copy each row to the days around it, so a +-1 day interval becomes an equality join."""
    offsets = F.array(*[F.lit(d) for d in range(-days, days + 1)])
    return df.withColumn("_offset", F.explode(offsets)).withColumn("_day", F.date_add(day, F.col("_offset"))).drop("_offset")


def unique_within_days(external: DataFrame, canonical: DataFrame, keys: Sequence[str], external_id: str = "external_id") -> DataFrame:
    """(external_id, match_id) where exactly one canonical match has the keys within one day."""
    probe = near_days(external).select(external_id, "_day", *keys)
    target = canonical.select("match_id", F.col("match_date").alias("_day"), *keys)
    hits = probe.join(target, [*keys, "_day"]).groupBy(external_id).agg(F.count(F.lit(1)).alias("_n"), F.min("match_id").alias("match_id"))
    return hits.filter("_n = 1").drop("_n")


def by_team_ids(external: DataFrame, canonical: DataFrame) -> DataFrame:
    """Team ids and score within one day, one hit."""
    return unique_within_days(external, canonical, ["league", "home_team_id", "away_team_id", "home_goals", "away_goals"])


def by_team_date(external: DataFrame, canonical: DataFrame) -> DataFrame:
    """Team ids within one day, one hit; the score may differ and is reported."""
    found = unique_within_days(external, canonical, ["league", "home_team_id", "away_team_id"])
    goals = canonical.select("match_id", F.col("home_goals").alias("_h"), F.col("away_goals").alias("_a"))
    both = found.join(external.select("external_id", "home_goals", "away_goals"), "external_id").join(goals, "match_id")
    return both.select("external_id", "match_id", ((F.col("home_goals") != F.col("_h")) | (F.col("away_goals") != F.col("_a"))).alias("score_differs"))


def best_and_runner_up(scored: DataFrame, key: str, score: str, candidate: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: best candidate, its score and the runner-up's score (NULL if alone).

    The two best rows of a key are found in each task first and merged after the shuffle, so a key's candidates never meet as a whole."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(candidate))
    top = scored.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2")
    fields = [score, candidate, *carry]
    return top.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct(*fields))).alias("_best"), F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("runner_up")
    ).select(key, *[F.col(f"_best.{f}").alias(f) for f in fields], "runner_up")


def _with_names(rows: DataFrame, ids: Sequence[str], key, names: dict[str, str], places: bool = False) -> DataFrame:
    """``ids``, the keys of the named columns and what the bounds need: made once a row, before rows meet in pairs."""
    out = rows.select(*ids, *[key(column).alias(name) for name, column in names.items()])
    out = out.withColumns({f"{name}_tokens": letter_tokens(name) for name in names})
    return out.withColumns({f"{name}_places": letter_places(name) for name in names}) if places else out


def name_candidates(external: DataFrame, canonical: DataFrame, least: float) -> DataFrame:
    """(external_id, match_id, _eh, _ch, _ea, _ca): same league and score within one day, as far as the letters that home and away
    names share let the two ratios sum to ``least``."""
    block = ["league", "home_goals", "away_goals"]
    left = _with_names(near_days(external), ["external_id", "_day", *block], team_key, {"_eh": "home_name", "_ea": "away_name"})
    right = _with_names(canonical.withColumn("_day", F.col("match_date")), ["match_id", "_day", *block], team_key, {"_ch": "home_name", "_ca": "away_name"})
    most = common_letters_ratio("_eh_tokens", "_ch_tokens") + common_letters_ratio("_ea_tokens", "_ca_tokens")
    return left.join(right, [*block, "_day"]).filter(most >= least - ROUNDING).select("external_id", "match_id", "_eh", "_ch", "_ea", "_ca")


def met_names(external: DataFrame, canonical: DataFrame, name: str = "home_name") -> DataFrame:
    """(_eh, _ch), each once: the keys of the names that meet, same league and score within one day, whatever their letters.

    A name stands once in its block, not once a fixture, and no bound is computed, as none would drop a pair."""
    block = ["league", "home_goals", "away_goals", "_day"]
    named = "home_name IS NOT NULL AND away_name IS NOT NULL"
    left = near_days(external.filter(named)).select(*block, team_key(name).alias("_eh")).distinct()
    right = canonical.filter(named).withColumn("_day", F.col("match_date")).select(*block, team_key(name).alias("_ch")).distinct()
    return left.join(right, block).select("_eh", "_ch").distinct()


def _met_lists(left: DataFrame, right: DataFrame, block: Sequence[str], left_fields: Sequence[str], right_fields: Sequence[str]) -> DataFrame:
    """(_left, _right) per block that both sides have: the lists of its rows' fields and the names ``_h`` and ``_a``; rows without one meet nothing.

    Blocks are dealt out by number, as their work is no matter of their bytes."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lists(rows: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
        known = " AND ".join(f"{c} IS NOT NULL" for c in [*block, "_h", "_a"])
        return rows.filter(known).repartition(parts, *block).groupBy(*block).agg(F.collect_list(F.struct(*fields, "_h", "_a")).alias(name))

    return lists(left, "_left", left_fields).join(lists(right, "_right", right_fields), list(block)).select("_left", "_right")


def by_similar_names(external: DataFrame, canonical: DataFrame, threshold: float = 1.20, gap: float = 0.20) -> DataFrame:
    """Same league and score within one day, then names: accepted when the two ratios sum to the
    threshold and lead the runner-up by the gap.

    A block's rows move, not its pairs: each side is one list per (league, score, day), and the lists meet in one row.  There a fixture's candidates
    are compared from the most promising by common letters on, as far as one may still be the answer or a runner-up in reach of it; what
    is accepted does not change."""
    block = ["league", "home_goals", "away_goals", "_day"]
    keys = [team_key("home_name").alias("_h"), team_key("away_name").alias("_a")]
    # an id that stands once is settled where its candidates are, others need the candidates of all their rows
    once = F.count(F.lit(1)).over(Window.partitionBy("external_id")) == 1
    left = external.select("external_id", F.col("match_date").alias("_day"), *block[:3], *keys).withColumn("_once", once)
    right = near_days(canonical.select("match_id", "match_date", *block[:3], *keys))
    met = _met_lists(left, right, block, ["external_id", "_once"], ["match_id"])
    best = best_and_runner_up(likely_pairs(met, "external_id", "match_id", threshold, gap), "external_id", "score", "match_id")
    accepted = (F.col("score") >= threshold) & (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= gap))
    return best.filter(accepted).select("external_id", "match_id", "score")


def resolve_waterfall(external: DataFrame, canonical: DataFrame) -> DataFrame:
    """Team ids and score, else team ids and day, else names; the first answer counts."""
    exact = by_team_ids(external, canonical).select("external_id", F.col("match_id").alias("_1"))
    loose = by_team_date(external, canonical).select("external_id", F.col("match_id").alias("_2"), "score_differs")
    left = stage(external.join(exact, "external_id", "left").join(loose, "external_id", "left"), "waterfall")
    # only rows the cheap steps left open reach the name comparison
    open_rows = left.filter("_1 IS NULL AND _2 IS NULL").select(*external.columns)
    names = by_similar_names(open_rows, canonical).select("external_id", F.col("match_id").alias("_3"))
    out = left.join(names, "external_id", "left")
    method = F.when(F.col("_1").isNotNull(), "ids_and_score").when(F.col("_2").isNotNull(), "ids_and_day").when(F.col("_3").isNotNull(), "names").otherwise("unresolved")
    return out.select("external_id", F.coalesce("_1", "_2", "_3").alias("match_id"), method.alias("method"),
                      (F.col("_1").isNull() & F.coalesce("score_differs", F.lit(False))).alias("score_differs"))


#: Rows of its block that a row may find on average for the block's pairs to be made as rows.
CROWD = 16


def _crowded(rows: DataFrame, block: Sequence[str]) -> bool:
    blocks = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in block)).groupBy(*block).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return (blocks.agg(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n")).alias("mean")).first()["mean"] or 0.0) > CROWD


def _closest_of_crowds(canonical: DataFrame, source: DataFrame, block: Sequence[str]) -> DataFrame:
    """(match_id, source_id, home_similarity, away_similarity) of each row's best two: rows meet as two lists per block, so no pair is a row."""
    keys = [compact_key("home_name").alias("_h"), compact_key("away_name").alias("_a")]
    left, right = canonical.select("match_id", *block, *keys), source.select("source_id", *block, *keys)
    return closest_pairs(_met_lists(left, right, block, ["match_id"], ["source_id"]), "match_id", "source_id")


def _closest_of_few(canonical: DataFrame, source: DataFrame, block: Sequence[str]) -> DataFrame:
    """(match_id, source_id, home_similarity, away_similarity) of all pairs that may be among a match's best two."""
    left = _with_names(canonical, ["match_id", *block], compact_key, {"_ch": "home_name", "_ca": "away_name"}, places=True)
    right = _with_names(source, ["source_id", *block], compact_key, {"_sh": "home_name", "_sa": "away_name"})
    home, away = (indel_by_places(f"_c{x}", f"_c{x}_places", f"_s{x}") for x in "ha")
    most = 50.0 * (common_letters_ratio("_ch_tokens", "_sh_tokens") + common_letters_ratio("_ca_tokens", "_sa_tokens"))
    # The two most promising candidates are compared first; others only as far as they may still pass the weaker of the two.
    # Pairs meet by block, so windows that begin with it need no second shuffle; the bound of a block holds for a match in several, too.
    mine = Window.partitionBy(*block, "match_id")
    pairs = left.join(right, block).withColumn("_most", most)
    pairs = pairs.withColumn("_at", F.row_number().over(mine.orderBy(F.col("_most").desc(), F.col("source_id"))))
    pairs = pairs.withColumn("_weaker", F.min(F.when(F.col("_at") <= 2, (home + away) / 2)).over(mine)).filter(F.col("_most") >= F.col("_weaker") - ROUNDING)
    return pairs.select("match_id", "source_id", home.alias("home_similarity"), away.alias("away_similarity"))


def reconcile_by_similarity(canonical: DataFrame, source: DataFrame, accept: float = 78.0, weakest: float = 65.0, lead: float = 8.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, quarantined, dropped) best source match of the same day and score per canonical match.

    Only candidates that may be among a match's best two are compared; the margin stays exact.  Accepted: mean similarity, weaker side and lead over the runner-up all reach their bounds (a
    sole candidate leads by 100).  Other best candidates from ``weakest`` up are quarantined."""
    block = ["match_date", "home_goals", "away_goals"]
    pairs = (_closest_of_crowds if _crowded(canonical, block) else _closest_of_few)(canonical, source, block)
    pairs = pairs.withColumn("mean_similarity", (F.col("home_similarity") + F.col("away_similarity")) / 2)
    details = best_and_runner_up(pairs, "match_id", "mean_similarity", "source_id", ["home_similarity", "away_similarity"])
    details = details.withColumn("runner_up_margin", F.when(F.col("runner_up").isNull(), 100.0).otherwise(F.col("mean_similarity") - F.col("runner_up"))).drop("runner_up")
    # one row per canonical match; three results start from it
    details = stage(details, "similarity")
    good = (F.col("mean_similarity") >= accept) & (F.least("home_similarity", "away_similarity") >= weakest) & (F.col("runner_up_margin") >= lead)
    doubtful = ~good & (F.col("mean_similarity") >= weakest)
    return (
        details.filter(good), details.filter(doubtful).withColumn("reason", F.lit("ambiguous_or_below_threshold")), details.filter(~good & ~doubtful)
    )


def by_name_key(external: DataFrame, canonical: DataFrame, key=token_key) -> DataFrame:
    """Exact (day, home key, away key); NULL match_id marks the unresolved ones."""
    right = canonical.select("match_id", "match_date", key("home_name").alias("_h"), key("away_name").alias("_a"))
    right = keep_latest(right, ["match_date", "_h", "_a"], [F.col("match_id")])
    left = external.select("external_id", "match_date", key("home_name").alias("_h"), key("away_name").alias("_a"))
    return left.join(right, ["match_date", "_h", "_a"], "left").select("external_id", "match_id")


def nearest_in_time(probes: DataFrame, readings: DataFrame, on: Sequence[str], at: str, reading_at: str, values: Sequence[str]) -> DataFrame:
    """Reading closest to each probe's time; the earlier one wins a tie."""
    distance = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(reading_at).cast("timestamp")))
    packed = F.struct(reading_at, *values)
    found = probes.join(readings, list(on)).groupBy(*on, at).agg(F.min_by(packed, F.struct(distance, F.col(reading_at))).alias("_r"))
    return found.select(*on, at, *[F.col(f"_r.{c}").alias(c) for c in (reading_at, *values)])


def teams_without_venue(teams: DataFrame, venues: DataFrame) -> DataFrame:
    return teams.join(venues.filter("resolved").select("team_id"), "team_id", "left_anti")


def matches_without(matches: DataFrame, facts: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    return matches.join(facts.select(*keys), list(keys), "left_anti")


def lacking_complete_eleven(sides: DataFrame, players: DataFrame) -> DataFrame:
    """Matches where a side has no line-up of eleven starters who all have a position."""
    blank = (F.coalesce(F.trim("position"), F.lit("")) == "").cast("int")
    complete = players.filter("lineup_role = 'starter'").groupBy("match_id", "team", "lineup_id").agg(F.count(F.lit(1)).alias("n"), F.sum(blank).alias("blank"))
    complete = complete.filter("n = 11 AND blank = 0").select("match_id", "team")
    return sides.join(complete, ["match_id", "team"], "left_anti").select("match_id").distinct()


def merge_player_facts(lineups: DataFrame, appearances: DataFrame, substitutions: DataFrame) -> DataFrame:
    """One row per (game, player): line-up facts and appearances, outer-joined, with the minutes a
    substitution gives the outgoing and the incoming player (the last event of a player counts)."""
    key = ["game_id", "player_id"]
    listed = lineups.select(
        *key, F.col("club_id").alias("_lc"), F.when(F.col("type") == "starting_lineup", "starter").otherwise("bench").alias("lineup_role"),
        F.col("position").alias("position_original"), "number", F.lit(True).alias("bench_available"),
    )
    played = appearances.select(*key, F.col("club_id").alias("_ac"), F.col("minutes_played").cast("double").alias("minutes_played"), "statistics")
    leaving = substitutions.filter("player_id IS NOT NULL").groupBy(*key).agg(F.max_by("minute", F.struct("event_id")).cast("double").alias("minute_out"))
    entering = substitutions.filter("player_in_id IS NOT NULL").groupBy("game_id", F.col("player_in_id").alias("player_id")).agg(
        F.max_by("minute", F.struct("event_id")).cast("double").alias("minute_in"))
    facts = listed.join(played, key, "full_outer").withColumn("club_id", F.coalesce("_lc", "_ac")).drop("_lc", "_ac")
    facts = facts.join(leaving, key, "left").join(entering, key, "left")
    return facts.withColumn("substitution_exit", F.col("minute_out").isNotNull()).withColumn("substitution_entry", F.col("minute_in").isNotNull())


def translate_ids(facts: DataFrame, match_map: DataFrame, player_map: DataFrame, team_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, quarantine): external ids become internal, rows without a map are dropped,
    an entry after the exit is quarantined."""
    known = facts.join(match_map, "game_id").join(player_map, "player_id").join(team_map, "club_id")
    conflict = F.coalesce(F.col("minute_in") > F.col("minute_out"), F.lit(False))
    return known.filter(~conflict), known.filter(conflict).select("game_id", "player_id", F.lit("minute_in_after_minute_out").alias("reason"))


def unmapped_league_seasons(matches: DataFrame, mapping: DataFrame) -> DataFrame:
    """League-seasons that still hold matches this provider has not mapped (create is not allowed there)."""
    return matches.join(mapping.select("match_id"), "match_id", "left_anti").groupBy("league", "season").agg(F.count(F.lit(1)).alias("unmapped"))


def rebuild_starters(appearances: DataFrame, substitutions: DataFrame, positions: DataFrame) -> DataFrame:
    """Starters = those who appeared minus those who came on; kept only for exact elevens whose
    positions are all known.  Players lie by game, but for the look-up of their positions."""
    entered = substitutions.filter("player_in_id IS NOT NULL").select("game_id", "club_id", F.col("player_in_id").alias("player_id")).repartition("game_id").distinct()
    began = appearances.select("game_id", "club_id", "player_id").join(entered, ["game_id", "club_id", "player_id"], "left_anti")
    placed = lie_together(began.join(positions.filter("position IS NOT NULL AND trim(position) <> ''"), "player_id", "left"), "game_id")
    fine = placed.groupBy("game_id", "club_id").agg(F.count(F.lit(1)).alias("n"), F.count("position").alias("known")).filter("n = 11 AND known = 11")
    return placed.join(fine.select("game_id", "club_id"), ["game_id", "club_id"], "left_semi").withColumn("formation_grid", F.concat(F.lit("reconstructed:"), F.col("position")))


def first_stadium(candidates: DataFrame) -> DataFrame:
    """First stadium-like geocoder candidate per team."""
    likely = F.col("type").isin("stadium", "sports_centre", "pitch") | F.coalesce(F.col("category") == "leisure", F.lit(False))
    fields = [c for c in candidates.columns if c not in {"team_id"}]
    best = candidates.filter(likely).groupBy("team_id").agg(F.min_by(F.struct(*fields), F.col("rank")).alias("_b"))
    return best.select("team_id", "_b.*")


def load_lineups(
    stored: DataFrame, incoming: DataFrame, match_map: DataFrame, team_map: DataFrame, players: DataFrame, memberships: DataFrame, provider: str,
    new_player_id: Column,
) -> dict[str, DataFrame]:
    """Batch form of loading line-ups fixture by fixture.

    A fixture whose match or any team is unknown is rejected whole.  Accepted fixtures replace the
    stored players of their (match, team, provider); unseen players are registered under
    ``new_player_id`` and get a membership opening on their first match day."""
    mapped = incoming.join(match_map, "provider_match_id", "left").join(team_map, "provider_team_id", "left")
    bad = mapped.filter("match_id IS NULL OR team_id IS NULL").select("provider_match_id").distinct()
    reason = F.when(F.col("_m") == 0, "match_not_mapped").otherwise("team_not_mapped")
    rejected = mapped.groupBy("provider_match_id").agg(F.count("match_id").alias("_m")).join(bad, "provider_match_id", "left_semi").select("provider_match_id", reason.alias("reason"))
    accepted = mapped.join(bad, "provider_match_id", "left_anti").withColumn("provider", F.lit(provider))
    registry = players.filter(F.col("provider") == provider).select("provider_player_id", F.col("player_id").alias("_known"))
    accepted = accepted.join(registry, "provider_player_id", "left").withColumn("player_id", F.coalesce("_known", new_player_id))
    keys = ["match_id", "team_id", "provider"]
    columns = [*keys, "player_id", "lineup_role", "position"]
    rows = accepted.select(*columns).distinct()
    kept = stored.select(*columns).join(rows.select(*keys).distinct(), keys, "left_anti")
    new_players = accepted.filter("_known IS NULL").groupBy("provider", "provider_player_id", "player_id").agg(F.min("player_name").alias("player_name"))
    opened = accepted.groupBy("player_id", "team_id", "provider").agg(F.min("match_day").alias("valid_from"))
    opened = opened.join(memberships.select("player_id", "team_id", "provider"), ["player_id", "team_id", "provider"], "left_anti")
    return {
        "lineups": kept.unionByName(rows), "new_players": new_players, "new_memberships": opened.withColumn("valid_to", F.lit(None).cast("date")), "rejected": rejected,
    }
