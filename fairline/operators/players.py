"""Player state before kickoff: line-up aggregates, five-part temporal features, history vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.scalars import OUTCOMES, as_column, binary_entropy, clip
from ..functions.temporal import last_rows_before, prior_totals, running_count, running_latest, running_max, running_sum
from ..session import lie_together

# Position vocabulary, departments and quality scores of the feature contract.
POSITION_BUCKETS = {
    "goalkeeper": ("goalkeeper",),
    "centre_back": ("centre-back", "sweeper"),
    "full_back": ("right-back", "left-back"),
    "defensive_midfield": ("defensive midfield",),
    "central_midfield": ("central midfield", "midfield"),
    "attacking_midfield": ("attacking midfield",),
    "wide_midfield": ("right midfield", "left midfield"),
    "winger": ("right winger", "left winger"),
    "second_striker": ("second striker",),
    "centre_forward": ("centre-forward",),
}
GRANULAR_POSITIONS = (*POSITION_BUCKETS, "other")
DEPARTMENT_BUCKETS = {
    "goalkeeper": ("goalkeeper",),
    "defense": ("centre_back", "full_back"),
    "midfield": ("defensive_midfield", "central_midfield", "attacking_midfield", "wide_midfield"),
    "attack": ("winger", "second_striker", "centre_forward"),
}
DEPARTMENTS = (*DEPARTMENT_BUCKETS, "unknown")
LETTER_DEPARTMENTS = {"g": "goalkeeper", "d": "defense", "m": "midfield", "f": "attack"}
QUALITY_SCORES = {"reported": 1.0, "observed": 1.0, "normalized": 0.9, "derived": 0.8, "observed_interval": 0.7, "proxy": 0.5}
NUMERIC_FAMILIES = (
    "observations", "starts", "benches", "start_rate", "bench_rate", "sub_entry_rate", "mean_minutes", "recent_minutes",
    "mean_minute_in", "mean_minute_out", "days_since_appearance", "team_experience", "league_experience", "team_change",
    "role_stability", "player_statistics_observations",
)
COUNT_FAMILIES = ("observations", "starts", "benches", "team_experience", "league_experience", "player_statistics_observations")
MINUTE_FAMILIES = ("mean_minutes", "recent_minutes", "mean_minute_in", "mean_minute_out")
LINEUP_FEATURES = ("expected_strength", "expected_attack", "expected_defense", "bench_quality", "lineup_continuity", "lineup_uncertainty")
MAX_BENCH = 12
VECTOR_FEATURES = (
    "career_strength", "career_goal_difference", "log_starts", "log_days_since", "observed", "recent_strength",
    "recent_goal_difference", "home_indicator", "career_goals_for", "career_goals_against", "recent_goals_for",
    "recent_goals_against", "opponent_strength", "team_experience_share", "league_experience_share", "role_stability",
    "lineup_familiarity", "log_squad_observations", "start_rate", "bench_rate", "bench_entry_rate", "average_minutes",
    "recent_minutes", "minute_in_mean", "minute_out_mean", "minutes_real_coverage", "original_position_quality",
    "shared_minutes", "shared_minutes_coverage",
)


def lookup(value: Column, groups: dict[str, Sequence[str]], default: str) -> Column:
    result = None
    for name, members in groups.items():
        result = (F.when if result is None else result.when)(value.isin(*members), name)
    return result.otherwise(default)


def position_bucket(position: Column | str) -> Column:
    """One of eleven granular buckets."""
    text = F.lower(F.trim(F.coalesce(as_column(position), F.lit(""))))
    return lookup(text, POSITION_BUCKETS, "other")


def department(position: Column | str) -> Column:
    """Department of a long position name or of a one-letter role."""
    text = F.lower(F.trim(F.coalesce(as_column(position), F.lit(""))))
    letters = {name: (letter,) for letter, name in LETTER_DEPARTMENTS.items()}
    by_letter = lookup(text, letters, "unknown")
    by_name = lookup(position_bucket(position), DEPARTMENT_BUCKETS, "unknown")
    return F.when(by_letter != "unknown", by_letter).otherwise(by_name)


def position_quality(provenance: Column | str, position: Column | str) -> Column:
    """1.0 reported, 0.6 reconstructed, 0.8 other provenance, 0.4 position only, 0.0 nothing."""
    text = F.lower(F.trim(F.coalesce(as_column(provenance), F.lit(""))))
    known = F.trim(F.coalesce(as_column(position), F.lit(""))) != ""
    return (
        F.when(text.startswith("reported:"), 1.0).when(text.startswith("reconstructed:"), 0.6)
        .when(text != "", 0.8).when(known, 0.4).otherwise(0.0)
    )


def best_lineup(lineups: DataFrame, players: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Per (match, team) the complete eleven of the preferred provider, then the lowest id."""
    starters = players.filter(F.col("lineup_role") == "starter").groupBy("lineup_id").agg(F.count(F.lit(1)).alias("starters"))
    rank = F.lit(len(provider_order))
    for position, name in enumerate(provider_order):
        rank = F.when(F.col("provider") == name, position).otherwise(rank)
    chosen = Window.partitionBy("match_id", "team_id").orderBy(rank, "lineup_id")
    return (
        lineups.join(starters.filter("starters = 11"), "lineup_id")
        .withColumn("_rn", F.row_number().over(chosen)).filter("_rn = 1").drop("_rn")
    )


def lineup_history_features(matches: DataFrame, lineups: DataFrame, lookback: int = 10) -> DataFrame:
    """Six line-up aggregates per (team, date) from the team's last valid games before that date."""
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    require_columns(lineups, ["match_id", "team", "player_id", "lineup_role"], "lineups")
    # line-ups move once, to lie by match: repeated rows, complete elevens and the games that look players up are settled there
    facts = lie_together(lineups.select(
        "match_id", "team", "player_id", F.when(F.col("lineup_role") == "starter", "starter").otherwise("bench").alias("role")
    ), "match_id").distinct()
    roles = facts.groupBy("match_id", "team", "player_id").agg(
        F.max((F.col("role") == "starter").cast("int")).alias("started"), F.max((F.col("role") == "bench").cast("int")).alias("benched")
    )
    valid = roles.groupBy("match_id", "team").agg(F.sum("started").alias("n")).filter("n = 11").select("match_id", "team")
    sides = matches.select(
        "match_id", "date", "result", F.inline(F.array(
            F.struct(F.col("home_team").alias("team"), F.col("home_goals").cast("double").alias("gf"), F.col("away_goals").cast("double").alias("ga")),
            F.struct(F.col("away_team").alias("team"), F.col("away_goals").cast("double").alias("gf"), F.col("home_goals").cast("double").alias("ga")),
        )),
    )
    points = F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0)
    games = sides.filter(F.col("result").isin(*OUTCOMES) & F.col("gf").isNotNull() & F.col("ga").isNotNull())
    games = games.withColumn("points", points).join(valid, ["match_id", "team"], "left_semi")
    tails = last_rows_before(games, sides, ["team"], "date", ["match_id"], ["points", "gf", "ga"], lookback)
    window = tails.select("team", "date", F.size("tail").alias("games"), F.posexplode(F.reverse("tail")).alias("age", "game")).select(
        "team", "date", "games", "age", F.col("game.match_id").alias("match_id"), F.col("game.points").alias("points"),
        F.col("game.gf").alias("gf"), F.col("game.ga").alias("ga"),
    )
    started = F.col("started") == 1
    seen = window.join(roles, ["match_id", "team"]).groupBy("team", "date", "player_id").agg(
        F.max("games").alias("games"), F.sum("started").alias("starts"), F.sum("benched").alias("benches"),
        F.avg(F.when(started, F.col("points") / 3.0)).alias("strength"), F.avg(F.when(started, F.col("gf"))).alias("attack"),
        (-F.avg(F.when(started, F.col("ga")))).alias("defense"), F.max(F.when(F.col("age") == 0, F.col("started")).otherwise(0)).alias("latest"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rated = seen.select(
        "team", "date", "player_id", "latest", (F.col("starts") / F.col("games")).alias("ps"), (F.col("benches") / F.col("games")).alias("pb"),
        zero("strength").alias("strength"), zero("attack").alias("attack"), zero("defense").alias("defense"),
    )
    by_bench = Window.partitionBy("team", "date").orderBy(F.col("pb").desc(), F.col("player_id"))
    ranked = rated.withColumn("bench_rank", F.row_number().over(by_bench))
    mean = lambda value, weight: F.when(F.sum(weight) > 0, F.sum(F.col(value) * weight) / F.sum(weight))
    top = F.when(F.col("bench_rank") <= 5, F.col("pb")).otherwise(0.0)
    return ranked.groupBy("team", "date").agg(
        mean("strength", F.col("ps")).alias("expected_strength"), mean("attack", F.col("ps")).alias("expected_attack"),
        mean("defense", F.col("ps")).alias("expected_defense"), mean("strength", top).alias("bench_quality"),
        F.try_divide(F.sum(F.col("ps") * F.col("latest")), F.sum("latest")).alias("lineup_continuity"),
        F.avg(binary_entropy("ps")).alias("lineup_uncertainty"),
    )


def prematch_player_features(matches: DataFrame, lineups: DataFrame, lookback: int = 10) -> DataFrame:
    """One row per match with the six aggregates of both sides."""
    form = lineup_history_features(matches, lineups, lookback)
    out = matches.select("match_id", "date", "home_team", "away_team")
    for side in ("home", "away"):
        part = form.select(F.col("team").alias(f"{side}_team"), "date", *[F.col(n).alias(f"{side}_player_{n}") for n in LINEUP_FEATURES])
        out = out.join(part, [f"{side}_team", "date"], "left")
    return out.drop("date", "home_team", "away_team")


def modal_count_before(history: DataFrame, probes: DataFrame, keys: Sequence[str], instant: str, label: str) -> DataFrame:
    """Largest number of earlier rows sharing one label, and the number of labelled rows.

    Counts per label only grow, so the modal count before an instant is the running maximum of
    the per-label running counts: two narrow walks over counts that moved once, no collected lists."""
    per = history.filter(F.col(label).isNotNull()).groupBy(*keys, label, instant).agg(F.count(F.lit(1)).alias("_n")).repartition(*keys)
    upto = Window.partitionBy(*keys, label).orderBy(instant).rowsBetween(Window.unboundedPreceding, 0)
    grown = per.withColumn("_upto", F.sum("_n").over(upto))
    return prior_totals(grown, probes, keys, instant, [running_max("modal", F.col("_upto")), running_sum("labelled", F.col("_n"))])


def temporal_player_matrix(observations: DataFrame, instant: str = "kickoff", bucket: Column | None = None) -> DataFrame:
    """Five-part features (value, available, quality, source, fallback kind) per observation.

    Observations move once, to lie by instant: they are summed up and find the walked totals there."""
    needed = ["match_id", instant, "league", "team_id", "player_id", "lineup_role", "minutes_played", "minute_in", "minute_out",
              "position_original", "position_normalized", "source", "has_statistics"]
    require_columns(observations, needed, "observations")
    obs = lie_together(observations.select(*needed), instant)
    role = F.col("lineup_role")
    measures = [
        running_count("n"), running_count("starts", role == "starter"), running_count("benches", role == "bench"),
        running_count("entries", F.col("minute_in").isNotNull()),
        running_sum("min_sum", F.col("minutes_played")), running_count("min_n", F.col("minutes_played").isNotNull()),
        running_sum("in_sum", F.col("minute_in")), running_sum("out_sum", F.col("minute_out")),
        running_count("out_n", F.col("minute_out").isNotNull()), running_count("stat_n", F.coalesce("has_statistics", F.lit(False))),
        running_latest("last", [F.col(instant), F.col("match_id")], {
            "team": F.col("team_id"), "original": F.col("position_original"), "normalized": F.col("position_normalized"), "source": F.col("source"),
        }),
    ]
    player = prior_totals(obs, obs, ["player_id"], instant, measures, bucket)
    team = prior_totals(obs, obs, ["player_id", "team_id"], instant, [running_count("team_n")], bucket)
    league = prior_totals(obs, obs, ["player_id", "league"], instant, [running_count("league_n")], bucket)
    modal = modal_count_before(obs, obs, ["player_id"], instant, "position_normalized")
    known = obs.filter(F.col("minutes_played").isNotNull())
    recent = last_rows_before(known, obs, ["player_id"], instant, ["match_id"], ["minutes_played"], 5)
    total = F.aggregate(F.col("tail").getField("minutes_played"), F.lit(0.0), lambda a, x: a + x)
    recent = recent.select("player_id", instant, F.when(F.size("tail") > 0, total / F.size("tail")).alias("recent_known"))
    joined = (
        obs.join(player, ["player_id", instant]).join(modal, ["player_id", instant]).join(recent, ["player_id", instant])
        .join(team, ["player_id", "team_id", instant]).join(league, ["player_id", "league", instant])
    )
    any_history, real = F.col("n") > 0, F.col("min_n") > 0
    starter_90 = F.when(F.col("starts") > 0, 90.0)
    fallback = F.when(real, "none").otherwise("starter_90")
    seconds = (F.unix_micros(F.col(instant).cast("timestamp")) - F.unix_micros(F.col("last.o0").cast("timestamp"))) / 1e6
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    lit = F.lit
    families: dict[str, tuple[Column, Column, Column, Column, Column]] = {
        "observations": (F.col("n"), any_history, lit("reported"), lit("canonical"), lit("none")),
        "starts": (F.col("starts"), any_history, lit("reported"), lit("canonical"), lit("none")),
        "benches": (F.col("benches"), any_history, lit("reported"), lit("canonical"), lit("none")),
        "start_rate": (ratio("starts", "n"), any_history, lit("derived"), lit("canonical"), lit("none")),
        "bench_rate": (ratio("benches", "n"), any_history, lit("derived"), lit("canonical"), lit("none")),
        "sub_entry_rate": (ratio("entries", "n"), any_history, lit("derived"), lit("canonical"), lit("unknown_without_timing")),
        "mean_minutes": (
            F.when(real, F.col("min_sum") / F.col("min_n")).otherwise(starter_90), real | (F.col("starts") > 0),
            F.when(real, "reported").otherwise("proxy"), lit("canonical"), fallback,
        ),
        "recent_minutes": (
            F.when(real, F.col("recent_known")).otherwise(starter_90), real | (F.col("starts") > 0),
            F.when(real, "reported").otherwise("proxy"), lit("canonical"), fallback,
        ),
        "mean_minute_in": (ratio("in_sum", "entries"), F.col("entries") > 0, lit("reported"), lit("canonical"), lit("unknown_without_timing")),
        "mean_minute_out": (ratio("out_sum", "out_n"), F.col("out_n") > 0, lit("reported"), lit("canonical"), lit("unknown_without_timing")),
        "days_since_appearance": (seconds / 86400.0, any_history, lit("derived"), lit("canonical"), lit("none")),
        "team_experience": (F.col("team_n"), any_history, lit("observed_interval"), lit("canonical"), lit("not_contract")),
        "league_experience": (F.col("league_n"), any_history, lit("observed"), lit("canonical"), lit("none")),
        "team_change": (
            F.coalesce(F.col("last.team") != F.col("team_id"), lit(False)), any_history, lit("observed_interval"), lit("canonical"), lit("not_contract"),
        ),
        "position_original": (F.col("last.original"), any_history, lit("reported"), F.coalesce("last.source", lit("none")), lit("unknown")),
        "position_normalized": (F.col("last.normalized"), any_history, lit("normalized"), F.coalesce("last.source", lit("none")), lit("department")),
        "role_stability": (ratio("modal", "labelled"), F.coalesce(F.col("labelled") > 0, lit(False)), lit("derived"), lit("canonical"), lit("department")),
        "player_statistics_observations": (F.col("stat_n"), any_history, lit("reported"), lit("canonical"), lit("none")),
    }
    flat = []
    for name, parts in families.items():
        flat += [c.alias(f"{name}_{s}") for c, s in zip(parts, ("value", "available", "quality", "source", "fallback_kind"), strict=True)]
    return joined.select(
        "match_id", "player_id", "team_id", instant, role.alias("current_lineup_role"),
        F.col("position_original").alias("current_position_original"), F.col("position_normalized").alias("current_position_normalized"),
        F.col("source").alias("current_source"), *flat,
    )


def encode_temporal(store: DataFrame, keep: Sequence[str] = ("match_id", "player_id", "team_id")) -> DataFrame:
    """79 numeric columns ``fs_*`` from the five-part features."""
    def scaled(name: str) -> Column:
        value = F.col(f"{name}_value").cast("double")
        if name in COUNT_FAMILIES:
            value = F.log1p(F.greatest(value, F.lit(0.0)))
        elif name in MINUTE_FAMILIES:
            value = value / 90.0
        elif name == "days_since_appearance":
            value = F.log1p(clip(value, 0.0, 365.0))
        return F.coalesce(value, F.lit(0.0))

    def quality(name: str) -> Column:
        result = F.lit(0.0)
        for label, score in QUALITY_SCORES.items():
            result = F.when(F.col(f"{name}_quality") == label, score).otherwise(result)
        return result

    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    used = lambda name: flag(F.coalesce(F.col(f"{name}_fallback_kind"), F.lit("none")) != "none")
    columns = []
    for name in NUMERIC_FAMILIES:
        columns += [
            scaled(name).alias(f"fs_{name}_value"), flag(F.col(f"{name}_available")).alias(f"fs_{name}_available"),
            quality(name).alias(f"fs_{name}_quality"), used(name).alias(f"fs_{name}_fallback"),
        ]
    bucket = position_bucket("position_original_value")
    columns += [(bucket == p).cast("double").alias(f"fs_position_{p}") for p in GRANULAR_POSITIONS]
    columns += [
        flag(F.col("position_original_available")).alias("fs_position_available"), quality("position_original").alias("fs_position_quality"),
        used("position_original").alias("fs_position_fallback"), F.lit(1.0).alias("fs_store_available"),
    ]
    return store.select(*keep, *columns)


def attach_store(slots: DataFrame, store: DataFrame) -> DataFrame:
    """Slots with the store's columns of their (match, player), empty where the store does not know them.

    Both lie by match, so what is summed up by match or line-up afterwards is not moved again."""
    slots.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return slots.repartition("match_id").join(store.repartition("match_id"), ["match_id", "player_id"], "left")


def teammate_pairs(slots: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Unordered teammate pairs (a < b) inside one line-up: 55 for an eleven.

    A line-up's players are collected once and its pairs are made where the line-up lies, so pairs are not moved to be made.  Repeated rows
    of a player in one line-up count once."""
    whole = slots.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    teams = whole.groupBy(*keys).agg(F.collect_set(F.struct("player_id", *values)).alias("_team"))
    left = teams.select(*keys, "_team", F.explode("_team").alias("_a"))
    pairs = left.select(*keys, "_a", F.explode(F.filter("_team", lambda x: x["player_id"] > F.col("_a.player_id"))).alias("_b"))
    return pairs.select(
        *keys, F.col("_a.player_id").alias("a"), *[F.col(f"_a.{v}").alias(f"a_{v}") for v in values],
        F.col("_b.player_id").alias("b"), *[F.col(f"_b.{v}").alias(f"b_{v}") for v in values])


def pair_history(slots: DataFrame) -> DataFrame:
    """Per line-up pair: earlier co-starts, earlier shared minutes and games with shared minutes.

    Slots, not pairs, are moved: those of one day lie together, so pairs are summed up per day and find their totals again without
    leaving their task.  Only the totals per (pair, day) travel, to be walked in order of days."""
    return _pair_history(lie_together(slots.select("match_id", "side", "date", "counts", "player_id", "starter", "actual_minutes"), "date"))


def _pair_history(by_day: DataFrame) -> DataFrame:
    pairs = teammate_pairs(by_day, ["match_id", "side", "date", "counts"], ["starter", "actual_minutes"])
    counted = pairs.withColumn("shared", F.when(
        F.col("a_actual_minutes").isNotNull() & F.col("b_actual_minutes").isNotNull(), F.least("a_actual_minutes", "b_actual_minutes")))
    # pairs that do not count are asked for, but add nothing
    counts = F.col("counts")
    before = prior_totals(
        counted, counted, ["a", "b"], "date",
        [running_count("co_starts", counts & F.col("a_starter") & F.col("b_starter")), running_sum("shared_sum", F.when(counts, F.col("shared"))),
         running_count("shared_n", counts & F.col("shared").isNotNull())],
    )
    # the totals of a few days are hashed, the pairs stream past them unsorted
    return counted.select("match_id", "side", "date", "a", "b", "a_starter", "b_starter").join(before.hint("shuffle_hash"), ["a", "b", "date"])


def slot_rows(matches: DataFrame, lineups: DataFrame) -> DataFrame:
    """Line-up slots with match facts, clipped minutes and departments."""
    for_side = lambda h, a: F.when(F.col("side") == "home", F.col(h)).otherwise(F.col(a))
    elo = "home_elo" in matches.columns
    games = matches.select("match_id", "result", "home_goals", "away_goals", *(["home_elo", "away_elo"] if elo else []))
    starter = F.col("lineup_role") == "starter"
    default = F.when(starter, 90.0).otherwise(0.0)
    timed = F.coalesce("timing_observed", F.lit(False))
    minutes = clip(F.when(timed & F.col("minutes_played").isNotNull(), F.col("minutes_played")).otherwise(default), 0.0, 120.0)
    opponent = for_side("away_elo", "home_elo") if elo else F.lit(1500.0)
    return (
        lineups.join(games, "match_id")
        .withColumn("starter", starter)
        .withColumn("timed", timed)
        .withColumn("minutes", minutes)
        .withColumn("actual_minutes", F.when(timed, minutes))
        .withColumn("department", department("position"))
        .withColumn("position_quality", F.when(F.coalesce(F.trim("position"), F.lit("")) != "", 0.4).otherwise(0.0)
                    if "formation_grid" not in lineups.columns else position_quality("formation_grid", "position"))
        .withColumn("gf", for_side("home_goals", "away_goals").cast("double"))
        .withColumn("ga", for_side("away_goals", "home_goals").cast("double"))
        .withColumn("points", F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0))
        .withColumn("opponent_elo", F.coalesce(opponent, F.lit(1500.0)))
        .withColumn("counts", F.coalesce(F.col("result").isin(*OUTCOMES), F.lit(False)))
    )


def player_history_vectors(slots: DataFrame, recent: int = 5) -> DataFrame:
    """29 history features per (match, side, player) from strictly earlier dates.

    ``slots`` comes from :func:`slot_rows` and has a ``date`` column.  Slots move once, to lie by day: they are summed up, make their pairs and find
    the walked totals there."""
    # a line-up of one day stays where it lies; only if a match is listed on several days its players' pairs come from all of them
    days = slots.groupBy("match_id").agg((F.min("date") < F.max("date")).alias("several"))
    line_up = ["match_id", "side", "player_id"] + ["date"] * days.filter("several").isEmpty()
    slots = lie_together(slots.select(
        "match_id", "side", "date", "slot", "player_id", "lineup_role", "department", "team", "league", "counts", "starter", "timed", "minutes", "actual_minutes",
        "minute_in", "minute_out", "points", "gf", "ga", "opponent_elo", "position_quality"), "date")
    # slots that do not count are asked for, but add nothing: one table is both history and probes
    counts = F.col("counts")
    s = F.col("starter")
    late_entry = counts & ~s & F.col("timed")
    held = lambda c: F.when(counts, F.col(c))
    start = lambda c: F.when(counts & s, F.col(c))
    measures = [
        running_count("obs", counts), running_count("starts", counts & s), running_count("bench", counts & ~s),
        running_count("entries", late_entry & (F.col("minute_in").isNotNull() | (F.col("minutes") > 0))), running_count("entry_obs", late_entry),
        running_sum("pts", start("points")), running_sum("sgf", start("gf")), running_sum("sga", start("ga")), running_sum("elo", start("opponent_elo")),
        running_sum("mins", held("minutes")), running_count("real_n", counts & F.col("timed")),
        running_sum("in_sum", held("minute_in")), running_count("in_n", counts & F.col("minute_in").isNotNull()),
        running_sum("out_sum", held("minute_out")), running_count("out_n", counts & F.col("minute_out").isNotNull()),
        running_max("last_date", held("date")),
    ]
    key = ["player_id", "date"]
    totals = prior_totals(slots, slots, ["player_id"], "date", measures)
    order = ["match_id", "side_order"]
    ordered = slots.filter("counts").withColumn("side_order", (F.col("side") == "away").cast("int"))
    tails = last_rows_before(
        ordered, slots, ["player_id"], "date", order, ["points", "gf", "ga", "minutes"], recent, groups={"started": F.col("starter")},
    )
    mean = lambda array, field: F.when(
        F.size(array) > 0, F.aggregate(F.col(array).getField(field), F.lit(0.0), lambda a, x: a + x) / F.size(array))
    tails = tails.select(
        *key, mean("started", "points").alias("r_pts"), mean("started", "gf").alias("r_gf"), mean("started", "ga").alias("r_ga"),
        mean("tail", "minutes").alias("r_min"),
    )
    out = slots.join(totals, key).join(tails, key)
    for name, column in (("team_n", "team"), ("league_n", "league"), ("department_n", "department")):
        part = prior_totals(slots, slots, ["player_id", column], "date", [running_count(name, counts)])
        out = out.join(part, ["player_id", column, "date"])
    pairs = _pair_history(slots)
    views = pairs.select(
        "match_id", "side", "date", "co_starts", "shared_sum", "shared_n",
        F.inline(F.array(F.struct(F.col("a").alias("player_id"), F.col("b_starter").alias("mate")),
                         F.struct(F.col("b").alias("player_id"), F.col("a_starter").alias("mate")))),
    ).filter("mate")
    known = F.col("shared_n") > 0
    mates = views.groupBy(*line_up).agg(
        F.count(F.lit(1)).alias("mates"), F.avg(F.log1p("co_starts")).alias("familiarity"),
        F.avg(F.when(known, F.col("shared_sum") / F.col("shared_n"))).alias("shared"), F.count(F.when(known, 1)).alias("shared_pairs"),
    )
    out = out.join(mates, line_up, "left")
    seen = F.col("obs") > 0
    starts = F.greatest("starts", F.lit(1)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = lambda c: zero(F.col(c)) / starts
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("obs"))
    days = (F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("last_date").cast("timestamp"))) / 86_400_000_000.0
    vector = {
        "career_strength": per("pts") / 3.0, "career_goal_difference": per("sgf") - per("sga"), "log_starts": F.log1p("starts"),
        "log_days_since": F.log1p(clip(days, 0.0, 365.0)), "observed": F.lit(1.0), "recent_strength": F.col("r_pts") / 3.0,
        "recent_goal_difference": F.col("r_gf") - F.col("r_ga"), "career_goals_for": per("sgf"), "career_goals_against": per("sga"),
        "recent_goals_for": F.col("r_gf"), "recent_goals_against": F.col("r_ga"),
        "opponent_strength": F.when(F.col("starts") > 0, (per("elo") - 1500.0) / 400.0), "team_experience_share": share("team_n"),
        "league_experience_share": share("league_n"), "role_stability": share("department_n"), "lineup_familiarity": F.col("familiarity"),
        "log_squad_observations": F.log1p("obs"), "start_rate": share("starts"), "bench_rate": share("bench"),
        "bench_entry_rate": F.try_divide(F.col("entries").cast("double"), F.col("entry_obs")), "average_minutes": share("mins") / 90.0,
        "recent_minutes": F.col("r_min") / 90.0, "minute_in_mean": F.try_divide(F.col("in_sum"), F.col("in_n")) / 90.0,
        "minute_out_mean": F.try_divide(F.col("out_sum"), F.col("out_n")) / 90.0, "minutes_real_coverage": share("real_n"),
        "shared_minutes": F.col("shared") / 90.0, "shared_minutes_coverage": F.col("shared_pairs") / F.greatest("mates", F.lit(1)),
    }
    columns = []
    for name in VECTOR_FEATURES:
        if name == "home_indicator":
            value = (F.col("side") == "home").cast("double")
        elif name == "original_position_quality":
            value = F.col("position_quality")
        else:
            value = F.when(seen, zero(vector[name].cast("double"))).otherwise(0.0)
        columns.append(value.alias(name))
    return out.select("match_id", "side", "slot", "player_id", "lineup_role", "department", "team", *columns)


def assemble_bench(lineups: DataFrame, store: DataFrame, cap: int = MAX_BENCH) -> DataFrame:
    """Listed substitutes plus the store's bench players not listed yet, at most ``cap`` in order.

    The store's team of a side is the one most starters belong to (lowest id on a tie).  Both tables move once, to lie by match."""
    lineups = lie_together(lineups.select("match_id", "side", "player_id", "position", "lineup_role", "slot"), "match_id")
    store = lie_together(store.select("match_id", "player_id", "team_id", "current_lineup_role", "current_position_normalized"), "match_id")
    starters = lineups.filter(F.col("lineup_role") == "starter")
    votes = starters.join(store.select("match_id", "player_id", "team_id"), ["match_id", "player_id"]).groupBy("match_id", "side", "team_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("match_id", "side").agg(F.min_by("team_id", F.struct(-F.col("n"), F.col("team_id"))).alias("team_id"))
    extra = store.filter(F.col("current_lineup_role") == "bench").select("match_id", "team_id", "player_id", F.col("current_position_normalized").alias("position"))
    extra = extra.join(best, ["match_id", "team_id"]).join(lineups.select("match_id", "side", "player_id"), ["match_id", "side", "player_id"], "left_anti")
    listed = lineups.filter(F.col("lineup_role") != "starter").select("match_id", "side", "player_id", "position", F.col("slot").alias("place"), F.lit(0).alias("origin"))
    both = listed.unionByName(extra.select("match_id", "side", "player_id", "position", F.lit(0).alias("place"), F.lit(1).alias("origin")))
    order = Window.partitionBy("match_id", "side").orderBy("origin", "place", "player_id")
    return both.withColumn("bench_slot", F.row_number().over(order)).filter(F.col("bench_slot") <= cap).select(
        "match_id", "side", "bench_slot", "player_id", "position", F.when(F.col("origin") == 0, "lineup").otherwise("store").alias("origin")
    )


def minutes_estimate(starter: Column, minute_in: Column, minute_out: Column) -> Column:
    """Starters play from 0, substitutes from their entry, both until exit or 90."""
    until = F.least(F.coalesce(minute_out, F.lit(90.0)), F.lit(90.0))
    since = F.when(starter, 0.0).otherwise(F.least(minute_in, F.lit(90.0)))
    return F.when(starter | minute_in.isNotNull(), F.greatest(until - since, F.lit(0.0)))


def reliability(slots: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Team reliability = weakest of depth, timing and reliable-starter share; match = weaker team."""
    obs = F.expm1(F.greatest("log_squad_observations", F.lit(0.0)))
    on = lambda c: F.coalesce(F.col(c) > 0.5, F.lit(False))
    timing = on("fs_mean_minutes_available") & (on("fs_mean_minute_in_available") | on("fs_mean_minute_out_available"))
    canonical = F.expm1(F.greatest(F.coalesce("fs_observations_value", F.lit(0.0)), F.lit(0.0)))
    solid = on("fs_store_available") & (F.round(canonical, 9) >= 5.0) & (F.coalesce("fs_observations_quality", F.lit(0.0)) >= 0.7)
    team = slots.filter(F.col("lineup_role") == "starter").groupBy(*keys, "side").agg(
        F.avg(clip(obs / 5.0, 0.0, 1.0)).alias("history_depth"), F.avg(timing.cast("double")).alias("timing_coverage"),
        F.avg(solid.cast("double")).alias("reliable_starters"),
    ).withColumn("team_reliability", F.least("history_depth", "timing_coverage", "reliable_starters"))
    names = ("history_depth", "timing_coverage", "reliable_starters", "team_reliability")
    wide = team.groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{side}_{n}") for side in ("home", "away") for n in names]
    )
    return wide.withColumn("match_reliability", F.least("home_team_reliability", "away_team_reliability"))


def pool_players(slots: DataFrame, features: Sequence[str], with_bench: bool = True) -> DataFrame:
    """Mean, population deviation and count per pool (everyone and each department), for starters
    and optionally bench, of both sides and their difference: ``6 * 2 * 3`` pools in one aggregate."""
    groups = ("starter", "bench") if with_bench else ("starter",)
    pools = ("all", *DEPARTMENTS)
    measures = []
    for side in ("home", "away"):
        for group in groups:
            here = (F.col("side") == side) & ((F.col("lineup_role") == "starter") == F.lit(group == "starter"))
            for pool in pools:
                member = here if pool == "all" else here & (F.col("department") == pool)
                for feature in features:
                    value = F.when(member, F.col(feature))
                    measures.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{side}_{group}_{pool}_{feature}_mean"))
                    measures.append(F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias(f"{side}_{group}_{pool}_{feature}_std"))
                measures.append(F.count(F.when(member, 1)).cast("double").alias(f"{side}_{group}_{pool}_count"))
    pooled = slots.groupBy("match_id").agg(*measures)
    stems = [c[len("home_"):] for c in pooled.columns if c.startswith("home_")]
    return pooled.select("*", *[(F.col(f"home_{s}") - F.col(f"away_{s}")).alias(f"difference_{s}") for s in stems])


def availability_rates(slots: DataFrame) -> DataFrame:
    """Share of slots with history, real minutes and a store row, for starters and bench."""
    group = F.when(F.col("lineup_role") == "starter", "starter").otherwise("bench")
    return slots.groupBy(group.alias("slot_group")).agg(
        F.count(F.lit(1)).alias("slots"), F.avg("observed").alias("history_rate"), F.avg("minutes_real_coverage").alias("real_minutes_rate"),
        F.avg(F.coalesce("fs_store_available", F.lit(0.0))).alias("store_rate"),
        F.avg(F.coalesce("fs_mean_minutes_available", F.lit(0.0))).alias("minutes_available_rate"),
    )


