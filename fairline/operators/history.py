"""Team history before each match: ratings, rolling and weighted form, rest, venue form."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import assert_no_rows, require_columns
from ..functions.scalars import OUTCOMES, collapse_spaces, number_or_null, safe_ratio
from ..functions.temporal import keep_latest, last_rows_before, prior_totals, running_count, running_max

# Counters of a season file and their names in the match table.
PERFORMANCE_COLUMNS = {
    "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target",
    "HC": "home_corners", "AC": "away_corners", "HY": "home_yellow_cards", "AY": "away_yellow_cards",
    "HR": "home_red_cards", "AR": "away_red_cards",
}
ROLLING_FIELDS = (
    "shots_for", "shots_against", "shots_on_target_for", "shots_on_target_against", "corners_for", "corners_against",
    "yellow_cards", "red_cards", "shot_conversion", "shot_accuracy",
)
FORM_FIELDS = ("points", "goals_for", "goals_against", "opponent_elo", *ROLLING_FIELDS)
WEIGHTED_FIELDS = ("points", "goal_difference", "shots_on_target_difference")


@dataclass(frozen=True)
class EloSettings:
    initial: float = 1500.0
    k: float = 20.0
    home_advantage: float = 65.0
    season_pull: float = 0.25


def completed(prefix: str = "") -> Column:
    played = F.col(f"{prefix}result").isin(*OUTCOMES)
    return F.coalesce(played & F.col(f"{prefix}home_goals").isNotNull() & F.col(f"{prefix}away_goals").isNotNull(), F.lit(False))


def select_matches(matches: DataFrame, leagues: Sequence[str] = (), seasons: Sequence[str] = ()) -> DataFrame:
    """Completed matches of the wanted leagues and seasons (filters reach the Parquet scan)."""
    out = matches
    if leagues:
        out = out.filter(F.col("league").isin(*leagues))
    if seasons:
        out = out.filter(F.col("season").isin(*seasons))
    return out.filter(completed())


def team_name(value: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Collapse whitespace, then apply an alias map given as literals."""
    name = collapse_spaces(value)
    if not aliases:
        return name
    pairs = F.create_map(*[F.lit(text) for pair in aliases.items() for text in pair])
    return F.coalesce(pairs[name], name)


def closing_probabilities(odds: DataFrame) -> DataFrame:
    """Mean closing 1X2 probability per selection, aggregated before any join (no fan-out)."""
    closing = odds.filter((F.col("market") == "1X2") & (F.col("opening_or_closing") == "closing"))
    mean = lambda s: F.avg(F.when(F.col("selection") == s, F.col("implied_probability")))
    return closing.groupBy("match_id").agg(
        mean("H").alias("market_home_probability"), mean("D").alias("market_draw_probability"),
        mean("A").alias("market_away_probability"), F.avg("margin").alias("market_margin"),
    )


def canonical_matches(matches: DataFrame, odds: DataFrame) -> DataFrame:
    return matches.join(closing_probabilities(odds), "match_id", "left")


def prepare_modeling_matches(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Season rows -> typed, valid, unique matches with closing probabilities when present."""
    require_columns(raw, ["Date", "Season", "League", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"], "matches")
    formats = ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")
    day = F.coalesce(*[F.to_date(F.try_to_timestamp("Date", F.lit(f))) for f in formats])
    columns = [
        day.alias("date"), F.col("Season").cast("string").alias("season"), F.col("League").cast("string").alias("league"),
        team_name("HomeTeam", aliases).alias("home_team"), team_name("AwayTeam", aliases).alias("away_team"),
        number_or_null("FTHG").cast("int").alias("home_goals"), number_or_null("FTAG").cast("int").alias("away_goals"),
        F.col("FTR").alias("result"),
    ]
    columns += [number_or_null(s).alias(t) for s, t in PERFORMANCE_COLUMNS.items() if s in raw.columns]
    prices = [c for c in ("AvgCH", "AvgCD", "AvgCA") if c in raw.columns]
    if len(prices) == 3:
        inverse = [F.try_divide(F.lit(1.0), number_or_null(c)) for c in prices]
        known = [F.coalesce(i, F.lit(0.0)) for i in inverse]
        total = known[0] + known[1] + known[2]
        names = ("market_home_probability", "market_draw_probability", "market_away_probability")
        columns += [F.try_divide(i, total).alias(n) for i, n in zip(inverse, names, strict=True)]
    data = raw.select(*columns).filter(
        F.col("date").isNotNull() & completed() & (F.col("home_team") != F.col("away_team"))
    )
    key = F.concat_ws("|", "league", "season", F.date_format("date", "yyyy-MM-dd"), "home_team", "away_team")
    data = data.withColumn("match_id", key)
    return keep_latest(data, ["match_id"], [F.col("home_goals"), F.col("away_goals"), F.col("result")], first=True)


def prepare_future_fixtures(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Fixtures without results; any observed target, blank side or repeated id fails the job."""
    require_columns(raw, ["date", "season", "league", "home_team", "away_team"], "fixtures")
    targets = [c for c in ("result", "home_goals", "away_goals") if c in raw.columns]
    for target in targets:
        assert_no_rows(raw.filter(F.col(target).isNotNull()), "future fixtures must not hold observed targets")
    when = F.col("date").cast("timestamp")
    data = raw.select(
        F.col("date"), F.col("season").cast("string").alias("season"), F.col("league").cast("string").alias("league"),
        team_name("home_team", aliases).alias("home_team"), team_name("away_team", aliases).alias("away_team"),
        *(["match_id"] if "match_id" in raw.columns else []),
    )
    if "match_id" not in raw.columns:
        stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
        data = data.withColumn("match_id", F.concat_ws("|", F.lit("fixture"), "league", "season", stamp, "home_team", "away_team"))
    required = F.col("date").isNull() | F.col("season").isNull() | F.col("league").isNull() | F.col("match_id").isNull()
    blank = (F.coalesce("home_team", F.lit("")) == "") | (F.coalesce("away_team", F.lit("")) == "")
    assert_no_rows(data.filter(required | blank | (F.col("home_team") == F.col("away_team"))), "fixtures need a date, a league and two different sides")
    assert_no_rows(data.groupBy("match_id").count().filter("count > 1"), "fixture ids must be unique")
    return data.withColumns(
        {"home_goals": F.lit(None).cast("int"), "away_goals": F.lit(None).cast("int"), "result": F.lit(None).cast("string")}
    )


class EloPool:
    """Rating state of one league: read every row of an instant first, settle when time moves on.

    Small enough to be carried as text, so batch and streaming jobs share it."""

    def __init__(self, rule: EloSettings) -> None:
        self.rule = rule
        self.season: str | None = None
        self.instant = None
        self.ratings: dict[str, float] = {}
        self.waiting: list[list] = []

    def expected(self, home: float, away: float) -> float:
        return 1.0 / (1.0 + 10.0 ** (-(home + self.rule.home_advantage - away) / 400.0))

    def settle(self) -> None:
        start = self.rule.initial
        for home, away, goals_home, goals_away in self.waiting:
            before_home, before_away = self.ratings.get(home, start), self.ratings.get(away, start)
            score = 0.5 if goals_home == goals_away else float(goals_home > goals_away)
            scale = 1.0 + math.log1p(abs(goals_home - goals_away))
            change = self.rule.k * scale * (score - self.expected(before_home, before_away))
            self.ratings[home], self.ratings[away] = before_home + change, before_away - change
        self.waiting = []

    def read(self, season: str, at, home: str, away: str, goals_home: float, goals_away: float) -> tuple[float, float]:
        """Ratings before this row; a completed row waits to be settled with its instant."""
        if self.instant is not None and at != self.instant:
            self.settle()
        self.instant = at
        if self.season is not None and season != self.season:
            pull = self.rule.season_pull
            self.ratings = {team: (1.0 - pull) * rating + pull * self.rule.initial for team, rating in self.ratings.items()}
        self.season = season
        if goals_home == goals_home and goals_away == goals_away:
            self.waiting.append([home, away, goals_home, goals_away])
        return self.ratings.get(home, self.rule.initial), self.ratings.get(away, self.rule.initial)

    def dump(self) -> str:
        return json.dumps([self.season, self.instant, self.ratings, self.waiting])

    @classmethod
    def load(cls, rule: EloSettings, text: str) -> EloPool:
        pool = cls(rule)
        pool.season, pool.instant, pool.ratings, pool.waiting = json.loads(text)
        return pool


ELO_INPUT = ("league", "season", "at", "match_id", "home_team", "away_team", "hg", "ag")


def elo_input(matches: DataFrame, date: str = "date") -> DataFrame:
    """The eight narrow columns the rating recursion needs; goals are NULL for unplayed rows."""
    return matches.select(
        "league", F.col("season").cast("string").alias("season"), F.unix_micros(F.col(date).cast("timestamp")).alias("at"), "match_id",
        "home_team", "away_team", F.when(completed(), F.col("home_goals")).cast("double").alias("hg"),
        F.when(completed(), F.col("away_goals")).cast("double").alias("ag"),
    )


def with_expectation(rated: DataFrame, rule: EloSettings) -> DataFrame:
    gap = F.col("home_elo") + F.lit(rule.home_advantage) - F.col("away_elo")
    return rated.withColumn("elo_difference", gap).withColumn("elo_expected_home", 1.0 / (1.0 + F.pow(F.lit(10.0), -gap / 400.0)))


def elo_ratings(matches: DataFrame, settings: EloSettings | None = None, date: str = "date") -> DataFrame:
    """Ratings each side holds before its match, one independent pool per league.

    The recursion is inherently sequential inside a pool, so only eight narrow columns reach it:
    rows are shuffled by league, sorted by Spark (which spills) and *streamed* through
    ``mapInPandas``.  Nothing is grouped in memory; the state is one rating per team."""
    rule = settings or EloSettings()
    id_type = matches.schema["match_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league, pool = None, EloPool(rule)
        for batch in batches:
            home_elo, away_elo = [], []
            for row_league, season, at, _, home, away, hg, ag in zip(*(batch[c].to_numpy() for c in ELO_INPUT), strict=True):
                if row_league != league:
                    league, pool = row_league, EloPool(rule)
                before = pool.read(season, at, home, away, hg, ag)
                home_elo.append(before[0])
                away_elo.append(before[1])
            yield pd.DataFrame({"match_id": batch["match_id"], "home_elo": home_elo, "away_elo": away_elo})

    streamed = elo_input(matches, date).repartition("league").sortWithinPartitions("league", "at", "match_id")
    return with_expectation(streamed.mapInPandas(fold, f"match_id {id_type}, home_elo double, away_elo double"), rule)


def team_rows(matches: DataFrame, date: str = "date") -> DataFrame:
    """Two rows per match, one per side, from a single pass over the matches."""
    have = set(matches.columns)

    def value(column: str) -> Column:
        return F.col(column).cast("double") if column in have else F.lit(None).cast("double")

    def side_row(side: str, other: str) -> Column:
        goals_for, goals_against = value(f"{side}_goals"), value(f"{other}_goals")
        shots, on_target = value(f"{side}_shots"), value(f"{side}_shots_on_target")
        points = F.when(goals_for > goals_against, 3.0).when(goals_for == goals_against, 1.0).when(goals_for < goals_against, 0.0)
        fields = {
            "side": F.lit(side), "team": F.col(f"{side}_team"), "goals_for": goals_for, "goals_against": goals_against,
            "points": points, "goal_difference": goals_for - goals_against, "opponent_elo": value(f"{other}_elo"),
            "shots_for": shots, "shots_against": value(f"{other}_shots"), "shots_on_target_for": on_target,
            "shots_on_target_against": value(f"{other}_shots_on_target"), "corners_for": value(f"{side}_corners"),
            "corners_against": value(f"{other}_corners"), "yellow_cards": value(f"{side}_yellow_cards"),
            "red_cards": value(f"{side}_red_cards"), "shot_conversion": safe_ratio(goals_for, shots),
            "shot_accuracy": safe_ratio(on_target, shots),
            "shots_on_target_difference": on_target - value(f"{other}_shots_on_target"),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return matches.select(
        "match_id", F.col(date).alias("date"), "league", completed().alias("completed"),
        F.inline(F.array(side_row("home", "away"), side_row("away", "home"))),
    )


def team_form(rows: DataFrame, windows: Sequence[int] = (5, 10), alpha: float = 0.35) -> DataFrame:
    """One row per (league, team, date): everything known about the team before that date."""
    if not windows or min(windows) <= 0:
        raise ValueError("windows must be positive")
    longest = max(windows)
    key = ["league", "team"]
    history = rows.filter("completed")
    fields = list(dict.fromkeys([*FORM_FIELDS, *WEIGHTED_FIELDS]))
    tails = last_rows_before(
        history, rows, key, "date", ["match_id"], fields, longest,
        groups={"at_home": F.col("side") == "home", "at_away": F.col("side") == "away"},
    )
    venue = {}
    for name, short in (("at_home", "home"), ("at_away", "away")):
        for window in windows:
            for field in ("points", "goal_difference"):
                part = F.slice(F.reverse(F.col(name)), 1, window).getField(field)
                total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
                venue[f"{short}_venue_{field}_{window}"] = F.when(F.size(part) > 0, total / F.size(part))
    exploded = tails.select(*key, "date", *[c.alias(n) for n, c in venue.items()], F.posexplode_outer(F.reverse("tail")).alias("age", "past"))
    weight = F.pow(F.lit(1.0 - alpha), F.col("age"))
    measures = []
    for window in windows:
        measures += [F.avg(F.when(F.col("age") < window, F.col(f"past.{f}"))).alias(f"{f}_{window}") for f in FORM_FIELDS]
    for field in WEIGHTED_FIELDS:
        value = F.col(f"past.{field}")
        measures.append(F.try_divide(F.sum(weight * value), F.sum(F.when(value.isNotNull(), weight))).alias(f"{field}_ewm"))
    # hash(league, team) already clusters (league, team, date): no further shuffle
    rolled = exploded.groupBy(*key, "date").agg(*measures, *[F.max(n).alias(n) for n in venue])
    seen = prior_totals(history, rows, key, "date", [running_count("matches_played"), running_max("_last", F.col("date"))])
    elapsed = F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    seen = seen.withColumn("rest_days", F.floor(elapsed / F.lit(86_400_000_000)).cast("double")).drop("_last")
    return rolled.join(seen, [*key, "date"])


def attach_form(matches: DataFrame, form: DataFrame, windows: Sequence[int] = (5, 10), date: str = "date") -> DataFrame:
    common = [f"{f}_{w}" for w in windows for f in FORM_FIELDS] + [f"{f}_ewm" for f in WEIGHTED_FIELDS] + ["matches_played", "rest_days"]
    out = matches
    for side in ("home", "away"):
        venue = [f"{side}_venue_{f}_{w}" for w in windows for f in ("points", "goal_difference")]
        part = form.select(
            "league", F.col("team").alias(f"{side}_team"), F.col("date").alias(date),
            *[F.col(c).alias(f"{side}_{c}") for c in common], *venue,
        )
        out = out.join(part, ["league", f"{side}_team", date], "left")
    return out


def build_prematch_features(
    matches: DataFrame,
    windows: Sequence[int] = (5, 10),
    settings: EloSettings | None = None,
    include_unplayed: bool = False,
) -> DataFrame:
    """Match rows with ratings and form known strictly before each match date."""
    rated = matches.join(elo_ratings(matches, settings), "match_id")
    form = team_form(team_rows(rated), windows)
    kept = rated.drop(*PERFORMANCE_COLUMNS.values())
    if not include_unplayed:
        kept = kept.filter(completed())
    return attach_form(kept, form, windows)


def build_fixture_features(
    history: DataFrame, fixtures: DataFrame, windows: Sequence[int] = (5, 10), settings: EloSettings | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """The same features for matches still to be played; fixture ids must be new."""
    prepared = prepare_future_fixtures(fixtures, aliases)
    assert_no_rows(history.join(prepared.select("match_id"), "match_id", "left_semi"), "fixture ids must be new")
    combined = history.unionByName(prepared, allowMissingColumns=True)
    features = build_prematch_features(combined, windows, settings, include_unplayed=True)
    return features.join(prepared.select("match_id"), "match_id", "left_semi")
