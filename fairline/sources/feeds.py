"""Provider payloads to rows: odds pages, rosters, feed line-ups, wide elevens, price columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import once_a_row, token_key
from ..functions.scalars import as_column, int_or_null, natural_key_id, number_or_null
from ..operators.players import minutes_estimate

# Payload schemas, column names and code lists of the providers' formats.
ODDS_PAGE = (
    "errors array<string>, paging struct<current:int,total:int>, response array<struct<league:struct<id:int,season:int>,"
    "fixture:struct<id:bigint,date:string>,update:string,bookmakers:array<struct<id:int,name:string,"
    "bets:array<struct<id:int,values:array<struct<value:string,odd:string>>>>>>>>"
)
ROSTER = (
    "team_id bigint, team_name string, lineup array<struct<player_id:bigint,player_name:string,jersey_number:int,"
    "positions:array<struct<position:string,start_reason:string>>>>"
)
_FEED_PLAYER = (
    "struct<playerId:string,providerId:string,displayName:string,mediaFirstName:string,mediaLastName:string,shirtName:string,"
    "roleLabel:string,events:array<struct<type:string,time:double,additionalTime:double>>>"
)
_FEED_SIDE = f"struct<teamId:string,mediaName:string,officialName:string,tacticalFormation:string,fielded:array<{_FEED_PLAYER}>,benched:array<{_FEED_PLAYER}>>"
FEED_LINEUP = f"home {_FEED_SIDE}, away {_FEED_SIDE}"
REPORT = (
    "id string, match_report struct<date:string,teams:struct<home:struct<team_id:string,name:string,score:int>,away:struct<team_id:string,name:string,score:int>>,"
    "lineups:struct<home:struct<formation:string,players:array<struct<name:string,number:int>>>,away:struct<formation:string,players:array<struct<name:string,number:int>>>>,"
    "player_stats:struct<home:array<struct<Player:string,Pos:string>>,away:array<struct<Player:string,Pos:string>>>>"
)
ODDS_PROVIDER = "API-Football"
SELECTIONS = {"Home": "H", "Draw": "D", "Away": "A"}
BOOKMAKER_COLUMNS = {
    "Market Average": {"closing": ("AvgCH", "AvgCD", "AvgCA"), "opening": ("AvgH", "AvgD", "AvgA")},
    "Bet365": {"closing": ("B365CH", "B365CD", "B365CA"), "opening": ("B365H", "B365D", "B365A")},
    "Pinnacle": {"closing": ("PSCH", "PSCD", "PSCA"), "opening": ("PSH", "PSD", "PSA")},
    "Maximum Odds": {"closing": ("MaxCH", "MaxCD", "MaxCA"), "opening": ("MaxH", "MaxD", "MaxA")},
}
SERIES_BOOKMAKERS = (
    "Interwetten", "bwin", "bet-at-home", "Unibet", "Stan James", "Expekt", "10Bet", "William Hill", "bet365", "Pinnacle Sports",
    "DOXXbet", "Betsafe", "Betway", "888sport", "Ladbrokes", "Betclic", "Sportingbet", "myBet", "Betsson", "188BET", "Jetbull",
    "Paddy Power", "Tipico", "Coral", "SBOBET", "BetVictor", "12BET", "Titanbet", "youwin", "ComeOn", "Betadonis", "Betfair Sports",
)
SERIES_INDEX, SERIES_HOURS = 70, 1
SEASON_COUNTERS = {
    "FTHG": "home_goals", "FTAG": "away_goals", "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target",
    "HC": "home_corners", "AC": "away_corners", "HY": "home_yellow_cards", "AY": "away_yellow_cards", "HR": "home_red_cards", "AR": "away_red_cards",
}
LAYOUTS = {
    "coordinates": (range(1, 12), {"player_id": "{side}_player_{n}", "x": "{side}_player_X{n}", "y": "{side}_player_Y{n}"}),
    "named_slots": (range(11), {"player_name": "{side} player {n}"}),
    "named_positions": (range(1, 12), {"player_name": "starting_name_{side}{n}", "position": "starting_position_{side}{n}"}),
}


# ---- roles --------------------------------------------------------------------------------

def role_from_name(position: Column | str) -> Column:
    """G/D/M/F from words in a position name; NULL when none fits."""
    text = F.lower(as_column(position))
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("keeper"), "G").when(has("back", "defender", "sweeper"), "D").when(has("midfield"), "M").when(has("winger", "forward", "striker"), "F")


def role_from_depth(y: Column | str) -> Column:
    """G/D/M/F from the tactical depth coordinate."""
    depth = as_column(y).cast("double")
    return F.when(depth <= 1, "G").when(depth <= 5, "D").when(depth <= 8, "M").when(depth.isNotNull(), "F")


def role_from_slot(slot: Column | str) -> Column:
    """G/D/M/F from a 0-10 slot listed from attack to goalkeeper."""
    place = as_column(slot)
    return F.when(place == 10, "G").when(place >= 6, "D").when(place >= 2, "M").otherwise("F")


def role_from_codes(codes: Column | str) -> Column:
    """G/D/M/F from comma-separated position codes."""
    listed = F.transform(F.split(F.upper(as_column(codes)), ","), lambda c: F.trim(c))
    any_of = lambda *names: F.arrays_overlap(listed, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(any_of("GK"), "G").when(any_of("DF", "CB", "LB", "RB", "WB"), "D").when(any_of("MF", "CM", "DM", "AM", "LM", "RM"), "M")
        .when(any_of("FW", "LW", "RW", "CF", "ST"), "F")
    )


# ---- matches and prices -------------------------------------------------------------------

def season_matches(raw: DataFrame) -> DataFrame:
    """Season rows -> match contract; rows whose date cannot be read carry a reason.

    The external id hashes league, season, day and both names."""
    present = set(raw.columns)
    text = F.col("Date") if "Time" not in present else F.concat_ws(" ", F.col("Date"), F.nullif(F.trim("Time"), F.lit("")))
    layouts = [f"{d}{t}" for d in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd") for t in ("", " HH:mm", " HH:mm:ss")]
    kickoff = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts])
    counters = [int_or_null(s).alias(t) if s in present else F.lit(None).cast("int").alias(t) for s, t in SEASON_COUNTERS.items()]
    result = F.when(F.col("FTR").isin("H", "D", "A"), F.col("FTR")) if "FTR" in present else F.lit(None).cast("string")
    day = F.date_format(kickoff, "yyyy-MM-dd")
    consumed = {"Date", "Time", "Season", "League", "HomeTeam", "AwayTeam", "FTR", *SEASON_COUNTERS}
    identity = {"Season": "season", "League": "league", "HomeTeam": "home_team", "AwayTeam": "away_team"}
    return raw.select(
        *[c for c in raw.columns if c not in consumed], *[F.col(s).cast("string").alias(t) for s, t in identity.items()],
        kickoff.alias("date"), natural_key_id("League", "Season", day, "HomeTeam", "AwayTeam").alias("provider_match_id"), result.alias("result"), *counters,
        F.when(kickoff.isNull(), "invalid_date").alias("reason"),
    )


def bookmaker_snapshots(df: DataFrame, keep: Sequence[str], columns: dict[str, dict[str, tuple[str, str, str]]] = BOOKMAKER_COLUMNS) -> DataFrame:
    """Wide price triples -> one row per complete triple with all prices above one."""
    rows = []
    for bookmaker, timings in columns.items():
        for timing, triple in timings.items():
            if set(triple).issubset(df.columns):
                prices = [number_or_null(c).alias(n) for c, n in zip(triple, ("odds_h", "odds_d", "odds_a"), strict=True)]
                rows.append(F.struct(F.lit(bookmaker).alias("bookmaker"), F.lit("1X2").alias("market"), F.lit(timing).alias("timing"), *prices))
    if not rows:
        raise ValueError("no complete bookmaker triple among the columns")
    long = df.select(*keep, F.inline(F.array(*rows)))
    return long.filter("odds_h > 1 AND odds_d > 1 AND odds_a > 1")


def to_selections(triples: DataFrame, keep: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("selection"), F.col(c).alias("odds")) for s, c in (("H", "odds_h"), ("D", "odds_d"), ("A", "odds_a"))]
    return triples.select(*keep, F.inline(F.array(*rows)))


def cutoff_snapshot(
    series: DataFrame, reconciled: DataFrame, bookmakers: Sequence[str] = SERIES_BOOKMAKERS, index: int = SERIES_INDEX, hours: int = SERIES_HOURS
) -> DataFrame:
    """Hourly wide series -> the prices ``hours`` before kickoff, complete triples only."""
    rows = []
    for number, name in enumerate(bookmakers, start=1):
        prices = [number_or_null(f"{side}_b{number}_{index}").alias(alias) for side, alias in (("home", "odds_h"), ("draw", "odds_d"), ("away", "odds_a"))]
        rows.append(F.struct(F.lit(name).alias("bookmaker"), *prices))
    triples = series.select(F.col("match_id").alias("source_id"), F.inline(F.array(*rows))).filter("odds_h > 1 AND odds_d > 1 AND odds_a > 1")
    mapped = triples.join(reconciled.select("source_id", "match_id", "kickoff"), "source_id")
    mapped = mapped.withColumns({
        "prediction_cutoff": F.col("kickoff"), "provider_updated_at": F.col("kickoff") - F.expr(f"INTERVAL {hours} HOUR"), "market": F.lit("1X2"),
    })
    keep = ["source_id", "match_id", "bookmaker", "market", "prediction_cutoff", "provider_updated_at"]
    return to_selections(mapped, keep)


def odds_values(pages: DataFrame, keep: Sequence[str] = (), provider: str = ODDS_PROVIDER) -> DataFrame:
    """Every listed value of market 1 with a known selection, the ``keep`` columns of its page and a ``reason``: null for a good price,
    ``price_not_above_one`` or ``no_update_time``.  An item without a readable update time is one row, whatever it lists."""
    def items(i: Column) -> Column:
        updated = F.try_to_timestamp(i["update"])
        values = F.flatten(F.transform(F.coalesce(i["bookmakers"], F.array()), lambda b: F.flatten(F.transform(
            F.filter(F.coalesce(b["bets"], F.array()), lambda t: F.coalesce(t["id"] == 1, F.lit(False))),
            lambda t: F.transform(F.coalesce(t["values"], F.array()), lambda v: F.struct(b["id"].alias("bookmaker_id"), b["name"].alias("bookmaker"), known[v["value"]].alias("selection"), v["odd"].alias("odd")))))))
        listed = F.filter(values, lambda v: v["selection"].isNotNull())
        nothing = F.array(F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in (("bookmaker_id", "int"), ("bookmaker", "string"), ("selection", "string"), ("odd", "string"))]))
        return F.struct(i["fixture"].alias("fixture"), i["league"].alias("league"), updated.alias("updated"), F.when(updated.isNull(), nothing).otherwise(listed).alias("values"))

    known = F.create_map(*[F.lit(x) for pair in SELECTIONS.items() for x in pair])
    rows = pages.select(*keep, F.explode(F.transform("response", items)).alias("_i")).select(*keep, "_i.*").select(*keep, "fixture", "league", "updated", F.explode("values").alias("_v"))
    odds = number_or_null("_v.odd")
    reason = F.when(F.col("updated").isNull(), "no_update_time").when(~F.coalesce(odds > 1, F.lit(False)), "price_not_above_one")
    return rows.select(
        F.lit(provider).alias("provider"), F.col("fixture.id").cast("string").alias("provider_fixture_id"), F.try_to_timestamp("fixture.date").alias("fixture_kickoff"),
        F.col("league.id").alias("league_id"), F.col("league.season").alias("season"), "_v.bookmaker_id", "_v.bookmaker", F.lit("1X2").alias("market"), "_v.selection",
        odds.alias("decimal_odds"), F.col("updated").alias("provider_updated_at"), *keep, reason.alias("reason"))


def odds_pages(pages: DataFrame, keep: Sequence[str] = (), provider: str = ODDS_PROVIDER) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of parsed odds pages: market 1 only, known selections, price above one; ``keep`` names columns of the pages that
    every row carries, such as ``collected_at``.

    A page item without a readable update time is a contract breach and fails the job; ``odds_values`` lists it instead."""
    values = odds_values(pages, keep, provider)
    breach = F.raise_error(F.lit("odds page without provider update time")).cast("boolean")
    good = F.when(F.col("provider_updated_at").isNull(), breach).otherwise(F.col("reason").isNull())
    return values.filter(good).drop("reason"), values.filter(~good)


def odds_manifest(pages: DataFrame, by: Sequence[str], values: DataFrame | None = None) -> DataFrame:
    """One row per collection (``by``): pages available and collected, whether that is all of them, fixtures and rows with a good price,
    rejected prices and items without update time.  A page without paging is the only one; a page that stands twice counts once.
    ``values`` are the pages' ``odds_values`` with ``by``, if they are at hand."""
    facts = [*by, F.coalesce("paging.current", F.lit(1)).alias("_current"), F.coalesce("paging.total", F.lit(1)).alias("_total")]
    paging = pages.select(*facts).groupBy(*by).agg(F.max("_total").alias("pages_available"), F.count_distinct("_current").alias("pages_collected"))
    good = F.col("reason").isNull()
    values = (odds_values(pages, by) if values is None else values).groupBy(*by).agg(
        F.count_distinct(F.when(good, F.col("provider_fixture_id"))).alias("fixtures"), F.count_if(good).alias("rows"),
        F.count_if(F.col("reason") == "price_not_above_one").alias("invalid_values"), F.count_if(F.col("reason") == "no_update_time").alias("untimed_items"))
    out = paging.join(values, list(by), "left").fillna(0, ["fixtures", "rows", "invalid_values", "untimed_items"])
    return out.withColumn("complete", F.col("pages_collected") == F.col("pages_available"))


# ---- line-ups -----------------------------------------------------------------------------

def wide_eleven(df: DataFrame, keep: Sequence[str], layout: str) -> DataFrame:
    """Eleven slots per side as columns -> one row per (match, side, slot)."""
    numbers, patterns = LAYOUTS[layout]
    rows = []
    for side in ("home", "away"):
        for place, n in enumerate(numbers):
            fields = [F.col(f"`{p.format(side=side, n=n)}`").cast("string").alias(name) for name, p in patterns.items()]
            rows.append(F.struct(F.lit(side).alias("side"), F.lit(place).alias("slot"), *fields))
    return df.select(*keep, F.inline(F.array(*rows)))


def roster_players(rosters: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Starters are players with a starting position; the others sit on the bench.  The position is
    the starting one, else the first listed."""
    rows = rosters.select(*keep, "team_id", "team_name", F.explode("lineup").alias("p"))
    starting = F.filter("p.positions", lambda x: x["start_reason"] == "Starting XI")
    observed = F.coalesce(F.get(starting, F.lit(0)), F.get(F.col("p.positions"), F.lit(0)))
    return rows.select(
        *keep, "team_id", "team_name", F.col("p.player_id").alias("player_id"), F.col("p.player_name").alias("player_name"), F.col("p.jersey_number").alias("shirt_number"),
        observed["position"].alias("position"), F.when(F.coalesce(F.size(starting) > 0, F.lit(False)), "starter").otherwise("substitute").alias("lineup_role"),
    )


def feed_players(lineups: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Feed line-ups -> player rows with entry and exit minutes and an estimate of minutes played."""
    def listed(side: str, role: str, field: str) -> Column:
        team = F.col(side)
        return F.transform(F.coalesce(team[field], F.array()), lambda p: F.struct(
            F.lit(side).alias("side"), team["teamId"].alias("team_id"), F.coalesce(team["mediaName"], team["officialName"]).alias("team"), F.lit(role).alias("lineup_role"), p.alias("p")))

    everyone = F.concat(*[listed(s, r, f) for s in ("home", "away") for r, f in (("starter", "fielded"), ("bench", "benched"))])
    rows = lineups.select(*keep, F.inline(everyone))
    event = lambda kind: F.get(F.filter(F.coalesce("p.events", F.array()), lambda x: x["type"] == kind), F.lit(0))
    minute = lambda e: F.when(e.isNotNull(), F.coalesce(e["time"], F.lit(0.0)) + F.coalesce(e["additionalTime"], F.lit(0.0)))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    media = full(F.concat_ws(" ", "p.mediaFirstName", "p.mediaLastName"))
    name = F.coalesce(full("p.displayName"), media, full("p.shirtName"), full("p.providerId"), F.lit("unknown-player"))
    out = rows.select(
        *keep, "side", "team_id", "team", "lineup_role", name.alias("player"), F.col("p.roleLabel").alias("role"), minute(event("substitution-in")).alias("minute_in"),
        minute(event("substitution-out")).alias("minute_out"), full("p.playerId").alias("_id"), full("p.providerId").alias("_pid"),
    )
    made = F.concat_ws("::", F.lit("missing"), "team_id", token_key("player"))
    estimate = minutes_estimate(F.col("lineup_role") == "starter", F.col("minute_in"), F.col("minute_out"))
    return out.withColumn("player_id", F.coalesce("_id", "_pid", made)).withColumn("minutes_estimated", F.coalesce(estimate, F.lit(0.0))).drop("_id", "_pid")


def parsed(rows: DataFrame, text: str, schema: str, *keep: str) -> DataFrame:
    """``keep`` and the fields of a JSON text, all NULL where it cannot be read.

    A text is parsed once a row: what a generator makes is not made again by the conditions that read it."""
    return rows.select(*keep, F.inline(F.array(F.from_json(text, schema))))


def report_players(reports: DataFrame) -> DataFrame:
    """First eleven listed players per side with the position their statistics row gives by name."""
    def side_rows(side: str) -> Column:
        stats = F.col(f"match_report.player_stats.{side}")
        names = F.transform(stats, lambda s: s["Player"])
        eleven = F.slice(F.col(f"match_report.lineups.{side}.players"), 1, 11)

        def row(player: Column, place: Column, held: Column) -> Column:
            found = F.get(stats, F.array_position(held, player["name"]).cast("int") - 1)
            return F.struct(F.lit(side).alias("side"), place.alias("slot"), player["name"].alias("player_name"), player["number"].alias("shirt_number"), found["Pos"].alias("position"))

        return once_a_row(names, lambda held: F.transform(eleven, lambda player, place: row(player, place, held)))

    rows = reports.select("id", F.inline(F.concat(side_rows("home"), side_rows("away"))))
    return rows.withColumn("role", role_from_codes("position")).withColumn("formation_grid", F.concat(F.lit("reported:"), "position"))
