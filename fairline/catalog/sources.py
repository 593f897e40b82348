"""Registered source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import finite, int_or_null, round6, season_code, season_code_from_range, season_start, utc_micros
from ..operators import quality as q
from ..plans.views import view
from ..session import staging_dir, table
from ..sources import feeds, files
from .history import matches
from .players import lineups
from .registry import query


def season_rows(spark, sf):
    """Season files as text: optional time, optional counters, one price triple per bookmaker."""
    k = F.col("match_id")
    return matches(spark, sf).select(
        F.date_format("date", "dd/MM/yyyy").alias("Date"), F.when(k % 2 == 0, F.lit("15:30")).otherwise(F.lit("")).alias("Time"), "season", "league",
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), F.col("home_goals").cast("string").alias("FTHG"),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.col("away_goals").cast("string")).alias("FTAG"), F.when(k % 23 == 0, F.lit("?")).otherwise(F.col("result")).alias("FTR"),
        F.col("home_shots").cast("string").alias("HS"), F.lit("2.0").alias("AvgCH"), (F.lit(3.0) + k % 5).cast("string").alias("AvgCD"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("4.0")).alias("AvgCA"), F.when(k % 3 == 0, F.lit("0.9")).otherwise(F.lit("1.8")).alias("B365H"),
        F.lit("3.3").alias("B365D"), F.lit("4.4").alias("B365A"), F.col("match_id").cast("string").alias("source"),
    )


@query("a1_season_files", "SELECT season, league, count(*) AS n, sum(home_goals) AS goals, count(CASE WHEN season >= '1998' THEN home_shots END) AS with_shots FROM v_match GROUP BY ALL")
def a1(spark, sf):
    root = staging_dir(spark, "seasons")
    rows = season_rows(spark, sf)
    early, late = f"{root}/early", f"{root}/late"
    rows.filter("season < '1998'").drop("HS").write.partitionBy("season", "league").option("header", True).csv(early)
    rows.filter("season >= '1998'").write.partitionBy("season", "league").option("header", True).csv(late)
    listed = sorted((r["season"], r["league"]) for r in rows.select("season", "league").distinct().collect())
    wanted = [(f"{early if s < '1998' else late}/season={s}/league={g}", s, g) for s, g in listed]
    out = files.read_season_files(spark, wanted)
    return out.groupBy(F.col("Season").alias("season"), F.col("League").alias("league")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(int_or_null("FTHG")).alias("goals"), F.count(int_or_null("HS")).alias("with_shots"))


@query("a2_wanted_scan", "SELECT match_id, player_id, slot FROM v_lineup WHERE match_id IN (SELECT match_id FROM v_match WHERE league = '2' AND season = '1998')")
def a2(spark, sf):
    path = staging_dir(spark, "lineups")
    files.write_csv(lineups(spark, sf).select("match_id", "player_id", "slot"), path)
    wanted = matches(spark, sf).filter("league = '2' AND season = '1998'")
    return files.scan_wanted(spark, path, "match_id bigint, player_id string, slot int", wanted, ["match_id"])


@query(
    "a3_series_matches",
    """SELECT match_id, home_team, home_goals, CASE WHEN match_id % 17 = 0 THEN NULL ELSE away_goals END AS away_goals, CAST(match_date AS VARCHAR) AS match_date FROM v_match""",
)
def a3(spark, sf):
    path = staging_dir(spark, "series")
    k = F.col("match_id")
    score = F.when(k % 17 == 0, F.concat(F.col("home_goals"), F.lit(" : x"))).otherwise(F.concat(F.col("home_goals"), F.lit(" : "), F.col("away_goals")))
    stamp = F.when(k % 2 == 0, F.date_format("date", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    rows = matches(spark, sf).select(k.alias("match_id "), F.col("home_team").alias(" home_team"), F.col("away_team").alias("away_team"), score.alias("score"), stamp.alias("match_datetime"))
    doubled = rows.unionByName(rows.filter("`match_id ` % 5 = 0"))
    doubled.write.option("header", True).option("encoding", "ISO-8859-1").option("compression", "gzip").csv(path)
    out = files.read_series_matches(spark, path)
    # the first pattern needs both numbers, so a broken score loses both goals
    return out.select(
        F.col("match_id").cast("long").alias("match_id"), "home_team", F.coalesce("home_goals", F.regexp_extract("score", r"^(\d+)", 1).try_cast("int")).alias("home_goals"), "away_goals",
        F.date_format("match_date", "yyyy-MM-dd").alias("match_date"))


def roster_frame(spark, sf):
    rows = lineups(spark, sf)
    spots = F.when(F.col("slot") < 11, F.array(F.struct(F.lit("Warm Up").alias("position"), F.lit("Tactical").alias("start_reason")),
                                                F.struct(F.col("position").alias("position"), F.lit("Starting XI").alias("start_reason")))).when(
        F.col("slot") < 13, F.array(F.struct(F.col("position").alias("position"), F.lit("Substitution").alias("start_reason")))).otherwise(F.array().cast("array<struct<position:string,start_reason:string>>"))
    player = F.struct((F.col("slot") + F.col("match_id") * 100).alias("player_id"), F.col("player_id").alias("player_name"), F.col("slot").alias("jersey_number"), spots.alias("positions"))
    return rows.groupBy("match_id", "side", "team").agg(F.collect_list(player).alias("lineup")).select(
        "match_id", "side", F.to_json(F.struct(F.lit(7).cast("long").alias("team_id"), F.col("team").alias("team_name"), "lineup")).alias("payload"))


@query(
    "a6_roster_players",
    """SELECT match_id, side, player_id AS player_name, CASE WHEN slot < 13 THEN position END AS position, CASE WHEN slot < 11 THEN 'starter' ELSE 'substitute' END AS lineup_role FROM v_lineup""",
)
def a6(spark, sf):
    parsed = roster_frame(spark, sf).select("match_id", "side", F.from_json("payload", feeds.ROSTER).alias("r")).select("match_id", "side", "r.*")
    return feeds.roster_players(parsed, ["match_id", "side"]).select("match_id", "side", "player_name", "position", "lineup_role")


def odds_payloads(spark, sf, current="1", total=1, *keep):
    """One page per quote: market 1 plus a decoy market and an unknown selection."""
    value = lambda name, column: F.struct(F.lit(name).alias("value"), column.cast("string").alias("odd"))
    away = F.when(F.col("seq") == 2, F.lit(1.0)).otherwise(F.col("odds_a"))
    main = F.struct(F.lit(1).alias("id"), F.array(value("Home", F.col("odds_h")), value("Draw", F.col("odds_d")), value("Away", away), value("Other", F.lit(9.0))).alias("values"))
    decoy = F.struct(F.lit(5).alias("id"), F.array(value("Home", F.lit(8.0))).alias("values"))
    book = F.struct(F.col("seq").alias("id"), F.col("bookmaker").alias("name"), F.array(main, decoy).alias("bets"))
    item = F.struct(
        F.struct(F.lit(1).alias("id"), F.lit(2024).alias("season")).alias("league"), F.struct(F.col("match_id").alias("id"), F.lit("2024-01-01T15:00:00+00:00").alias("date")).alias("fixture"),
        F.date_format("quoted_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("update"), F.array(book).alias("bookmakers"))
    page = F.struct(F.array().cast("array<string>").alias("errors"), F.struct(F.expr(current).cast("int").alias("current"), F.lit(total).alias("total")).alias("paging"), F.array(item).alias("response"))
    return view(spark, sf, "v_quote").select(*map(F.expr, keep), F.to_json(page).alias("payload"))


@query(
    "a5_odds_pages",
    """u AS (SELECT match_id, bookmaker, seq, quoted_at, 'H' AS selection, odds_h AS odds FROM v_quote UNION ALL SELECT match_id, bookmaker, seq, quoted_at, 'D', odds_d FROM v_quote UNION ALL SELECT match_id, bookmaker, seq, quoted_at, 'A', CASE WHEN seq = 2 THEN 1.0e0 ELSE odds_a END FROM v_quote)
 SELECT CAST(match_id AS VARCHAR) AS provider_fixture_id, bookmaker, selection, count(*) AS n, r4(sum(odds)) AS odds, epoch_us(max(quoted_at)) AS updated FROM u WHERE odds > 1 GROUP BY ALL""",
)
def a5(spark, sf):
    pages = odds_payloads(spark, sf).select(F.from_json("payload", feeds.ODDS_PAGE).alias("p")).select("p.*")
    rows, _ = feeds.odds_pages(pages)
    return rows.groupBy("provider_fixture_id", "bookmaker", "selection").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("decimal_odds"), 4).alias("odds"), F.unix_micros(F.max("provider_updated_at")).alias("updated"))


@query("a5_rejected_prices", "SELECT bookmaker, 'price_not_above_one' AS reason, count(*) AS n FROM v_quote WHERE seq = 2 GROUP BY bookmaker")
def a5_rejected(spark, sf):
    pages = odds_payloads(spark, sf).select(F.from_json("payload", feeds.ODDS_PAGE).alias("p")).select("p.*")
    return feeds.odds_pages(pages)[1].groupBy("bookmaker", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a5_page_manifest",
    """SELECT match_id AS collection, 7 AS pages_available, count(DISTINCT seq) AS pages_collected, count(DISTINCT seq) = 7 AS complete, 1 AS fixtures, 3 * count(*) - count(CASE WHEN seq = 2 THEN 1 END) AS rows,
 count(CASE WHEN seq = 2 THEN 1 END) AS invalid_values, 0 AS untimed_items FROM v_quote GROUP BY match_id""",
)
def a5_manifest(spark, sf):
    pages = odds_payloads(spark, sf, "seq", 7, "match_id AS collection").select("collection", F.from_json("payload", feeds.ODDS_PAGE).alias("p")).select("collection", "p.*")
    return feeds.odds_manifest(pages, ["collection"])


def feed_payloads(spark, sf):
    # a match's narrow rows move once; its JSON texts are made and put together where they lie
    rows = lineups(spark, sf).repartition("match_id")
    event = lambda kind, minute: F.when(minute.isNotNull(), F.array(F.struct(F.lit(kind).alias("type"), minute.alias("time"), F.lit(1.0).alias("additionalTime"))))
    none = F.array().cast("array<struct<type:string,time:double,additionalTime:double>>")
    events = F.coalesce(event("substitution-in", F.col("minute_in")), event("substitution-out", F.col("minute_out")), none)
    player = F.struct(
        F.when(F.col("slot") % 5 != 4, F.col("player_id")).alias("playerId"), F.when(F.col("slot") % 5 == 4, F.when(F.col("slot") != 9, F.concat(F.lit("p-"), "player_id"))).alias("providerId"),
        F.when(F.col("slot") % 4 != 3, F.col("player_id")).alias("displayName"), F.when(F.col("slot") % 4 == 3, F.lit("Media")).alias("mediaFirstName"),
        F.when(F.col("slot") % 4 == 3, F.col("player_id")).alias("mediaLastName"), F.col("position").alias("roleLabel"), events.alias("events"))
    side = rows.groupBy("match_id", "side", "team").agg(
        F.collect_list(F.when(F.col("slot") < 11, player)).alias("fielded"), F.collect_list(F.when(F.col("slot") >= 11, player)).alias("benched"))
    packed = F.struct(F.col("team").alias("teamId"), F.col("team").alias("mediaName"), F.lit("4-4-2").alias("tacticalFormation"), "fielded", "benched")
    both = side.groupBy("match_id").agg(F.max(F.when(F.col("side") == "home", F.to_json(packed))).alias("h"), F.max(F.when(F.col("side") == "away", F.to_json(packed))).alias("a"))
    return both.select("match_id", F.concat(F.lit('{"home":'), "h", F.lit(',"away":'), "a", F.lit("}")).alias("payload"))


@query(
    "a7_feed_players",
    """SELECT match_id, side, lineup_role, CASE WHEN slot % 4 = 3 THEN concat('Media ', player_id) ELSE player_id END AS player,
 CASE WHEN slot % 5 <> 4 THEN player_id WHEN slot <> 9 THEN concat('p-', player_id) ELSE concat('missing::', team, '::', replace(lower(player_id), '-', ' ')) END AS player_id, r6(minute_in + 1) AS minute_in,
 r6(CASE WHEN lineup_role = 'starter' THEN least(coalesce(minute_out + 1, 90), 90) WHEN minute_in IS NOT NULL THEN 90 - least(minute_in + 1, 90) ELSE 0 END) AS minutes_estimated FROM v_lineup""",
)
def a7(spark, sf):
    parsed = feed_payloads(spark, sf).select("match_id", F.from_json("payload", feeds.FEED_LINEUP).alias("l")).select("match_id", "l.*")
    out = feeds.feed_players(parsed, ["match_id"])
    return out.select("match_id", "side", "lineup_role", "player", "player_id", round6("minute_in").alias("minute_in"), round6("minutes_estimated").alias("minutes_estimated"))


def wide_frame(spark, sf, layout):
    numbers, patterns = feeds.LAYOUTS[layout]
    rows = lineups(spark, sf).filter("slot < 11")
    source = {"player_id": F.col("player_id"), "player_name": F.col("player_id"), "position": F.col("position"), "x": F.col("slot").cast("string"), "y": (F.col("slot") + 1).cast("string")}
    measures = []
    for side in ("home", "away"):
        for place, n in enumerate(numbers):
            for name, pattern in patterns.items():
                measures.append(F.max(F.when((F.col("side") == side) & (F.col("slot") == place), source[name])).alias(pattern.format(side=side, n=n)))
    return rows.groupBy("match_id").agg(*measures)


ELEVEN = "FROM (SELECT match_id, side, unnest(range(11)) AS slot FROM (SELECT DISTINCT match_id, side FROM v_lineup)) g LEFT JOIN v_lineup l USING (match_id, side, slot)"


@query("a8_wide_named_slots", f"SELECT match_id, side, CAST(slot AS INT) AS slot, player_id AS player_name, CASE WHEN slot = 10 THEN 'G' WHEN slot >= 6 THEN 'D' WHEN slot >= 2 THEN 'M' ELSE 'F' END AS role {ELEVEN}")
def a8(spark, sf):
    out = feeds.wide_eleven(wide_frame(spark, sf, "named_slots"), ["match_id"], "named_slots")
    return out.withColumn("role", feeds.role_from_slot("slot"))


@query("a8_wide_coordinates", f"SELECT match_id, side, CAST(slot AS INT) AS slot, player_id, CASE WHEN player_id IS NULL THEN NULL WHEN slot = 0 THEN 'G' WHEN slot < 5 THEN 'D' WHEN slot < 8 THEN 'M' ELSE 'F' END AS role {ELEVEN}")
def a8_coordinates(spark, sf):
    out = feeds.wide_eleven(wide_frame(spark, sf, "coordinates"), ["match_id"], "coordinates")
    return out.select("match_id", "side", "slot", "player_id", feeds.role_from_depth("y").alias("role"))


@query("a8_wide_positions", f"SELECT match_id, side, CAST(slot AS INT) AS slot, player_id AS player_name, CASE WHEN position = 'Goalkeeper' THEN 'G' WHEN position = 'Centre-Back' THEN 'D' WHEN position = 'Central Midfield' THEN 'M' WHEN position = 'Left Winger' THEN 'F' END AS role {ELEVEN}")
def a8_positions(spark, sf):
    out = feeds.wide_eleven(wide_frame(spark, sf, "named_positions"), ["match_id"], "named_positions")
    return out.select("match_id", "side", "slot", "player_name", feeds.role_from_name("position").alias("role"))


@query(
    "a9_relational_source",
    """SELECT o_orderkey AS match_id, concat('L', CAST(n_regionkey AS VARCHAR)) AS league, h.s_name AS home_team, a.s_name AS away_team FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 JOIN supplier h ON h.s_suppkey = o_orderkey % 10 JOIN supplier a ON a.s_suppkey = (o_orderkey + 3) % 10 WHERE n_regionkey IN (0, 1, 2) AND year(o_orderdate) IN (1996, 1997)""",
)
def a9(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    games = orders.select(
        F.col("o_orderkey").alias("match_id"), F.col("c_nationkey").alias("country_id"), F.year("o_orderdate").cast("string").alias("season"), (F.col("o_orderkey") % 10).alias("home_team_id"),
        ((F.col("o_orderkey") + 3) % 10).alias("away_team_id"))
    countries = table(spark, sf, "nation").select(F.col("n_nationkey").alias("country_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("country"))
    teams = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team_name"))
    out = files.read_match_events(games, countries, teams, {"R0": "L0", "R1": "L1", "R2": "L2"}, ["1996", "1997"])
    return out.select("match_id", "league", "home_team", "away_team")


@query(
    "a10_bookmaker_triples",
    """SELECT match_id AS source, 'Market Average' AS bookmaker, 'closing' AS timing, r6(3.0e0 + match_id % 5) AS odds_d FROM v_match WHERE match_id % 7 <> 0 UNION ALL SELECT match_id, 'Bet365', 'opening', 3.3e0 FROM v_match WHERE match_id % 3 <> 0""",
)
def a10(spark, sf):
    out = feeds.bookmaker_snapshots(season_rows(spark, sf), ["source"])
    return out.select(F.col("source").cast("long").alias("source"), "bookmaker", "timing", round6("odds_d").alias("odds_d"))


def line_numbers(items):
    """Bookmakers of the price series: a short list, by number."""
    return [str(r[0]) for r in items.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]


@query(
    "a11_cutoff_snapshot",
    """w AS (SELECT l_orderkey AS match_id, l_linenumber AS b, 1.2e0 + l_quantity / 20 AS h, CASE WHEN l_linenumber = 3 THEN 1.0e0 ELSE 2.5e0 + l_discount * 10 END AS d, 1.5e0 + l_tax * 40 AS a FROM lineitem),
 p AS (SELECT match_id, b, max(h) AS h, max(d) AS d, max(a) AS a FROM w GROUP BY ALL), k AS (SELECT p.*, m.match_date FROM p JOIN v_match m USING (match_id) WHERE d > 1)
 SELECT match_id, CAST(b AS VARCHAR) AS bookmaker, 'H' AS selection, r6(h) AS odds, epoch_us(CAST(match_date AS TIMESTAMP)) - 3600000000 AS updated FROM k UNION ALL SELECT match_id, CAST(b AS VARCHAR), 'D', r6(d), epoch_us(CAST(match_date AS TIMESTAMP)) - 3600000000 FROM k
 UNION ALL SELECT match_id, CAST(b AS VARCHAR), 'A', r6(a), epoch_us(CAST(match_date AS TIMESTAMP)) - 3600000000 FROM k""",
)
def a11(spark, sf):
    items = table(spark, sf, "lineitem")
    price = {"home": F.lit(1.2) + F.col("l_quantity") / 20, "draw": F.when(F.col("l_linenumber") == 3, 1.0).otherwise(F.lit(2.5) + F.col("l_discount") * 10), "away": F.lit(1.5) + F.col("l_tax") * 40}
    books = line_numbers(items)
    measures = [F.max(F.when(F.col("l_linenumber") == int(b), p)).alias(f"{s}_b{n}_70") for n, b in enumerate(books, start=1) for s, p in price.items()]
    series = items.groupBy(F.col("l_orderkey").alias("match_id")).agg(*measures)
    mapped = matches(spark, sf).select(F.col("match_id").alias("source_id"), "match_id", F.col("date").cast("timestamp").alias("kickoff"))
    out = feeds.cutoff_snapshot(series, mapped, books)
    return out.select("match_id", "bookmaker", "selection", round6("odds").alias("odds"), F.unix_micros("provider_updated_at").alias("updated"))


@query("a12_table_sinks", "SELECT league, season, count(*) AS n, sum(home_goals) AS goals FROM v_match GROUP BY ALL")
def a12(spark, sf):
    root = staging_dir(spark, "sinks")
    games = matches(spark, sf).select("match_id", "league", "season", "home_goals")
    files.write_table(games, f"{root}/table", ["league", "season"])
    files.write_csv(games, f"{root}/csv")
    stored = spark.read.schema("match_id bigint, home_goals int, league string, season string").parquet(f"{root}/table")
    text = spark.read.option("header", True).schema("match_id bigint, league string, season string, home_goals int").csv(f"{root}/csv")
    both = stored.join(text.select("match_id", F.col("home_goals").alias("_g")), "match_id").filter("home_goals = _g")
    return both.groupBy("league", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query("a13_quarantine_sink", "SELECT CASE WHEN match_id % 2 = 0 THEN 'even' ELSE 'odd' END AS reason, count(*) AS n FROM v_match WHERE result = 'D' GROUP BY 1")
def a13(spark, sf):
    path = staging_dir(spark, "quarantine")
    rejected = matches(spark, sf).filter("result = 'D'").select("match_id", F.when(F.col("match_id") % 2 == 0, "even").otherwise("odd").alias("reason"))
    files.write_quarantine(rejected, path)
    return spark.read.schema("match_id bigint, reason string").json(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a14_metrics_json", "SELECT league, count(*) AS n FROM v_match GROUP BY league")
def a14(spark, sf):
    path = staging_dir(spark, "metrics")
    files.write_metrics(matches(spark, sf).groupBy("league").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("league string, n bigint").json(path)


@query("a15_snapshot_selection", "SELECT count(*) AS files, sum(n) AS rows FROM (SELECT count(*) AS n FROM v_match UNION ALL SELECT count(*) FROM v_match WHERE league = '1') t")
def a15(spark, sf):
    root = staging_dir(spark, "snapshots")
    games = matches(spark, sf)
    files.write_csv(games.select("match_id", "league"), f"{root}/a")
    files.write_csv(games.select(F.col("match_id").alias("external"), "league"), f"{root}/b")
    files.write_csv(games.filter("league = '1'").select("match_id", "season"), f"{root}/c")
    chosen = files.paths_with_column(spark, [f"{root}/{n}" for n in "abc"])
    rows = spark.read.option("header", True).csv(chosen[0]).select("match_id")
    for path in chosen[1:]:
        rows = rows.unionByName(spark.read.option("header", True).csv(path).select("match_id"))
    return rows.agg(F.lit(len(chosen)).cast("long").alias("files"), F.count(F.lit(1)).alias("rows"))


@query(
    "b1_season_contract",
    """SELECT match_id AS source, concat(CAST(match_date AS VARCHAR), CASE WHEN match_id % 2 = 0 THEN ' 15:30' ELSE ' 00:00' END) AS kickoff, CASE WHEN match_id % 23 <> 0 THEN result END AS result, home_goals, CASE WHEN match_id % 19 <> 0 THEN away_goals END AS away_goals, home_shots,
 substr(sha256(concat(league, '|', season, '|', CAST(match_date AS VARCHAR), '|', home_team, '|', away_team)), 1, 24) AS provider_match_id FROM v_match""",
)
def b1(spark, sf):
    raw = season_rows(spark, sf).withColumnsRenamed({"season": "Season", "league": "League"})
    out = feeds.season_matches(raw)
    return out.select(F.col("source").cast("long").alias("source"), F.date_format("date", "yyyy-MM-dd HH:mm").alias("kickoff"), "result", "home_goals", "away_goals", "home_shots", "provider_match_id")


@query("b2_natural_key", "SELECT DISTINCT substr(sha256(concat(league, '|', season, '|', CAST(match_date AS VARCHAR), '|', home_team, '|', away_team)), 1, 24) AS id FROM v_match")
def b2(spark, sf):
    raw = season_rows(spark, sf).withColumnsRenamed({"season": "Season", "league": "League"})
    return feeds.season_matches(raw).select(F.col("provider_match_id").alias("id")).distinct()


@query(
    "b15_roles",
    """SELECT position_original AS position, CASE WHEN position_original = 'Goalkeeper' THEN 'G' WHEN position_original IN ('Centre-Back', 'Right-Back') THEN 'D' WHEN position_original LIKE '%Midfield' THEN 'M' WHEN position_original = 'Left Winger' THEN 'F' END AS by_name,
 CASE line % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'F' END AS by_codes, count(*) AS n FROM v_obs GROUP BY ALL""",
)
def b15(spark, sf):
    kind = F.col("line") % 4
    codes = F.when(kind == 0, F.lit("gk")).when(kind == 1, F.lit("MF, CB")).when(kind == 2, F.lit("fw,cm")).otherwise(F.lit("ST"))
    rows = view(spark, sf, "v_obs").select(F.col("position_original").alias("position"), feeds.role_from_name("position_original").alias("by_name"), feeds.role_from_codes(codes).alias("by_codes"))
    return rows.groupBy("position", "by_name", "by_codes").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b17_season_codes",
    """SELECT DISTINCT season, concat(substr(season, 3, 2), lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0')) AS code, CAST(season AS INT) AS from_code, CAST(season AS INT) AS from_slash,
 concat(substr(season, 3, 2), lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0')) AS from_range FROM v_match""",
)
def b17(spark, sf):
    year = F.col("season").cast("int")
    code = season_code(year)
    following = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    return matches(spark, sf).select(
        "season", code.alias("code"), season_start(code).alias("from_code"), season_start(F.concat(F.col("season"), F.lit("/"), following)).alias("from_slash"),
        season_code_from_range(F.concat(F.col("season"), F.lit("/"), (year + 1).cast("string"))).alias("from_range")).distinct()


@query("b18_utc_instants", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000 AS micros, 1 AS same FROM events")
def b18(spark, sf):
    rows = table(spark, sf, "events").withColumn("at", F.date_trunc("second", "ts"))
    naive = F.date_format("at", "yyyy-MM-dd HH:mm:ss")
    shifted = F.concat(F.date_format(F.col("at") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
    return rows.select("event_id", utc_micros(naive).alias("micros"), (utc_micros(naive) == utc_micros(shifted)).cast("int").alias("same"))


@query("b23_drop_infinite", "SELECT l_returnflag, count(*) AS n, r4(sum(CASE WHEN l_linenumber = 1 OR l_linenumber = 2 THEN NULL ELSE l_quantity END)) AS total FROM lineitem WHERE l_linenumber NOT IN (1, 2) GROUP BY l_returnflag")
def b23(spark, sf):
    score = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = table(spark, sf, "lineitem").withColumn("score", finite(score)).dropna(subset=["score"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("b24_tolerant_numbers", "SELECT l_linenumber AS line, count(*) AS n, CAST(sum(CASE WHEN l_linenumber <> 4 THEN CAST(floor(l_quantity) AS INT) END) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def b24(spark, sf):
    text = F.when(F.col("l_linenumber") == 4, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.sum(int_or_null(text)).alias("total"))


def report_frame(spark, sf):
    # a match's narrow rows move once; its JSON texts are made and put together where they lie
    rows = lineups(spark, sf).repartition("match_id")
    name = F.when((F.col("slot") == 1) & (F.col("match_id") % 5 == 0), F.concat(F.col("team"), F.lit("-twin"))).when((F.col("slot") == 2) & (F.col("match_id") % 5 == 0), F.concat(F.col("team"), F.lit("-twin"))).otherwise(F.col("player_id"))
    entry = F.struct(F.col("slot").alias("slot"), name.alias("name"), F.coalesce(F.when(F.col("position") == "Goalkeeper", "GK").when(F.col("position") == "Centre-Back", "CB,RB").when(F.col("position") == "Central Midfield", "CM"), F.lit("LW")).alias("pos"))
    side = rows.groupBy("match_id", "side").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    part = F.to_json(F.struct(F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["slot"].alias("number"))).alias("players")))
    stats = F.to_json(F.transform("e", lambda x: F.struct(x["name"].alias("Player"), x["pos"].alias("Pos"))))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, c))
    wide = side.groupBy("match_id").agg(pick("home", part).alias("hl"), pick("away", part).alias("al"), pick("home", stats).alias("hs"), pick("away", stats).alias("as"))
    return wide.select(F.concat(
        F.lit('{"id":"'), F.col("match_id").cast("string"), F.lit('","match_report":{"lineups":{"home":'), "hl", F.lit(',"away":'), "al", F.lit('},"player_stats":{"home":'), "hs", F.lit(',"away":'), "as", F.lit("}}}")).alias("value"))


@query(
    "a4_report_lines",
    "SELECT CAST(match_id AS VARCHAR) AS id, count(*) FILTER (WHERE side = 'home') AS home_listed, count(*) FILTER (WHERE side = 'away') AS away_listed FROM v_lineup GROUP BY match_id",
)
def a4(spark, sf):
    path = staging_dir(spark, "reports")
    report_frame(spark, sf).write.option("compression", "gzip").text(path)
    out = files.read_reports(spark, path, feeds.REPORT)
    return out.select("id", F.size("match_report.lineups.home.players").cast("long").alias("home_listed"), F.size("match_report.lineups.away.players").cast("long").alias("away_listed"))


def parsed_reports(spark, sf):
    return report_frame(spark, sf).select(F.from_json("value", feeds.REPORT).alias("r")).select("r.*")


@query(
    "j28_report_positions",
    """e AS (SELECT match_id, side, slot, position, row_number() OVER (PARTITION BY match_id, side ORDER BY slot) - 1 AS place FROM v_lineup WHERE match_id % 5 <> 0)
 SELECT CAST(match_id AS VARCHAR) AS id, side, count(*) AS n, count(CASE WHEN position = 'Goalkeeper' THEN 1 END) AS g, count(CASE WHEN position = 'Centre-Back' THEN 1 END) AS d, count(CASE WHEN position = 'Central Midfield' THEN 1 END) AS m,
 count(CASE WHEN position = 'Left Winger' OR position IS NULL THEN 1 END) AS f FROM e WHERE place < 11 GROUP BY ALL""",
)
def j28(spark, sf):
    out = feeds.report_players(parsed_reports(spark, sf).filter("cast(id AS bigint) % 5 <> 0"))
    return out.groupBy("id", "side").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("role") == r).alias(r.lower()) for r in "GDMF"])


@query("q10_report_validity", "SELECT CAST(match_id AS VARCHAR) AS id, CAST(match_id % 5 <> 0 AS INT) AS valid FROM v_match")
def q10(spark, sf):
    return parsed_reports(spark, sf).select("id", q.report_is_valid().cast("int").alias("valid"))
