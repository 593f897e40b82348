"""Data-quality gates, censuses and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import once_a_row
from ..functions.scalars import OUTCOMES
from ..functions.temporal import keep_latest, position_in_order

# Reasons of the ready-set gate.
READY_REASONS = (
    "away_starter_role_missing", "duplicate_starter", "home_starter_role_missing", "invalid_result", "missing_away_lineup", "missing_home_lineup",
)


def blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def check_rows(counters: DataFrame) -> DataFrame:
    """One-row counters -> (check, violations, status) rows."""
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in counters.columns])
    return counters.select(F.inline(rows)).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def contract_checks(df: DataFrame, required: Sequence[str], key: Sequence[str], domains: dict[str, Sequence[str]] | None = None, minimum_rows: int = 1) -> DataFrame:
    """Columns present, enough rows, unique key, values inside their domain."""
    missing = sorted(set(required).difference(df.columns))
    keyed = [c for c in key if c in df.columns]
    rules = {f"domain:{c}": ~F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in (domains or {}).items() if c in df.columns}
    flagged = df.select(*keyed, *[rule.cast("int").alias(name) for name, rule in rules.items()])
    per_key = flagged.groupBy(*keyed).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"`{name}`").alias(name) for name in rules])
    total = per_key.agg(
        F.lit(len(missing)).alias("missing_columns"), F.when(F.coalesce(F.sum("_n"), F.lit(0)) < minimum_rows, 1).otherwise(0).alias("too_few_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"), *[F.coalesce(F.sum(f"`{name}`"), F.lit(0)).alias(name) for name in rules],
    )
    names = [c.replace(":", "_") for c in total.columns]
    return check_rows(total.toDF(*names))


def lineup_array_checks(df: DataFrame, columns: Sequence[str], expected: int = 11) -> DataFrame:
    """JSON player arrays: exactly ``expected`` entries, all with an id, no id twice."""
    schema = "array<struct<player_id:string>>"
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("payload")) for c in columns])
    ids = F.transform(F.from_json("payload", schema), lambda p: p["player_id"])
    long = df.select(F.inline(rows)).withColumn("ids", ids)
    broken = F.col("ids").isNull() | F.exists("ids", lambda i: i.isNull())
    return long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("lineups"), F.count_if(broken).alias("unreadable"), F.count_if(~broken & (F.size("ids") != expected)).alias("wrong_size"),
        F.count_if(~broken & (F.size(F.array_distinct("ids")) != F.size("ids"))).alias("with_duplicates"),
    )


def temporal_store_checks(store: DataFrame, matches: DataFrame, families: Sequence[str], kickoff: str = "kickoff") -> DataFrame:
    """Blank ids, orphans, unreadable kickoffs, duplicate keys and availability rate, in one row."""
    known = store.join(matches.select("match_id").distinct().withColumn("_m", F.lit(True)), "match_id", "left")
    bad_id = blank("match_id") | blank("player_id") | blank("team_id")
    available = [F.coalesce(F.col(f"{f}_available").cast("int"), F.lit(0)) for f in families]
    usable = available[0]
    for value in available[1:]:
        usable = usable + value
    readable = F.try_to_timestamp(F.col(kickoff).cast("string"))
    per_key = known.groupBy("match_id", "player_id", "team_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad_id.cast("int")).alias("bad"), F.sum(F.col("_m").isNull().cast("int")).alias("orphans"),
        F.sum(readable.isNull().cast("int")).alias("kick"), F.sum(usable).alias("usable"),
    )
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_keys"), F.sum(F.col("n") - 1).alias("duplicate_keys"), F.sum("orphans").alias("orphan_rows"),
        F.sum("bad").alias("invalid_identifiers"), F.sum("kick").alias("invalid_kickoffs"), (F.sum("usable") / (F.sum("n") * len(families))).alias("availability_rate"),
    )


def label_counts(store: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each label occurs per column; summed map-side after one unpivot."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("label")) for c in columns])
    return store.select(F.inline(rows)).groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n"))


def numeric_checks(df: DataFrame, columns: Sequence[str], result: str = "result") -> DataFrame:
    """Infinite and missing values over all numeric columns, and whether H, D and A all occur alone."""
    infinite = nan = F.lit(0)
    for column in columns:
        value = F.col(column).cast("double")
        infinite = infinite + F.coalesce((F.abs(value) == float("inf")).cast("int"), F.lit(0))
        nan = nan + (value.isNull() | F.isnan(value)).cast("int")
    counts = [F.count_if(F.col(result) == o).alias(f"result_{o}") for o in OUTCOMES]
    return df.agg(
        F.sum(infinite).alias("infinite_values"), F.sum(nan).alias("missing_values"), *counts,
        F.count_if(~F.coalesce(F.col(result).isin(*OUTCOMES), F.lit(False))).alias("other_results"),
    )


def complete_markets(rows: DataFrame, keys: Sequence[str] = ("match_id", "bookmaker")) -> DataFrame:
    """(match, bookmaker) groups quoting all three selections."""
    return rows.groupBy(*keys).agg(F.count_distinct("selection").alias("selections")).filter("selections = 3")


def cutoff_gate(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Timestamps readable and not after the cutoff, every market complete, some eligible match."""
    valid = F.coalesce(F.col("provider_updated_at") <= F.col("prediction_cutoff"), F.lit(False))
    groups = rows.groupBy("match_id", "bookmaker").agg(
        F.count(F.lit(1)).alias("n"), F.count("provider_updated_at").alias("timed"), F.count_if(valid).alias("valid"), F.count_distinct("selection").alias("selections"))
    groups = groups.join(eligible.select("match_id").distinct().withColumn("_e", F.lit(True)), "match_id", "left")
    out = groups.agg(
        F.sum("n").alias("rows"), F.sum("timed").alias("timestamped_rows"), F.sum("valid").alias("cutoff_valid_rows"), F.count(F.lit(1)).alias("markets"),
        F.count_if(F.col("selections") == 3).alias("complete_markets"), F.count_distinct(F.when(F.col("_e"), F.col("match_id"))).alias("eligible_matches"),
    )
    passed = (F.col("rows") == F.col("timestamped_rows")) & (F.col("rows") == F.col("cutoff_valid_rows")) & (F.col("markets") == F.col("complete_markets")) & (F.col("eligible_matches") > 0)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def lineup_completeness(players: DataFrame, keys: Sequence[str] = ("match_id", "lineup_id", "team_id", "provider")) -> DataFrame:
    """Starters, starters without a position and bench size per line-up."""
    starter = F.col("lineup_role") == "starter"
    return players.groupBy(*keys).agg(
        F.count_if(starter).alias("starters"), F.count_if(starter & blank("position")).alias("starters_without_position"), F.count_if(~starter).alias("bench"))


def choose_lineups(completeness: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Complete eleven of the preferred provider, then the larger bench, then the lower id."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    rank = F.when(rank == 0, 99).otherwise(rank)
    order = Window.partitionBy("match_id", "team_id").orderBy(rank, F.col("bench").desc(), "lineup_id")
    return completeness.filter("starters = 11").withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def ready_set(matches: DataFrame, chosen: DataFrame, players: DataFrame, warmup: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(ready, quarantine with sorted reasons) for matches outside the warm-up seasons.

    ``chosen`` holds at most one line-up per (match, team); ``players`` the rows of all line-ups."""
    base = matches.filter(~F.col("season").isin(*warmup)) if warmup else matches
    # all meets on the match alone, so that neither starters nor matches move once more for their line-up or team
    picked = chosen.groupBy("match_id").agg(F.collect_list(F.struct("team_id", "provider", "lineup_id", "starters_without_position", "bench")).alias("_picked"))
    starters = players.filter("lineup_role = 'starter'").select("match_id", "lineup_id", "player_id").join(picked, "match_id")
    starters = starters.filter(F.array_contains("_picked.lineup_id", F.col("lineup_id"))).select("match_id", "player_id")
    repeated = starters.groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("match_id").distinct()
    out = base.join(repeated.withColumn("_dup", F.lit(True)), "match_id", "left").join(picked, "match_id", "left")
    of_team = lambda name: F.filter("_picked", lambda x: x["team_id"] == F.col(name))
    for side in ("home", "away"):
        out = out.withColumn("_own", F.explode_outer(of_team(f"{side}_team"))).select(
            "*", F.col("_own.provider").alias(f"{side}_lineup_provider"), F.col("_own.lineup_id").alias(f"{side}_lineup_id"),
            F.col("_own.starters_without_position").alias(f"_{side}_blank"), F.col("_own.bench").alias(f"{side}_bench_count")).drop("_own")
    out = out.select("match_id", "away_team", "home_team", *[c for c in out.columns if c not in {"match_id", "away_team", "home_team", "_picked"}])
    rules = {
        "away_starter_role_missing": F.col("_away_blank") > 0, "duplicate_starter": F.col("_dup"), "home_starter_role_missing": F.col("_home_blank") > 0,
        "invalid_result": ~F.coalesce(F.col("result").isin(*OUTCOMES), F.lit(False)), "missing_away_lineup": F.col("away_lineup_id").isNull(),
        "missing_home_lineup": F.col("home_lineup_id").isNull(),
    }
    reasons = F.array_compact(F.array(*[F.when(rules[r], F.lit(r)) for r in READY_REASONS]))
    judged = out.withColumn("reasons", reasons).drop("_dup", "_home_blank", "_away_blank")
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def coverage(matches: DataFrame, ready: DataFrame, keys: Sequence[str] = ("league", "season")) -> DataFrame:
    """Matches and ready matches per group."""
    marked = matches.join(ready.select("match_id", F.lit(True).alias("_r")), "match_id", "left")
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("_r").alias("ready"))


def constraint_violations(df: DataFrame, table: str, rules: dict[str, str], unique: Sequence[str] = ()) -> DataFrame:
    """(table, rule, violations): a rule is an SQL condition every row must meet (NULL passes, as a
    CHECK does); ``unique`` adds a key rule."""
    failing = [F.count_if(F.coalesce(~F.expr(condition), F.lit(False))).alias(f"r{i}") for i, condition in enumerate(rules.values())]
    one = df.agg(*failing) if rules else None
    parts = []
    if one is not None:
        rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
        parts.append(one.select(F.inline(rows)))
    if unique:
        parts.append(df.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit("unique:" + ",".join(unique)).alias("rule"), "violations"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(F.lit(table).alias("table_name"), "rule", "violations")


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count, sum and xor of 48-bit row digests."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(digest).alias("digest_xor"))


def file_fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Bytes and SHA-256 per input file.  A file is one row here, so this is for the small landed
    files of a manifest; tables are compared by :func:`content_fingerprint`."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifest(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that changed, vanished or appeared against a recorded manifest."""
    now = current.select("file", F.col("sha256").alias("_now"))
    then = recorded.select("file", F.col("sha256").alias("_then"))
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("_then"), "same").otherwise("changed")
    return now.join(then, "file", "full_outer").select("file", status.alias("status"))


LINEUP_PAYLOAD = "array<struct<team:struct<id:bigint,name:string>,formation:string,startXI:array<struct<player:struct<id:string,name:string,pos:string>>>,substitutes:array<struct<player:struct<id:string,name:string,pos:string>>>>>"


def payload_reasons(df: DataFrame, column: str = "lineups") -> DataFrame:
    """Why a nested line-up payload cannot be loaded; an empty array means it can."""
    sides = F.col(column)
    squads = lambda s: F.concat(F.coalesce(s["startXI"], F.array()), F.coalesce(s["substitutes"], F.array()))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "not_two_lineups": F.coalesce(F.size(sides), F.lit(-1)) != 2,
        "team_name_missing": F.exists(sides, lambda s: empty(s["team"]["name"])),
        "starters_not_eleven": F.exists(sides, lambda s: F.size(s["startXI"]) != 11),
        "player_incomplete": F.exists(sides, lambda s: F.exists(squads(s), lambda p: empty(p["player"]["id"]) | empty(p["player"]["name"]))),
    }
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])))


def report_is_valid(report: str = "match_report") -> Column:
    """At least eleven listed players per side, eleven distinct first names, each with a position."""
    def side(name: str) -> Column:
        players = F.col(f"{report}.lineups.{name}.players")
        eleven = F.transform(F.slice(players, 1, 11), lambda p: p["name"])
        placed = F.transform(F.filter(F.col(f"{report}.player_stats.{name}"), lambda s: F.coalesce(s["Pos"], F.lit("")) != ""), lambda s: s["Player"])
        return (F.size(players) >= 11) & (F.size(F.array_distinct(eleven)) == 11) & once_a_row(placed, lambda held: F.forall(eleven, lambda n: F.array_contains(held, n)))

    return F.coalesce(side("home") & side("away"), F.lit(False))


def payload_facts(df: DataFrame, column: str = "lineups") -> DataFrame:
    """Coverage facts per fixture: two line-ups, complete elevens, benches, id and position rate, formations."""
    sides = F.col(column)
    people = F.flatten(F.transform(sides, lambda s: F.concat(F.coalesce(s["startXI"], F.array()), F.coalesce(s["substitutes"], F.array()))))
    total = F.size("_people")
    share = lambda condition: F.when(total > 0, F.size(F.filter("_people", condition)) / total).otherwise(0.0)
    return df.withColumn("_people", F.transform(people, lambda p: p["player"])).withColumns({
        "team_lineups": F.size(sides),
        "complete_starting_xi": (F.size(sides) == 2) & F.forall(sides, lambda s: F.size(s["startXI"]) == 11),
        "bench_available": (F.size(sides) == 2) & F.forall(sides, lambda s: F.size(s["substitutes"]) > 0),
        "players": total, "player_id_rate": share(lambda p: p["id"].isNotNull()), "position_rate": share(lambda p: F.coalesce(p["pos"], F.lit("")) != ""),
        "formations_available": F.size(F.filter(sides, lambda s: F.coalesce(s["formation"], F.lit("")) != "")) == 2,
    }).drop("_people")


def fixture_coverage(facts: DataFrame, keys: Sequence[str] = ("league", "season")) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fixtures"), F.avg((F.col("team_lineups") == 2).cast("double")).alias("two_lineups_rate"), rate("complete_starting_xi").alias("complete_starting_xi_rate"),
        rate("bench_available").alias("bench_rate"), F.avg("player_id_rate").alias("player_id_rate"), F.avg("position_rate").alias("position_rate"), rate("formations_available").alias("formation_rate"))


def feed_audit(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Season rates of a sampled feed: complete elevens, benches, formations, ids, roles, substitutions."""
    both = lambda a, b: (a & b).cast("double")
    m = matches.groupBy("season").agg(
        F.count(F.lit(1)).alias("sampled_matches"), F.avg(both(F.col("home_starters") == 11, F.col("away_starters") == 11)).alias("complete_starting_xi_rate"),
        F.avg(both(F.col("home_bench") > 0, F.col("away_bench") > 0)).alias("bench_rate"), F.avg(F.col("formation_available").cast("double")).alias("formation_rate"))
    p = players.groupBy("season").agg(
        F.avg(F.col("player_id").isNotNull().cast("double")).alias("player_id_rate"), F.avg(F.col("role").isNotNull().cast("double")).alias("role_rate"),
        F.count_if(F.col("entered")).alias("substitutions"))
    return m.join(p, "season", "left")


def evenly_spaced(df: DataFrame, keys: Sequence[str], instant: str, order: Sequence[str], size: Column | int) -> DataFrame:
    """Deterministic, time-spread sample of ``size`` rows per group (all rows of smaller groups)."""
    placed = position_in_order(df, keys, instant, order, "_place")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = F.lit(size) if isinstance(size, int) else size
    steps = F.when(k == 1, F.array(F.floor(F.col("_n") / 2).cast("long"))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.nullif(k - 1, F.lit(0))).cast("long"))))
    chosen = totals.withColumn("_all", F.col("_n") <= k).withColumn("_steps", steps).drop("_n")
    return placed.join(chosen, list(keys)).filter(F.col("_all") | F.array_contains("_steps", F.col("_place") - 1)).drop("_all", "_steps", "_place")


def allocate(total: int, groups: Sequence[str]) -> dict[str, int]:
    """Split a sample size over groups, the remainder to the first ones."""
    base, rest = divmod(total, len(groups))
    return {g: base + (i < rest) for i, g in enumerate(groups)}


def modal_roles(df: DataFrame, name: str, role: str) -> DataFrame:
    """Most frequent role per name (alphabetical on a tie)."""
    counts = df.filter(F.col(name).isNotNull() & F.col(role).isNotNull()).groupBy(name, role).agg(F.count(F.lit(1)).alias("n"))
    return keep_latest(counts, [name], [(-F.col("n")), F.col(role)], first=True).select(name, role, "n")


def ambiguous_identities(df: DataFrame, name: str, team: str) -> tuple[DataFrame, DataFrame]:
    """(names seen with several teams, every row carrying such a name)."""
    names = df.groupBy(name).agg(F.count_distinct(team).alias("teams")).filter("teams > 1")
    return names, df.join(names.select(name), name, "left_semi")


def not_null_census(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows and non-null counts in total and per key combination, in one pass (grouping sets)."""
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns]]
    grouped = df.groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys]).agg(*counts, F.grouping_id().alias("_g"))
    return grouped.withColumn("level", F.when(F.col("_g") == 0, "group").otherwise("total")).drop("_g")


def raw_census(players: DataFrame) -> DataFrame:
    """Per provider: player rows, starters, bench, positions, shirt numbers, timing, distinct player-match pairs."""
    starter = F.col("lineup_role") == "starter"
    counts = {
        "rows": F.count(F.lit(1)), "starters": F.count_if(starter), "bench": F.count_if(~starter), "with_position": F.count_if(~blank("position")),
        "with_shirt_number": F.count("shirt_number"), "with_timing": F.count_if(F.col("timing_observed")),
        # pairs never cross matches: a set per match replaces a shuffle of every pair
        "player_matches": F.size(F.collect_set(F.when(F.col("match_id").isNotNull(), F.col("player_id")))).cast("long"),
    }
    per_match = players.groupBy("provider", "match_id").agg(*[value.alias(name) for name, value in counts.items()])
    return per_match.groupBy("provider").agg(*[F.sum(name).alias(name) for name in counts])


def mapping_coverage(matches: DataFrame, mapping: DataFrame) -> DataFrame:
    marked = matches.join(mapping.select("match_id").distinct().withColumn("_m", F.lit(1)), "match_id", "left")
    return marked.groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), F.count("_m").alias("mapped"))


def lineup_backlog(matches: DataFrame, mapping: DataFrame, lineups: DataFrame, limit: int | None = None) -> DataFrame:
    """Mapped matches that do not hold exactly two stored line-ups, oldest first."""
    stored = lineups.groupBy("match_id").agg(F.count_distinct("team_id").alias("stored"))
    open_ = matches.join(mapping.select("match_id").distinct(), "match_id", "left_semi").join(stored, "match_id", "left")
    open_ = open_.withColumn("stored", F.coalesce("stored", F.lit(0))).filter("stored <> 2")
    return open_ if limit is None else open_.orderBy("date", "match_id").limit(limit)


def season_quality(df: DataFrame, prices: Sequence[str], margin: str = "margin") -> DataFrame:
    """Games, results present, share of missing prices and mean margin per season."""
    gaps = [F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in prices]
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.count("result").alias("results"), *gaps, F.avg(margin).alias("mean_margin"))
