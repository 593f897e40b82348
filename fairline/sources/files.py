"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.temporal import keep_latest


def read_season_files(spark: SparkSession, files: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(path, season, league) CSVs stamped with season and league; columns may drift between files."""
    if not files:
        raise ValueError("no season file to read")
    frames = [
        spark.read.option("header", True).csv(path).withColumns({"Season": F.lit(season), "League": F.lit(league)}) for path, season, league in files
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_wanted(spark: SparkSession, path: str, schema: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Splittable CSV scan reduced to the wanted keys; the key side is broadcast only if small."""
    return spark.read.option("header", True).schema(schema).csv(path).join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def read_series_matches(spark: SparkSession, path: str, order: Sequence[str] = ("series_file",)) -> DataFrame:
    """Gzip Latin-1 match lists: trimmed headers, file name column, one row per id, parsed score
    ``h : a`` and UTC time in any of the known layouts."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", True).csv(path)
    named = raw.withColumn("series_file", F.regexp_replace(F.col("_metadata.file_name"), "_matches", ""))
    named = named.toDF(*[c.strip() for c in named.columns])
    require_columns(named, ["match_id", "score", "match_datetime", "home_team", "away_team"], "series matches")
    one = keep_latest(named, ["match_id"], [F.col(c) for c in order], first=True)
    goals = lambda i: F.regexp_extract("score", r"(\d+)\s*:\s*(\d+)", i).try_cast("int")
    layouts = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")
    parsed = F.coalesce(*[F.try_to_timestamp("match_datetime", F.lit(layout)) for layout in layouts])
    return one.withColumns({"home_goals": goals(1), "away_goals": goals(2), "kickoff": parsed, "match_date": F.to_date(parsed)})


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed nested schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def read_match_events(matches: DataFrame, countries: DataFrame, teams: DataFrame, wanted: dict[str, str], seasons: Sequence[str]) -> DataFrame:
    """Matches with country and both team names, for the wanted countries and seasons."""
    home = teams.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team"))
    away = teams.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team"))
    chosen = countries.filter(F.col("country").isin(*wanted))
    league = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    kept = matches.filter(F.col("season").isin(*seasons)).join(chosen, "country_id")
    return kept.join(home, "home_team_id").join(away, "away_team_id").withColumn("league", league[F.col("country")])


def paths_with_column(spark: SparkSession, paths: Sequence[str], column: str = "match_id") -> list[str]:
    """Snapshot files whose header holds the column; headers only, no data is read."""
    return [p for p in paths if column in spark.read.option("header", True).csv(p).columns]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_quarantine(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rejected rows with their reason, as JSON lines in one folder per reason."""
    require_columns(df, ["reason"], "quarantine")
    df.write.mode(mode).partitionBy("reason").json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
