"""Market analytics: margin removal, snapshot rows, calibration and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require_columns
from ..functions.quantiles import exact_quantiles
from ..functions.scalars import (
    OUTCOMES,
    PROBABILITY_FLOOR,
    arange_edges,
    argmax_label,
    brier_row,
    clip,
    cut,
    fair_probability,
    log_loss_row,
    number_or_null,
    overround,
)
from ..functions.temporal import keep_latest

# Order of preference of closing and opening price triples, and price bands.
ODDS_TRIPLES = (
    ("AvgCH", "AvgCD", "AvgCA"),
    ("PSCH", "PSCD", "PSCA"),
    ("B365CH", "B365CD", "B365CA"),
    ("AvgH", "AvgD", "AvgA"),
    ("B365H", "B365D", "B365A"),
)
PRICE_BANDS = (1.01, 1.10, 1.20, 1.30, 1.40, 1.50, 1.60, 1.70, 1.80, 1.90, 2.00, 2.50, 3.00, 4.00, 5.00, float("inf"))
SELECTION_KEY = ("match_id", "bookmaker", "market", "selection", "opening_or_closing")
SNAPSHOT_KEY = ("match_id", "bookmaker", "market", "timestamp", "opening_or_closing")
PROBABILITIES = {"H": "p_home", "D": "p_draw", "A": "p_away"}


def find_odds_columns(df: DataFrame, preference: Sequence[tuple[str, str, str]] = ODDS_TRIPLES) -> tuple[str, str, str]:
    """First complete price triple by preference; looks at the schema only."""
    for triple in preference:
        if set(triple).issubset(df.columns):
            return triple
    raise ValueError("no complete price triple")


def remove_margin(df: DataFrame, home: str, draw: str, away: str) -> DataFrame:
    """Add proportional fair probabilities, overround and margin."""
    prices = [number_or_null(c) for c in (home, draw, away)]
    out = df.withColumn("overround", overround(*prices))
    for name, price in zip(PROBABILITIES.values(), prices, strict=True):
        out = out.withColumn(name, fair_probability(price, "overround"))
    return out.withColumn("margin", F.col("overround") - 1.0)


def prepare_matches(df: DataFrame) -> DataFrame:
    """Valid results with three prices above one, as probabilities."""
    triple = find_odds_columns(df)
    require_columns(df, ["Date", "HomeTeam", "AwayTeam", "FTR", "Season", "League"], "matches")
    clean = df.select("Date", "HomeTeam", "AwayTeam", "FTR", "Season", "League", *[number_or_null(c).alias(c) for c in triple])
    clean = clean.filter(F.col("FTR").isin(*OUTCOMES))
    for price in triple:
        clean = clean.filter(F.col(price) > 1)
    return (
        remove_margin(clean, *triple)
        .withColumn("odds_source", F.lit("/".join(triple)))
        .withColumn("Date", F.coalesce(*[F.try_to_timestamp("Date", F.lit(p)) for p in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")]))
    )


def to_long_calibration(df: DataFrame, result: str = "FTR", season: str = "Season") -> DataFrame:
    """One row per outcome: forecast probability and whether it happened."""
    names = {"H": "Home", "D": "Draw", "A": "Away"}
    rows = [
        F.struct(
            F.col(p).alias("predicted_probability"),
            (F.col(result) == k).cast("int").alias("occurred"),
            F.lit(names[k]).alias("outcome"),
        )
        for k, p in PROBABILITIES.items()
    ]
    return df.select(F.inline(F.array(*rows)), F.col(season).alias("season"))


def calibration_table(long: DataFrame, bin_width: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    binned = long.withColumn("bin", cut("predicted_probability", arange_edges(bin_width))).filter("bin IS NOT NULL")
    table = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("predicted_probability").alias("predicted_probability"),
        F.avg(F.col("occurred").cast("double")).alias("actual_frequency"),
    )
    return table.withColumn("calibration_error", F.col("actual_frequency") - F.col("predicted_probability"))


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    weighted = F.sum(F.col("observations") * F.abs("calibration_error"))
    return table.groupBy(*by).agg(F.try_divide(weighted, F.sum("observations")).alias("expected_calibration_error"))


def match_metrics(df: DataFrame, by: Sequence[str] = (), result: str = "FTR") -> DataFrame:
    """Matches, argmax accuracy, log loss, multiclass Brier and mean margin; empty input gives no row."""
    hit = (argmax_label(list(PROBABILITIES.values())) == F.col(result)).cast("double")
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.avg(hit).alias("accuracy"),
            F.avg(log_loss_row(result, PROBABILITIES)).alias("log_loss"),
            F.avg(brier_row(result, PROBABILITIES)).alias("brier_score"),
            F.avg("margin").alias("average_margin"),
        )
        .filter("matches > 0")
    )


def normalize_snapshots(wide: DataFrame, prices: dict[str, str], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Wide price triples -> (long rows with raw, implied probability and margin; rejected rows).

    Margin is removed before unpivoting, so no shuffle is needed and sums have one order."""
    valid = F.lit(True)
    for column in prices.values():
        valid = valid & F.coalesce(F.col(column) > 1, F.lit(False))
    total = overround(*prices.values())
    rows = [
        F.struct(
            F.lit(selection).alias("selection"),
            F.col(column).alias("odds"),
            (1.0 / F.col(column)).alias("raw_probability"),
            fair_probability(column, total).alias("implied_probability"),
            (total - 1.0).alias("margin"),
        )
        for selection, column in prices.items()
    ]
    accepted = wide.filter(valid).select(*keep, F.inline(F.array(*rows)))
    rejected = wide.filter(~valid).withColumn("reason", F.lit("price_not_above_one"))
    return accepted, rejected


def normalize_long_snapshots(odds: DataFrame, keys: Sequence[str], price: str = "odds") -> tuple[DataFrame, DataFrame]:
    """The same for prices that already arrive one per row."""
    valid = F.coalesce(F.col(price) > 1, F.lit(False))
    snapshot = Window.partitionBy(*keys)
    total = F.sum(1.0 / F.col(price)).over(snapshot)
    accepted = (
        odds.filter(valid)
        .withColumn("_total", total)
        .withColumn("raw_probability", 1.0 / F.col(price))
        .withColumn("implied_probability", F.col("raw_probability") / F.col("_total"))
        .withColumn("margin", F.col("_total") - 1.0)
        .drop("_total")
    )
    return accepted, odds.filter(~valid).withColumn("reason", F.lit("price_not_above_one"))


def star_odds(
    odds: DataFrame, matches: DataFrame, bookmakers: DataFrame, providers: DataFrame, leagues: DataFrame, teams: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """Facts with their dimensions; results stay optional.  Catalyst picks broadcasts from sizes."""
    home = teams.select(F.col("team_id").alias("home_team_id"), F.col("team_name").alias("home_team"))
    away = teams.select(F.col("team_id").alias("away_team_id"), F.col("team_name").alias("away_team"))
    described = matches.join(leagues, "league_id").join(home, "home_team_id").join(away, "away_team_id")
    described = described.join(results, "match_id", "left")
    return odds.join(bookmakers, "bookmaker_id").join(providers, "provider_id").join(described, "match_id")


def analytics_rows(odds: DataFrame, order: Sequence[Column], bin_width: float = 0.05) -> DataFrame:
    """One analysis row per bookmaker selection and snapshot.

    Opening and closing rows are reduced to the last per selection; every ``snapshot`` row stays.
    ``order`` defines "last" completely."""
    require_columns(odds, [*SELECTION_KEY, "timestamp", "odds", "implied_probability", "margin", "result"], "odds")
    fixed = F.col("opening_or_closing").isin("opening", "closing")
    kept = keep_latest(odds.filter(fixed), SELECTION_KEY, order).unionByName(odds.filter(~fixed))
    snapshot = Window.partitionBy(*SNAPSHOT_KEY)
    correct = F.coalesce(F.col("selection") == F.col("result"), F.lit(False))
    probability = clip("implied_probability", PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    return (
        kept.withColumn("prediction_correct", correct)
        .withColumn("favorite", F.col("implied_probability") == F.max("implied_probability").over(snapshot))
        .withColumn("favorite_won", F.col("favorite") & F.col("prediction_correct"))
        .withColumn("calibration_bin", cut("implied_probability", arange_edges(bin_width)))
        .withColumn("logloss_contribution", -F.ln(F.max(F.when(F.col("prediction_correct"), probability)).over(snapshot)))
        .withColumn(
            "brier_contribution",
            # summed as whole units of 1e-12, so the result does not depend on the order of rows
            F.sum(F.round(F.pow(probability - F.col("prediction_correct").cast("double"), 2) * 1e12).cast("long")).over(snapshot) / 1e12,
        )
        .withColumn("roi", F.when(F.col("prediction_correct"), F.col("odds") - 1.0).otherwise(-1.0))
    )


def _bin_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums per (group, calibration bin), from which all selection metrics follow."""
    actual = F.col("prediction_correct").cast("double")
    p = F.col("implied_probability")
    return rows.groupBy(*by, "calibration_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("sum_p"),
        F.sum(p * p).alias("sum_pp"),
        F.sum(actual).alias("hits"),
        F.count(F.when(F.col("favorite"), 1)).alias("favorites"),
        F.count(F.when(F.col("favorite_won"), 1)).alias("favorites_won"),
        F.sum("logloss_contribution").alias("sum_ll"),
        F.count("logloss_contribution").alias("n_ll"),
        F.sum("brier_contribution").alias("sum_brier"),
        F.sum("margin").alias("sum_margin"),
    )


def selection_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Selection-level metrics per group: first per calibration bin, then merged, so the
    second shuffle carries one row per (group, bin)."""
    return _merge_bins(_bin_sums(rows, by), by)


def _merge_bins(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.sum("n")
    mean_p = F.sum("sum_p") / total
    in_bin = F.col("calibration_bin").isNotNull()
    gap = F.sum(F.when(in_bin, F.abs(F.col("sum_p") - F.col("hits"))))
    return bins.groupBy(*by).agg(
        total.alias("predictions"),
        F.try_divide(F.sum("favorites_won"), F.sum("favorites")).alias("accuracy"),
        F.try_divide(F.sum("sum_ll"), F.sum("n_ll")).alias("log_loss"),
        (F.sum("sum_brier") / total).alias("brier_score"),
        (F.sum("hits") / total - mean_p).alias("calibration_error"),
        F.try_divide(gap, F.sum(F.when(in_bin, F.col("n")))).alias("expected_calibration_error"),
        (F.sum("sum_margin") / total).alias("average_overround"),
        (F.sum("sum_pp") / total - mean_p * mean_p).alias("sharpness"),
    )


def compare_bookmakers(rows: DataFrame) -> DataFrame:
    """Rank bookmakers on selections that all of them quote (on everything if there are none).

    The rows are read once: each gets the number of bookmakers that quote its selection, and sums per (bookmaker, number, bin)
    hold all that the choice and the metrics need."""
    key = ["match_id", "market", "selection", "opening_or_closing"]
    quoting = F.size(F.collect_set("bookmaker").over(Window.partitionBy(*key)))
    bins = _bin_sums(rows.withColumn("quoting", quoting), ["bookmaker", "quoting"])
    # some rows per bookmaker from here on
    everything = Window.partitionBy()
    bins = bins.withColumns({"_everyone": F.size(F.collect_set("bookmaker").over(everything)), "_most": F.max("quoting").over(everything)})
    measured = _merge_bins(bins.filter((F.col("quoting") == F.col("_everyone")) | (F.col("_most") < F.col("_everyone"))), ["bookmaker"])
    # one row per bookmaker here
    return measured.withColumn("rank", F.rank().over(Window.orderBy("log_loss")))


def compare_leagues(rows: DataFrame) -> DataFrame:
    return selection_metrics(rows, ["league"])


def price_bands(rows: DataFrame, edges: Sequence[float] = PRICE_BANDS) -> DataFrame:
    """Calibration and flat-stake return by left-closed price band."""
    labels = [f"{a:.2f}+" if b == float("inf") else f"{a:.2f}-{b:.2f}" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    banded = rows.withColumn("odds_range", cut("odds", edges, labels, right=False)).filter("odds_range IS NOT NULL")
    table = banded.groupBy("odds_range").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg("implied_probability").alias("implied_probability"),
        F.avg(F.col("prediction_correct").cast("double")).alias("actual_frequency"),
        F.avg("roi").alias("roi"),
    )
    return table.withColumn("calibration_error", F.col("actual_frequency") - F.col("implied_probability"))


def compare_opening_closing(rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Metrics per timing and the mean absolute move of the same selection between the two."""
    key = ["match_id", "bookmaker", "market", "selection"]
    fixed = rows.filter(F.col("opening_or_closing").isin("opening", "closing"))
    last = lambda timing: F.max_by(
        "implied_probability", F.when(F.col("opening_or_closing") == timing, F.struct(*(order or ["implied_probability"])))
    )
    pairs = fixed.groupBy(*key).agg(last("opening").alias("opening"), last("closing").alias("closing"))
    movement = pairs.agg(F.avg(F.abs(F.col("closing") - F.col("opening"))).alias("m")).scalar()
    return (
        selection_metrics(fixed, ["opening_or_closing"])
        .withColumnRenamed("opening_or_closing", "timing")
        .withColumn("mean_absolute_probability_movement", movement)
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width counts on [low, high]; the top edge belongs to the last bin."""
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    inside = df.filter((F.col(column) >= low) & (F.col(column) <= high))
    return inside.groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_statistics(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Exact five-number summary per group; values are ranked in slices, never held in one place."""
    out = exact_quantiles(df, column, (0.0, 0.25, 0.5, 0.75, 1.0), by)
    names = ("low", "q1", "median", "q3", "high")
    return out.select(*by, "n", *[F.col(f"q{i}").alias(name) for i, name in enumerate(names)])
