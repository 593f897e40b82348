"""Out-of-sample evaluation of outcome probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import assert_no_rows, duplicate_keys, require_columns
from ..functions.quantiles import exact_quantiles
from ..functions.resample import interval, resampled_sums, row_key
from ..functions.scalars import OUTCOMES, argmax_label, as_column, brier_row, cut, log_loss_row, rps_row

PROBABILITY_COLUMNS = {"H": "probability_home", "D": "probability_draw", "A": "probability_away"}
METRICS = ("log_loss", "brier", "rps", "accuracy", "ece")


def probability_metrics(predictions: DataFrame, by: Sequence[str] = (), p: dict[str, str] = PROBABILITY_COLUMNS) -> DataFrame:
    """Log loss, Brier, RPS, accuracy and top-label calibration error in ten floor bins.

    Rows are reduced to one per (group, bin) before the second aggregate."""
    confidence = F.greatest(*p.values())
    hit = (argmax_label(list(p.values())) == F.col("result")).cast("double")
    bins = predictions.filter(F.col("result").isin(*OUTCOMES)).withColumn("_bin", F.least(F.floor(confidence * 10), F.lit(9))).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(log_loss_row("result", p)).alias("ll"), F.sum(brier_row("result", p)).alias("br"),
        F.sum(rps_row("result", p)).alias("rp"), F.sum(hit).alias("hits"), F.sum(confidence).alias("conf"),
    )
    n = F.sum("n")
    return bins.groupBy(*by).agg(
        n.alias("matches"), (F.sum("ll") / n).alias("log_loss"), (F.sum("br") / n).alias("brier"), (F.sum("rp") / n).alias("rps"),
        (F.sum("hits") / n).alias("accuracy"), (F.sum(F.abs(F.col("conf") - F.col("hits"))) / n).alias("ece"),
    )


def metrics_by_season(predictions: DataFrame, p: dict[str, str] = PROBABILITY_COLUMNS) -> DataFrame:
    return probability_metrics(predictions, ["season", "model"], p)


def weighted_model_means(metrics: DataFrame) -> DataFrame:
    """Match-weighted mean of season metrics per model."""
    total = F.sum("matches")
    return metrics.groupBy("model").agg(total.alias("matches"), *[(F.sum(F.col(m) * F.col("matches")) / total).alias(m) for m in METRICS])


def paired_differences(candidate: DataFrame, reference: DataFrame, p: dict[str, str] = PROBABILITY_COLUMNS) -> DataFrame:
    """Log-loss difference per common match; a repeated match id fails the job."""
    for name, frame in (("candidate", candidate), ("reference", reference)):
        assert_no_rows(duplicate_keys(frame, ["match_id"]), f"{name}: repeated match_id")
    left = candidate.select("match_id", log_loss_row("result", p).alias("_c"), "result")
    right = reference.select("match_id", *[F.col(c).alias(f"_r_{k}") for k, c in p.items()])
    joined = left.join(right, "match_id")
    loss = log_loss_row("result", {k: F.col(f"_r_{k}") for k in p})
    return joined.select("match_id", (F.col("_c") - loss).alias("difference"))


def paired_log_loss_bootstrap(
    candidate: DataFrame, reference: DataFrame, samples: int = 2000, seed: int = 42, p: dict[str, str] = PROBABILITY_COLUMNS,
    key=None,
) -> DataFrame:
    """One row: pairs, mean difference, 95 % interval, share of better resamples, verdict."""
    pairs = paired_differences(candidate, reference, p)
    mean = pairs.agg(F.count(F.lit(1)).alias("matches"), F.avg("difference").alias("mean_log_loss_difference"))
    sums = resampled_sums(pairs, "difference", row_key("match_id") if key is None else key, samples, seed)
    band = interval(sums).select(F.struct("*").alias("band")).scalar()
    verdict = (
        F.when(F.col("matches") == 0, "insufficient_data").when(F.col("ci_high") < 0, "candidate_better")
        .when(F.col("ci_low") > 0, "candidate_worse").otherwise("inconclusive")
    )
    joined = mean.withColumn("_band", band).select(
        "matches", "mean_log_loss_difference", "_band.ci_low", "_band.ci_high", F.col("_band.share_negative").alias("probability_candidate_better"))
    return joined.withColumn("verdict", verdict)


def set_difference_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row counting keys on one side only and on both."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    per = sides.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return per.agg(
        F.count(F.when(F.col("_r") == 0, 1)).alias("only_left"), F.count(F.when(F.col("_l") == 0, 1)).alias("only_right"),
        F.count(F.when((F.col("_l") == 1) & (F.col("_r") == 1), 1)).alias("common"),
    )


def evaluate_frozen(predictions: DataFrame, reference: DataFrame, samples: int = 2000, seed: int = 42, p: dict[str, str] = PROBABILITY_COLUMNS, key=None) -> dict[str, DataFrame]:
    """Metrics of both sides, the paired bootstrap and season metrics on one frozen match set."""
    for name, frame in (("predictions", predictions), ("reference", reference)):
        require_columns(frame, ["match_id", "season", "result", *p.values()], name)
    differ = set_difference_counts(predictions, reference, "match_id").filter("only_left > 0 OR only_right > 0")
    assert_no_rows(differ, "predictions and reference must cover the same matches")
    sides = predictions.withColumn("model", F.lit("candidate")).unionByName(reference.withColumn("model", F.lit("reference")), allowMissingColumns=True)
    return {
        "metrics": probability_metrics(sides, ["model"], p),
        "by_season": metrics_by_season(sides, p),
        "bootstrap": paired_log_loss_bootstrap(predictions, reference, samples, seed, p, key),
    }


def common_matches(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Restrict every frame to the match ids present in all of them."""
    ids = frames[0].select("match_id").distinct()
    for frame in frames[1:]:
        ids = ids.join(frame.select("match_id"), "match_id", "left_semi")
    return [frame.join(ids, "match_id", "left_semi") for frame in frames]


def id_fingerprint(column) -> tuple:
    """Order-free fingerprint parts of a set of ids: 48-bit digests summed and xor-ed."""
    digest = F.conv(F.substring(F.md5(as_column(column).cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    return F.sum(digest.cast("decimal(38,0)")), F.bit_xor(digest)


def fold_manifest(matches: DataFrame) -> DataFrame:
    """Per season: size and fingerprint of its test ids and of all earlier (training) ids.

    Fingerprints are sums, so the training side is a running total over seasons: ids are never
    collected or sorted in one place."""
    total, mixed = id_fingerprint("match_id")
    per = matches.groupBy(F.lpad(F.col("season").cast("string"), 4, "0").alias("test_season")).agg(
        F.count(F.lit(1)).alias("test_matches"), total.alias("_sum"), mixed.alias("test_xor")
    )
    # one row per season from here on
    earlier = Window.orderBy("test_season").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "test_season", F.coalesce(F.sum("test_matches").over(earlier), F.lit(0)).alias("train_matches"), "test_matches",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("string").alias("train_ids_sum"), F.col("_sum").cast("string").alias("test_ids_sum"), "test_xor",
    )


# ---- feature diagnostics -------------------------------------------------------------------

# Bins of the rating gap and of the difference in rest days.
ELO_EDGES = (-float("inf"), -150.0, -75.0, -25.0, 25.0, 75.0, 150.0, float("inf"))
REST_EDGES = (-float("inf"), -4.0, -1.0, 1.0, 4.0, float("inf"))
REST_LABELS = ("home <=-5", "home -4/-2", "similar", "home +2/+4", "home >=+5")


def _home_score():
    return F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)


def _rate(label: str, name: str):
    return F.avg((F.col("result") == label).cast("double")).alias(name)


def elo_diagnostics(features: DataFrame, edges: Sequence[float] = ELO_EDGES) -> DataFrame:
    """Rating-gap bins: expected and actual home score, home-win and draw rate."""
    labels = [f"({low:g}, {high:g}]" for low, high in zip(edges[:-1], edges[1:], strict=True)]
    table = features.withColumn("elo_bin", cut("elo_difference", edges, labels)).filter("elo_bin IS NOT NULL").groupBy("elo_bin").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("elo_expected_home").alias("expected_home"), F.avg(_home_score()).alias("actual_home_score"),
        _rate("H", "home_win_rate"), _rate("D", "draw_rate"),
    )
    return table.withColumn("calibration_error", F.col("actual_home_score") - F.col("expected_home"))


def rest_diagnostics(features: DataFrame, edges: Sequence[float] = REST_EDGES, labels: Sequence[str] = REST_LABELS) -> DataFrame:
    gap = F.col("home_rest_days") - F.col("away_rest_days")
    return features.withColumn("rest_bin", cut(gap, edges, labels)).filter("rest_bin IS NOT NULL").groupBy("rest_bin").agg(
        F.count(F.lit(1)).alias("matches"), _rate("H", "home_win_rate"), F.avg(_home_score()).alias("home_score")
    )


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Number of the quantile bin of each row (right-closed, lowest included, repeated edges
    merged).  The edges are one row, joined on a constant; rows are not sorted globally."""
    probabilities = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(df, column, probabilities).drop("n")
    edges = q.select(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])).alias("_edges")).scalar()
    value = F.col(column)
    passed = F.size(F.filter(F.col("_edges"), lambda e: e < value))
    number = F.when(value.isNotNull(), F.greatest(passed - 1, F.lit(0)))
    return df.withColumn("_edges", edges).withColumn("bin", number).drop("_edges")


def form_diagnostics(features: DataFrame, column: str = "form_difference", bins: int = 5) -> DataFrame:
    return quantile_bins(features, column, bins).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("matches"), F.avg(column).alias("form_difference"), _rate("H", "home_win_rate"), F.avg(_home_score()).alias("home_score")
    )


def league_diagnostics(features: DataFrame) -> DataFrame:
    return features.groupBy("league").agg(
        F.count(F.lit(1)).alias("matches"), _rate("H", "home_win_rate"), _rate("D", "draw_rate"),
        F.avg(F.pow(F.col("elo_expected_home") - _home_score(), 2)).alias("elo_brier"),
    )


def missing_rates(df: DataFrame) -> DataFrame:
    """Share of NULL per column, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in df.columns])
    return one.select(F.inline(rows))


def feature_summary(features: DataFrame) -> DataFrame:
    """Rows, leagues, seasons, share with five or more earlier games on both sides, best league by Elo Brier."""
    ready = ((F.col("home_matches_played") >= 5) & (F.col("away_matches_played") >= 5)).cast("double")
    best = league_diagnostics(features).agg(F.min_by("league", F.struct("elo_brier", "league"))).scalar()
    return features.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("league").alias("leagues"), F.count_distinct("season").alias("seasons"), F.avg(ready).alias("ready_share")
    ).withColumn("best_league", best)
