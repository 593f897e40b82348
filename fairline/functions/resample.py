"""Distributed bootstrap.

Each row gets, for each resample, a Poisson(1) weight derived from integer arithmetic on
(seed, resample, row key); a resampled mean is sum(w*x)/sum(w).  Rows never meet an index
table: the resample number is generated in the map task and summed there, so one task hands
over at most ``samples`` rows however many it read, and the result does not depend on how
rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647
# Cumulative Poisson(1) probabilities P(X <= 0), P(X <= 1), ...
POISSON_STEPS = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
)


def row_key(column: str | Column) -> Column:
    """Key of any type as an integer below the modulus."""
    return F.pmod(F.xxhash64(F.col(column) if isinstance(column, str) else column), F.lit(MODULUS))


def with_weights(df: DataFrame, key: str, resample: str, seed: int) -> DataFrame:
    """Add ``_w``.  The mixing steps are separate columns, so each is evaluated once per row."""
    modulus = F.lit(MODULUS)
    out = df.withColumn("_h1", F.pmod(F.col(key) * 48271 + F.col(resample) * 69621 + seed, modulus))
    out = out.withColumn("_h2", F.pmod(F.pmod(F.col("_h1") * F.col("_h1"), modulus) * 16807 + F.col(resample) * 101 + F.col(key), modulus))
    out = out.withColumn("_u", F.pmod(F.pmod(F.col("_h2") * F.col("_h2"), modulus) * 39373 + F.col("_h1"), modulus).cast("double") / MODULUS)
    weight = F.lit(0)
    for count, step in enumerate(POISSON_STEPS, start=1):
        weight = F.when(F.col("_u") >= step, count).otherwise(weight)
    return out.withColumn("_w", weight).drop("_h1", "_h2", "_u")


def resampled_sums(df: DataFrame, value: str, key: Column, samples: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, resample) -> ``sum_w`` and ``sum_wx``."""
    if samples <= 0:
        raise ValueError("samples must be positive")
    rows = df.select(*by, F.col(value).alias("_x"), key.cast("long").alias("_key"))
    # each row becomes ``samples`` rows of arithmetic, so spread the narrow rows first
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "_key")
    drawn = rows.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    drawn = with_weights(drawn, "_key", "resample", seed)
    return drawn.groupBy(*by, "resample").agg(F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_x")).alias("sum_wx"))


def interval(sums: DataFrame, by: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the resampled means; a group holds one value per resample."""
    means = sums.withColumn("_m", F.try_divide("sum_wx", "sum_w"))
    bounds = F.percentile("_m", F.array(F.lit(low), F.lit(high)))
    out = means.groupBy(*by).agg(bounds.alias("_b"), F.avg((F.col("_m") < 0).cast("double")).alias("share_negative"))
    return out.select(*by, F.col("_b")[0].alias("ci_low"), F.col("_b")[1].alias("ci_high"), "share_negative")
