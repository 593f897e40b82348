"""Exact interpolated quantiles without holding a group's values in one aggregator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = (), slices: int = 2_500) -> DataFrame:
    """One row per group with ``n`` and ``q0, q1, ...`` (linear interpolation, NULLs ignored).

    A first pass sketches each group with an error of a quarter of n / ``slices`` ranks, so the sketched values n / ``slices`` ranks below and
    above a probability enclose its order statistics wherever outliers lie.  A second pass counts what is below and the distinct values between,
    both combined in the map task; only those values, some 3 n / ``slices`` at most (all of fewer than 4 ``slices`` values), are ranked.  A bracket that misses its rank fails the job."""
    keys = list(by) or ["_all"]
    data = df.select(*[F.col(k) for k in by], *([] if by else [F.lit(1).alias("_all")]), F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    step = 1 / slices
    low, high = ([min(max(p + side * step, 0.0), 1.0) for p in probabilities] for side in (-1, 1))
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", [*low, *high], 4 * slices).alias("_near"))
    brackets = []
    for i, p in enumerate(probabilities):
        # in a group of few values a single rank may be wider than the bracket
        lo = F.when((F.col("n") < 4 * slices) | F.lit(low[i] == 0), F.col("_least")).otherwise(F.col("_near")[i])
        hi = F.when((F.col("n") < 4 * slices) | F.lit(high[i] == 1), F.col("_most")).otherwise(F.col("_near")[len(low) + i])
        brackets.append(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place"), lo.alias("lo"), hi.alias("hi")))
    wanted = sketch.select(*keys, "n", F.array(*brackets).alias("_b"))
    # what lies below a bracket is one row without a value
    met = data.join(wanted.select(*keys, "_b"), keys).select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("_b"))
    counts = met.groupBy(*keys, "_b", F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*keys, "_b").orderBy(F.col("_x").asc_nulls_first())
    ranked = counts.withColumn("_r", F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_x IS NOT NULL")
    at = lambda k: F.max(F.when((k >= F.col("_r")) & (k < F.col("_r") + F.col("_c")), F.col("_x")))
    one = ranked.groupBy(*keys, "_b").agg(at(F.floor("_b.place")).alias("_l"), at(F.ceil("_b.place")).alias("_u"))
    value = F.col("_l") + (F.col("_u") - F.col("_l")) * (F.col("_b.place") - F.floor("_b.place"))
    value = F.when(F.col("_l").isNull() | F.col("_u").isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(value)
    one = one.select(*keys, F.col("_b.i").alias("_i"), value.alias("_q"))
    wide = one.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probabilities))])
    return wanted.select(*keys, "n").join(wide, keys).drop("_all")
