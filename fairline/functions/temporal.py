"""State strictly before an instant, without same-instant peers and without hot tasks.

Every helper first aggregates to one row per (key, instant) - map-side combined, so a key
holding a third of the rows shrinks to its number of distinct instants before it is
shuffled to one place - and then walks those rows with ``ROWS ... -1 PRECEDING`` frames.
Peers of one instant share one row, so they can never see each other.

For instants finer than a day pass ``bucket`` (for example ``F.to_date('ts')``): the walk is
then done inside (key, bucket) and the earlier buckets are added from a second, much smaller
walk over bucket totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """``first`` aggregates the rows of one instant, ``merge`` combines such partial results."""

    name: str
    first: Column
    merge: Callable[[Column], Column] = F.sum
    empty: object | None = None


def running_count(name: str, condition: Column | None = None) -> Running:
    value = F.lit(1) if condition is None else F.when(condition, 1)
    return Running(name, F.count(value), F.sum, 0)


def running_sum(name: str, value: Column) -> Running:
    return Running(name, F.sum(value), F.sum)


def running_max(name: str, value: Column) -> Running:
    return Running(name, F.max(value), F.max)


def running_latest(name: str, order: Sequence[Column], values: dict[str, Column]) -> Running:
    """Values of the last earlier row; ``order`` starts with the instant and breaks its ties."""
    fields = [c.alias(f"o{i}") for i, c in enumerate(order)] + [c.alias(k) for k, c in values.items()]
    return Running(name, F.max(F.struct(*fields)), _last_known)


def _last_known(column: Column) -> Column:
    # walks are ordered by the instant, so the greatest entry so far is simply the last one
    return F.last(column, ignorenulls=True)


def prior_totals(
    history: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    instant: str,
    measures: Sequence[Running],
    bucket: Column | None = None,
) -> DataFrame:
    """One row per probed (keys, instant): each measure over strictly earlier history rows.

    ``probes`` may be ``history`` itself; otherwise its instants are added without contributing."""
    per = history.groupBy(*keys, instant).agg(*[m.first.alias(m.name) for m in measures])
    if probes is not history:
        wanted = probes.select(*keys, instant).distinct().withColumn("_wanted", F.lit(True))
        per = per.join(wanted, [*keys, instant], "full_outer")
    else:
        per = per.withColumn("_wanted", F.lit(True))
    before = (Window.unboundedPreceding, -1)
    if bucket is None:
        frame = Window.partitionBy(*keys).orderBy(instant).rowsBetween(*before)
        out = per.select(*keys, instant, "_wanted", *[m.merge(F.col(m.name)).over(frame).alias(m.name) for m in measures])
    else:
        per = per.withColumn("_bucket", bucket)
        inner = Window.partitionBy(*keys, "_bucket").orderBy(instant).rowsBetween(*before)
        outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*before)
        total = lambda m: F.max(m.name) if m.merge is _last_known else m.merge(F.col(m.name))
        carry = (
            per.groupBy(*keys, "_bucket")
            .agg(*[total(m).alias(m.name) for m in measures])
            .select(*keys, "_bucket", *[m.merge(F.col(m.name)).over(outer).alias(f"_c_{m.name}") for m in measures])
        )
        walked = per.select(
            *keys, instant, "_wanted", "_bucket", *[m.merge(F.col(m.name)).over(inner).alias(m.name) for m in measures]
        )
        out = walked.join(carry, [*keys, "_bucket"], "left").select(
            *keys, instant, "_wanted",
            *[_merge_pair(m, F.col(f"_c_{m.name}"), F.col(m.name)).alias(m.name) for m in measures],
        )
    filled = [
        F.col(m.name) if m.empty is None else F.coalesce(F.col(m.name), F.lit(m.empty)).alias(m.name) for m in measures
    ]
    return out.filter("_wanted").select(*keys, instant, *filled)


def _merge_pair(measure: Running, earlier: Column, current: Column) -> Column:
    if measure.merge is F.sum:
        return F.when(earlier.isNull(), current).when(current.isNull(), earlier).otherwise(earlier + current)
    if measure.merge is F.max:
        return F.greatest(earlier, current)
    if measure.merge is F.min:
        return F.least(earlier, current)
    if measure.merge is _last_known:
        return F.coalesce(current, earlier)
    raise ValueError("only sum, max, min and latest can be carried across buckets")


def last_rows_before(
    history: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    instant: str,
    order: Sequence[str],
    values: Sequence[str],
    n: int,
    groups: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per probed (keys, instant) with the last ``n`` strictly earlier history rows.

    Result columns are arrays of structs, oldest first: ``tail`` over all rows, plus one array
    per entry of ``groups`` holding the last ``n`` rows that meet its condition.  Only the last
    ``n`` rows of one instant can ever matter, so a ranked filter (applied by Spark before its
    shuffle) keeps those; the walk then joins at most ``n`` non-empty instants, so every array
    stays at ``n`` entries however large the key is."""
    flags = {name: F.coalesce(condition, F.lit(False)) for name, condition in (groups or {}).items()}
    entry = F.struct(*[F.col(c) for c in dict.fromkeys([instant, *order, *values])])
    marker = F.concat_ws("|", F.lit("m"), *[flag.cast("string") for flag in flags.values()])
    ranked = Window.partitionBy(*keys, instant, "_mark").orderBy(*[F.col(c).desc() for c in order])
    kept = (
        history.withColumn("_mark", marker)
        .withColumn("_rn", F.row_number().over(ranked))
        .filter(F.col("_rn") <= n)
        .select(*keys, instant, entry.alias("_entry"), *[flag.alias(f"_in_{g}") for g, flag in flags.items()])
    )
    wanted = probes.select(*keys, instant).distinct().withColumn("_wanted", F.lit(True))
    arrays = {"tail": F.col("_entry")}
    arrays.update({g: F.when(F.col(f"_in_{g}"), F.col("_entry")) for g in flags})
    per = (
        kept.groupBy(*keys, instant)
        .agg(*[F.slice(F.reverse(F.sort_array(F.collect_list(v))), 1, n).alias(g) for g, v in arrays.items()])
        .join(wanted, [*keys, instant], "full_outer")
    )
    by_instant = Window.partitionBy(*keys).orderBy(instant).rowsBetween(Window.unboundedPreceding, -1)
    filled = {g: F.when(F.size(g) > 0, F.col(g)) for g in arrays}
    # number of non-empty instants seen before: the last n of them are a fixed-width range
    per = per.select("*", *[F.count(value).over(by_instant).alias(f"_k_{g}") for g, value in filled.items()])
    for group in arrays:
        nearest = Window.partitionBy(*keys).orderBy(f"_k_{group}").rangeBetween(-n, -1)
        gathered = F.flatten(F.collect_list(F.reverse(filled[group])).over(nearest))
        per = per.withColumn(f"_t_{group}", gathered)
    out = per.filter("_wanted")
    # sliding frames may hold n entries of each of n instants; order and keep the newest n
    newest = {g: F.slice(F.reverse(F.sort_array(F.col(f"_t_{g}"))), 1, n) for g in arrays}
    return out.select(*keys, instant, *[F.reverse(value).alias(g) for g, value in newest.items()])


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by a full tie-break.  The ranked filter is applied
    before the shuffle, so repeated copies of one key do not travel."""
    ranked = Window.partitionBy(*keys).orderBy(*[c.asc() if first else c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(ranked)).filter("_rn = 1").drop("_rn")


def as_of_latest(
    probes: DataFrame,
    quotes: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    cutoff: str,
    instant: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest quote at or before each probe's cutoff, one row per (on, by, cutoff).

    An equality join plus a partial-aggregated ``max(struct)``: no sort of the quotes, and a
    key with very many quotes is combined on the map side."""
    joined = quotes.join(probes.select(*on, cutoff).distinct(), list(on)).filter(F.col(instant) <= F.col(cutoff))
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([instant, *tie, *values])])
    group = list(dict.fromkeys([*on, cutoff, *by]))
    latest = joined.groupBy(*group).agg(F.max(packed).alias("_latest"))
    return latest.select(*group, *[F.col(f"_latest.{c}").alias(c) for c in dict.fromkeys([instant, *values])])


def position_in_order(df: DataFrame, keys: Sequence[str], instant: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based place of each row in its key ordered by (instant, order).

    Rows are ranked inside (key, instant) and offset by the number of earlier rows, so a hot key
    is spread over its instants instead of being sorted by one task."""
    offset = prior_totals(df, df, keys, instant, [running_count("_before")])
    within = Window.partitionBy(*keys, instant).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(within)).join(offset, [*keys, instant]).withColumn(
        name, F.col("_before") + F.col("_rn")).drop("_before", "_rn")
