"""Penalised Poisson regression on numbers and identities, without a column for each identity.

The coefficients of identities are rows of a table.  One pass joins them to the matches, and one aggregate, combined on the map side, gives for
every identity, number and the intercept its gradient and curvature, for both sides at once.  All coefficients then take a Newton step of their
own block; a step that does not lower the penalised deviance is halved.  The driver sees the intercept, the coefficients of the numbers and
one row of extremes for each kind of identity, whatever the number of identities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SIDES = ("home", "away")
#: First share of the Newton step (blocks share rows, so whole steps overshoot by turns), the shortest one, and the mean that stands for no goals at all.
STEP, STEP_MIN, GOALS_MIN = 0.8, 2.0**-12, 1e-7
_TABLE = "kind string, level string, home double, away double"


@dataclass
class PoissonFit:
    """``levels`` (kind, level, home, away) and, for each side, an intercept and the coefficients of the numbers."""

    levels: DataFrame
    intercept: dict[str, float]
    numbers: dict[str, dict[str, float]]
    iterations: int
    converged: bool

    def linear(self, df: DataFrame, kinds: Sequence[str], prefix: str = "_eta_") -> DataFrame:
        """Add the linear predictor of both sides; an unknown or missing identity counts as nothing."""
        return _linear(df, self.levels, kinds, self.intercept, self.numbers, prefix)


def _linear(df: DataFrame, levels: DataFrame, kinds: Sequence[str], intercept: dict[str, float], numbers: dict[str, dict[str, float]], prefix: str) -> DataFrame:
    for kind in kinds:
        own = levels.filter(F.col("kind") == kind).select(F.col("level").alias(f"_l_{kind}"), *[F.col(s).alias(f"_c_{s}_{kind}") for s in SIDES])
        df = df.join(own, F.col(kind).cast("string") == F.col(f"_l_{kind}"), "left").drop(f"_l_{kind}")
        df = df.withColumns({f"_c_{s}_{kind}": F.coalesce(f"_c_{s}_{kind}", F.lit(0.0)) for s in SIDES})
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    eta = {
        f"{prefix}{s}": add([F.lit(float(intercept[s])), *[F.col(f"_c_{s}_{k}") for k in kinds], *[F.col(n) * float(b) for n, b in numbers[s].items() if b]])
        for s in SIDES
    }
    return df.withColumns(eta)


def _evaluate(rows: DataFrame, levels: DataFrame, kinds: Sequence[str], names: Sequence[str], intercept: dict[str, float], numbers: dict[str, dict[str, float]]) -> DataFrame:
    """(kind, level, n, and for each side: coefficient, gradient, curvature, deviance part) at these coefficients, staged."""
    ready = _linear(rows, levels, kinds, intercept, numbers, "_eta_")
    goals, eta = (lambda s: F.col(f"{s}_goals")), (lambda s: F.col(f"_eta_{s}"))
    zero, one = F.lit(0.0), F.lit(1.0)

    def entry(kind: str, level: Column, weight: Column, own: Sequence[Column]) -> Column:
        return F.struct(F.lit(kind).alias("kind"), level.alias("level"), weight.alias("w"), *[c.alias(s) for s, c in zip(SIDES, own, strict=True)])

    entries = [entry("one", F.lit(""), one, (zero, zero))]
    entries += [entry(k, F.col(k).cast("string"), one, [F.col(f"_c_{s}_{k}") for s in SIDES]) for k in kinds]
    entries += [entry("number", F.lit(n), F.col(n), (zero, zero)) for n in names]
    rates = {f"_mu_{s}": F.exp(eta(s)) for s in SIDES}
    ready = ready.withColumns(rates).select(*[f"_mu_{s}" for s in SIDES], *[goals(s) for s in SIDES], *[eta(s) for s in SIDES], F.inline(F.array(*entries)))
    sums = [F.count(F.lit(1)).alias("n")]
    for s in SIDES:
        mu = F.col(f"_mu_{s}")
        sums += [
            F.max(s).alias(s), F.sum(F.col("w") * (mu - goals(s))).alias(f"{s}_g"), F.sum(F.col("w") * F.col("w") * mu).alias(f"{s}_h"),
            F.sum(F.when(F.col("kind") == "one", mu - goals(s) * eta(s))).alias(f"{s}_d"),
        ]
    return stage(ready.filter("level is not null").groupBy("kind", "level").agg(*sums), "poisson-sums")


def fit_sides(
    rows: DataFrame, kinds: Sequence[str], names: Sequence[str], alpha: float = 1.0, max_iter: int = 100, tol: float = 1e-5, start: PoissonFit | None = None,
) -> PoissonFit:
    """Fit ``home_goals`` and ``away_goals`` on the same ``rows``.

    Minimised is the mean of (rate - goals * log rate) plus alpha / 2 times the squares of all coefficients but the intercept.  ``names`` are
    standardised numbers without nulls.  It ends when no equation leaves more than ``tol`` (times the mean, if above one).  ``start`` is an earlier fit to begin from.  Rows with a null identity have no coefficient for it."""
    spark = rows.sparkSession
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}_goals").alias(s) for s in SIDES]).first()
    rows_in = means["n"]
    if not rows_in:
        raise ValueError("a score model needs at least one match")
    mean = {s: max(float(means[s]), GOALS_MIN) for s in SIDES}
    levels = start.levels if start else spark.createDataFrame([], _TABLE)
    intercept = dict(start.intercept) if start else {s: float(np.log(mean[s])) for s in SIDES}
    numbers = {s: {n: (start.numbers[s].get(n, 0.0) if start else 0.0) for n in names} for s in SIDES}
    solve = {}
    if names:
        packed = VectorAssembler(inputCols=list(names), outputCol="_packed").transform(rows)
        together = np.nan_to_num(Correlation.corr(packed, "_packed").first()[0].toArray())
        solve = {s: np.linalg.inv(mean[s] * together + alpha * np.eye(len(names))) for s in SIDES}

    def look(state: DataFrame) -> dict[str, dict]:
        slope = lambda s: F.col(f"{s}_g") / rows_in + alpha * F.col(s)
        key = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.concat_ws(":", "kind", "level"))
        stats = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("size")]
        for s in SIDES:
            move = -slope(s) / (F.col(f"{s}_h") / rows_in + alpha)
            stats += [
                F.sum(f"{s}_g").alias(f"{s}_g"), F.sum(f"{s}_h").alias(f"{s}_h"), F.sum(f"{s}_d").alias(f"{s}_d"), F.sum(F.col(s) * F.col(s)).alias(f"{s}_sq"),
                F.max(F.abs(slope(s))).alias(f"{s}_off"), F.avg(s).alias(f"{s}_mid"), F.avg(move).alias(f"{s}_move"),
            ]
        return {r["key"]: r.asDict() for r in state.groupBy(key.alias("key")).agg(*stats).collect()}

    def cost(seen: dict[str, dict], at: dict[str, dict[str, float]], s: str) -> float:
        squares = sum(seen[k][f"{s}_sq"] for k in kinds if k in seen) + sum(b * b for b in at[s].values())
        return seen["one:"][f"{s}_d"] / rows_in + alpha / 2 * squares

    state = _evaluate(rows, levels, kinds, names, intercept, numbers)
    seen = look(state)
    step = dict.fromkeys(SIDES, STEP)
    converged, done = False, 0
    while True:
        slopes = {s: np.array([seen[f"number:{n}"][f"{s}_g"] / rows_in + alpha * numbers[s][n] for n in names]) for s in SIDES}
        off = {
            s: max([abs(seen["one:"][f"{s}_g"]) / rows_in, *[seen[k][f"{s}_off"] for k in kinds if k in seen], *np.abs(slopes[s])]) for s in SIDES
        }
        moving = [s for s in SIDES if off[s] > tol * max(mean[s], 1.0) and step[s] >= STEP_MIN]
        converged = all(off[s] <= tol * max(mean[s], 1.0) for s in SIDES)
        if not moving or done >= max_iter:
            break
        # The mean of a kind that every match has belongs to the intercept: the same rates at a smaller penalty.
        whole = [k for k in kinds if k in seen and seen[k]["n"] == rows_in]
        next_intercept, next_numbers, columns = dict(intercept), {s: dict(numbers[s]) for s in SIDES}, {}
        for s in SIDES:
            t = step[s] if s in moving else 0.0
            shift = {k: (seen[k][f"{s}_mid"] + t * seen[k][f"{s}_move"] if t else 0.0) for k in whole}
            move = -(F.col(f"{s}_g") / rows_in + alpha * F.col(s)) / (F.col(f"{s}_h") / rows_in + alpha)
            moved = F.col(s) + t * move
            for k, value in shift.items():
                moved = F.when(F.col("kind") == k, F.col(s) + t * move - value).otherwise(moved) if value else moved
            columns[s] = moved
            if t:
                observed = max(seen["one:"][f"{s}_h"] - seen["one:"][f"{s}_g"], GOALS_MIN * rows_in)
                next_intercept[s] += t * float(np.log(observed / seen["one:"][f"{s}_h"])) + sum(shift.values())
                for n, d in zip(names, -(solve[s] @ slopes[s]) if names else [], strict=True):
                    next_numbers[s][n] += t * float(d)
        trial_levels = state.filter(F.col("kind").isin(*kinds)).select("kind", "level", *[columns[s].alias(s) for s in SIDES])
        trial = _evaluate(rows, trial_levels, kinds, names, next_intercept, next_numbers)
        trial_seen = look(trial)
        done += 1
        worse = [s for s in moving if not cost(trial_seen, next_numbers, s) <= cost(seen, numbers, s) + 1e-12 * abs(cost(seen, numbers, s))]
        if worse:
            # both sides go back to where they were; only the one that overshot takes a shorter step
            step.update({s: step[s] / 2 for s in worse})
            continue
        state, seen, intercept, numbers = trial, trial_seen, next_intercept, next_numbers
    fitted = state.filter(F.col("kind").isin(*kinds)).select("kind", "level", *SIDES)
    return PoissonFit(fitted, intercept, numbers, done, converged)


def score_equations(rows: DataFrame, fit: PoissonFit, kinds: Sequence[str], names: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(kind, level, n, home_residual, away_residual): what each coefficient's equation leaves, zero at the optimum; kind ``one`` is the intercept."""
    state = _evaluate(rows, fit.levels, kinds, names, fit.intercept, fit.numbers)
    total = rows.count()
    own = lambda s: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(fit.numbers[s][n]))]), F.col("level")), F.lit(0.0)) if names else F.lit(0.0)
    coefficient = lambda s: F.when(F.col("kind") == "number", own(s)).otherwise(F.col(s))
    return state.select("kind", "level", "n", *[(F.col(f"{s}_g") / total + alpha * coefficient(s)).alias(f"{s}_residual") for s in SIDES])
