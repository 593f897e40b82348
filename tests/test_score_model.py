"""The Poisson fit against a dense Newton solution, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline.operators import scores
from fairline.operators.poisson import fit_sides

KINDS = scores.IDENTITY_COLUMNS


def games(spark, n=240, teams=9, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        h, a = rng.choice(teams, 2, replace=False)
        x, y = float(rng.normal()), float(rng.normal() * 10)
        rate = np.exp(0.3 + 0.08 * h - 0.05 * a + 0.2 * x)
        rows.append((i, f"t{h}", f"t{a}", f"l{h % 2}", int(rng.poisson(rate)), int(rng.poisson(1.1)), x, y if i % 17 else None))
    return spark.createDataFrame(rows, "match_id long, home_team string, away_team string, league string, home_goals int, away_goals int, x double, y double")


def dense(df, numeric, side, alpha=1.0):
    """Newton steps on the one-hot matrix; the fitted rates."""
    data = df.orderBy("match_id").toPandas()
    columns = [np.ones(len(data))]
    for name in numeric:
        v = data[name].fillna(data[name].median()).to_numpy(float)
        columns.append((v - v.mean()) / (v.std() or 1.0))
    for kind in KINDS:
        columns += [(data[kind] == level).to_numpy(float) for level in sorted(data[kind].dropna().unique())]
    x, y = np.column_stack(columns), data[f"{side}_goals"].to_numpy(float)
    penalty = np.full(x.shape[1], alpha)
    penalty[0] = 0.0
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(50):
        mu = np.exp(x @ beta)
        beta -= np.linalg.solve(x.T @ (x * mu[:, None]) / len(y) + np.diag(penalty), x.T @ (mu - y) / len(y) + penalty * beta)
    return np.exp(x @ beta)


def test_rates_equal_the_dense_solution(spark):
    df, numeric = games(spark), ["x", "y"]
    model = scores.fit_score_model(df, numeric)
    rates = model.rates(df).orderBy("match_id").toPandas()
    assert model.fit.converged
    for side in ("home", "away"):
        assert np.abs(rates[f"{side}_rate"] - dense(df, numeric, side)).max() < 1e-3
    left = model.equations(df).agg(F.max(F.abs("home_residual")), F.max(F.abs("away_residual"))).first()
    assert max(left) < 1e-4


def test_more_teams_than_a_vector_holds(spark):
    """5 000 teams, and one of them in a third of all matches."""
    n = 30_000
    key = F.col("id")
    df = spark.range(n).select(
        key.alias("match_id"), F.when(key % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (key * 7 % 5000).cast("string"))).alias("home_team"),
        F.concat(F.lit("t"), (key * 11 % 5000).cast("string")).alias("away_team"), F.lit("l").alias("league"), (key % 4).cast("int").alias("home_goals"), (key % 3).cast("int").alias("away_goals"))
    model = scores.fit_score_model(df, [])
    assert model.fit.converged
    assert model.fit.levels.filter("kind = 'home_team'").count() == df.select("home_team").distinct().count()
    total = model.rates(df).agg(F.sum("home_rate"), F.sum("away_rate"), F.sum("home_goals"), F.sum("away_goals")).first()
    assert total[0] == pytest.approx(total[2], rel=1e-4) and total[1] == pytest.approx(total[3], rel=1e-4)


def test_unknown_missing_and_collinear(spark):
    df = games(spark).withColumn("league", F.when(F.col("match_id") % 5 > 0, F.col("league"))).withColumn("same", F.col("x") * 2).withColumn("flat", F.lit(1.0))
    model = scores.fit_score_model(df, ["x", "same", "flat"])
    assert model.fit.converged
    rates = model.rates(df).orderBy("match_id").toPandas()
    assert np.abs(rates["home_rate"] - dense(df, ["x", "same", "flat"], "home")).max() < 1e-3
    new = df.limit(1).withColumns({"home_team": F.lit("new"), "away_team": F.lit(None).cast("string"), "league": F.lit("new"), "x": F.lit(0.0), "same": F.lit(0.0)})
    row = model.rates(new).first()
    pull = sum(b * (0.0 - model.scales[n][0]) / model.scales[n][1] for b, n in zip(model.fit.numbers["home"].values(), ["x", "same"], strict=False))
    assert row["home_rate"] == pytest.approx(np.exp(model.fit.intercept["home"] + pull), rel=1e-6)


def test_a_start_saves_steps_and_no_goals_is_defined(spark):
    df = games(spark).select(*KINDS, F.col("home_goals").cast("double").alias("home_goals"), F.lit(0.0).alias("away_goals")).cache()
    first = fit_sides(df, KINDS, [])
    again = fit_sides(df, KINDS, [], start=first)
    assert again.iterations <= 1 < first.iterations and first.intercept["away"] < np.log(1e-4)
    with pytest.raises(ValueError):
        fit_sides(df.limit(0), KINDS, [])
