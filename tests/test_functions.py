import random
import uuid
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairline.functions import names, scalars
from fairline.functions.checks import assert_unique, join_checked, require_columns
from fairline.functions.quantiles import exact_quantiles
from fairline.functions.resample import interval, resampled_sums, row_key
from fairline.functions.temporal import as_of_latest, keep_latest, last_rows_before, position_in_order, prior_totals, running_count, running_latest, running_max, running_sum


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_cut_matches_interval_rules(spark):
    edges = scalars.arange_edges(0.05)
    assert len(edges) == 21
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.050001,), (1.0,), (1.2,), (None,)], "x double")
    got = [r[0] for r in rows.select(scalars.cut("x", edges)).collect()]
    assert got == ["(-0.001, 0.05]", "(-0.001, 0.05]", "(0.05, 0.1]", "(0.95, 1.0]", None, None]
    left = [r[0] for r in rows.select(scalars.cut("x", [0.0, 0.05, 2.0], ["a", "b"], right=False)).collect()]
    assert left == ["a", "b", "b", "b", "b", None]


def test_argmax_first_label_wins(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.2, 0.7), (0.3, 0.35, 0.35)], "h double, d double, a double")
    assert [r[0] for r in df.select(scalars.argmax_label(["h", "d", "a"])).collect()] == ["H", "A", "D"]


@pytest.mark.parametrize("raw,key", [("Internazionale F.C.", "internazionale"), ("AC Milan", "milan"), ("A.C. Milan", "milan"), ("Hellas Verona", "verona"),
                                     ("ESTAC Troyes", "troyes"), ("X A C", "x"), ("a b c", "a b c")])
def test_token_key(spark, raw, key):
    assert value(spark, names.token_key(F.lit(raw))) == key


def test_other_name_keys(spark):
    assert value(spark, names.compact_key(F.lit("The Málaga C.F. Club de Fútbol"))) == "malagacffutbol"
    assert value(spark, names.team_key(F.lit("FC Bayern München"))) == "bayern munich"
    assert value(spark, names.team_key(F.lit("OGC Nizza"))) == "nice"


def test_season_codes(spark):
    assert value(spark, scalars.season_code(F.lit(2009))) == "0910"
    assert value(spark, scalars.season_code_from_range(F.lit("2010/2011"))) == "1011"
    assert [value(spark, scalars.season_start(F.lit(s))) for s in ("2010/11", "9900", "0001", "x")] == [2010, 1999, 2000, None]


def test_instants_and_numbers(spark):
    assert value(spark, scalars.utc_micros(F.lit("2024-01-01T12:00:00+00:00"))) == value(spark, scalars.utc_micros(F.lit("2024-01-01T13:00:00+01:00")))
    assert value(spark, scalars.int_or_null(F.lit("7.0"))) == 7
    assert value(spark, scalars.int_or_null(F.lit("n/a"))) is None
    assert value(spark, scalars.finite(F.lit(float("nan")))) is None
    assert value(spark, scalars.finite(F.lit(float("-inf")))) is None


def test_uuid_and_natural_key(spark):
    assert value(spark, scalars.uuid_from_name(uuid.NAMESPACE_DNS.hex, F.lit("club|x"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "club|x"))


def lcs_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    if a == b:
        return 100.0
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abcd", max_size=7), st.text("abcd", max_size=7)), min_size=1, max_size=8))
def test_similarities(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", scalars.indel_ratio("a", "b").alias("i"), names.matching_ratio("a", "b").alias("m"), names.indel_similarity("a", "b").alias("s"),
                    names.indel_by_places("a", names.letter_places("a"), "b").alias("p"), names.common_letters_ratio(names.letter_tokens("a"), names.letter_tokens("b")).alias("most")).collect()
    for row in got:
        assert row["i"] == pytest.approx(lcs_ratio(row["a"], row["b"])) == row["s"]
        assert row["p"] == row["i"]
        assert row["most"] >= max(row["m"], row["i"] / 100) - 1e-12
        assert row["m"] == pytest.approx(SequenceMatcher(None, row["a"], row["b"]).ratio())


def test_indel_known_values(spark):
    assert value(spark, scalars.indel_ratio(F.lit("milan"), F.lit("mailand"))) == pytest.approx(83.3333, abs=1e-3)
    assert value(spark, scalars.indel_ratio(F.lit("torino"), F.lit("turin"))) == pytest.approx(72.7272, abs=1e-3)


events = st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 6), st.integers(0, 50), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events)
def test_history_equals_brute_force(spark, rows):
    rows = [(k, t, i, v, n) for n, (k, t, i, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int, n int")
    measures = [running_count("c"), running_sum("s", F.col("v")), running_max("m", F.col("v")),
                running_latest("l", [F.col("t"), F.col("i"), F.col("n")], {"v": F.col("v")})]
    plain = {(r["k"], r["t"]): r for r in prior_totals(df, df, ["k"], "t", measures).collect()}
    split = {(r["k"], r["t"]): r for r in prior_totals(df, df, ["k"], "t", measures, bucket=F.floor(F.col("t") / 2)).collect()}
    history, probes = df.filter("n % 3 <> 0"), df
    tails = {(r["k"], r["t"]): r for r in last_rows_before(history, probes, ["k"], "t", ["i", "n"], ["v"], 2, {"odd": F.col("i") % 2 == 1}).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        past = [r for r in rows if r[0] == key[0] and r[1] < key[1]]
        known = [r[3] for r in past if r[3] is not None]
        for found in (plain[key], split[key]):
            assert found["c"] == len(past)
            assert found["s"] == (sum(known) if known else None)
            assert found["m"] == (max(known) if known else None)
            last = max(past, key=lambda r: (r[1], r[2], r[4]), default=None)
            assert (found["l"] and found["l"]["o2"]) == (last[4] if last else None)
        ordered = sorted((r for r in past if r[4] % 3), key=lambda r: (r[1], r[2], r[4]))
        assert [(x["i"], x["n"]) for x in tails[key]["tail"]] == [(r[2], r[4]) for r in ordered[-2:]]
        assert [(x["i"], x["n"]) for x in tails[key]["odd"]] == [(r[2], r[4]) for r in [o for o in ordered if o[2] % 2 == 1][-2:]]


def test_position_and_keep_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("a", 3, 1), ("b", 2, 2)], "k string, t int, i int")
    assert {(r.k, r.i): r.position for r in position_in_order(df, ["k"], "t", ["i"]).collect()} == {("a", 4): 1, ("a", 5): 2, ("a", 1): 3, ("b", 2): 1}
    assert {(r.k, r.i) for r in keep_latest(df, ["k"], [F.col("t"), F.col("i")]).collect()} == {("a", 1), ("b", 2)}


def test_as_of_ignores_later_and_other_quotes(spark):
    quotes = spark.createDataFrame([("m", "H", 1, 1.5), ("m", "H", 3, 1.8), ("m", "H", 9, 9.9), ("m", "D", 9, 3.0)], "match_id string, selection string, at int, odds double")
    probes = spark.createDataFrame([("m", 5)], "match_id string, cutoff int")
    rows = as_of_latest(probes, quotes, ["match_id"], ["selection"], "cutoff", "at", ["odds"]).collect()
    assert [(r.selection, r.odds) for r in rows] == [("H", 1.8)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50, allow_nan=False), min_size=1, max_size=40))
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, "v", [0.0, 0.2, 0.5, 1.0], slices=4).first()
    assert [row[f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(values, [0.0, 0.2, 0.5, 1.0])), abs=1e-9)


def test_bootstrap_spread_is_the_standard_error(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.2, 1.0, 900)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    sums = resampled_sums(df, "x", row_key("id"), 400, 11)
    means = [r.sum_wx / r.sum_w for r in sums.collect()]
    assert np.std(means) == pytest.approx(x.std() / np.sqrt(len(x)), rel=0.15)
    band = interval(sums).first()
    assert band.ci_low < x.mean() < band.ci_high
    again = resampled_sums(df.repartition(7), "x", row_key("id"), 400, 11)
    assert {r.resample: r.sum_w for r in again.collect()} == {r.resample: r.sum_w for r in sums.collect()}


def test_checks_fail_closed(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError):
        require_columns(df, ["a", "c"])
    with pytest.raises(ValueError):
        assert_unique(df, ["a"])
    with pytest.raises(ValueError):
        join_checked(df, df.select("a"), ["a"])
    assert join_checked(df, df.filter("b = 2").select("a"), ["a"], validate="many_to_one").count() == 2


def test_quantiles_with_an_outlier_rank_few_values(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(20_000)] + [1e12, -1e300, 0.5] + [0.25] * 4_000
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("b", 8.0), ("c", None)], "g string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "v", probabilities, ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == len(values)
    assert [got["a"][f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-12)
    assert [got["b"][f"q{i}"] for i in range(6)] == pytest.approx([7, 7.1, 7.25, 7.5, 7.9, 8])
    coarse = exact_quantiles(df.repartition(7), "v", [0.5], ["g"], slices=25).filter("g = 'a'").first()
    assert coarse.q0 == pytest.approx(np.quantile(values, 0.5))
