"""Registered queries read all that their tables hold."""

import os

import pytest
from oracle import compare, connect

from fairline.catalog import ORACLES, QUERIES
from fairline.catalog import jobs as job_queries
from fairline.operators import strategy

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def test_cutoff_snapshot_has_all_bookmakers_and_matches(spark, monkeypatch):
    out = QUERIES["a11_cutoff_snapshot"](spark, DATA)
    assert compare(out, connect(DATA), ORACLES["a11_cutoff_snapshot"])[0] is None
    books = {str(r[0]) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_linenumber").distinct().collect()}
    assert {r[0] for r in out.select("bookmaker").distinct().collect()} == books - {"3"}
    assert out.filter("match_id % 3 = 0").count() > 0
    rows = job_queries.jobs.cutoff_snapshot_with_manifest
    seen = []
    monkeypatch.setattr(job_queries.jobs, "cutoff_snapshot_with_manifest", lambda *a: seen.append(rows(*a)) or seen[0])
    QUERIES["p11_cutoff_manifest"](spark, DATA)
    assert {r[0] for r in seen[0]["rows"].select("bookmaker").distinct().collect()} == books


def test_rule_intervals_draw_a_thousand_resamples(spark, monkeypatch):
    drawn = []
    sums = strategy.resampled_sums
    monkeypatch.setattr(strategy, "resampled_sums", lambda *a: drawn.append(a[3]) or sums(*a))
    QUERIES["s6_rule_intervals"](spark, DATA)
    assert drawn == [1000] and "range(1000)" in ORACLES["s6_rule_intervals"]
