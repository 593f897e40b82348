"""Headline queries on the benchmark tables; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_REPEAT``
(default 1) and ``BENCH_QUERIES`` (comma-separated names) steer the run.  Every result is fully
computed through the no-op sink; a warm-up query is run first."""

from __future__ import annotations

import json
import os
import statistics
import time

from fairline.catalog import QUERIES
from fairline.session import local_session

HEADLINE = (
    "ga6_compare_bookmakers", "ga5_selection_metrics", "w4_row_scores", "ga1_calibration_table", "ga7_price_bands", "ga9_opening_closing", "b10_normalize_snapshot",
    "j1_star_join", "j2_closing_means", "j14_as_of_latest", "j5_replace_snapshots", "j7_reconcile_fixtures", "j11_similarity_quarantine", "j13_waterfall",
    "w5_rolling_form", "w6_weighted_form", "w10_elo", "w11_match_features", "w13_lineup_aggregates", "w14_temporal_matrix", "ga12_metrics_by_season",
    "m3_score_probabilities", "m2_fit_rho", "m13_paired_bootstrap", "s5_rule_search", "q6_ready_set", "ga20_not_null_census", "ga33_player_pools",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("ga20_not_null_census")
    seconds = {}
    for name in names:
        times = []
        for _ in range(repeat):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
