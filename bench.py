"""Times the headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from chronoplane.plans import Tables, load, presented
from chronoplane.session import local_session

HEADLINE = (
    "entity_features",
    "rolling_table",
    "lag_roll_mean",
    "lag_roll_std",
    "lag_ewma",
    "lag_trend",
    "lag_split_mean",
    "count_last_days",
    "availability",
    "events_since_reset",
    "dnp_patterns",
    "recovery",
    "opp_form",
    "opp_pace",
    "head_to_head",
    "group_z",
    "expanding_percentile",
    "join_master",
    "join_prev_season",
    "season_cv",
    "contiguous_folds",
    "impute_pipeline",
    "quality_report",
    "target_distribution",
    "flatten_nested",
    "gamma_tail",
    "gamma_quantile",
    "conformal",
    "ece",
    "coverage",
    "bet_decision_prob",
    "bet_totals",
    "edge_bins",
    "significance",
    "equity_curve",
    "ledger_summary",
    "fit_gbt",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    registry = load()
    presented(registry["lag_roll_mean"].build(Tables(spark, sf))).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        presented(registry[name].build(Tables(spark, sf))).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
