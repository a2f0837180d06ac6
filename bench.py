"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores of the local session. Results go to the ``noop`` sink, so
every column of every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans import catalog, jobs  # noqa: E402
from flowlens.session import local_session  # noqa: E402

HEADLINE = [
    "q_flow_counts", "q_flow_cicids", "q_flow_unsw", "q_flow_idle_split", "q_packet_gaps", "q_adapt_derive_gen",
    "q_adapt_derive_cicids", "q_adapt_reject", "q_schema_audit", "q_schema_choice", "q_prof_missing", "q_prof_dups",
    "q_prof_numeric", "q_prof_totals", "q_rule_scan", "q_rule_summary", "q_rule_evidence", "q_score", "q_risk",
    "q_fallback_dist", "q_instance_attr", "q_recommend", "q_incidents", "q_incident_upsert", "q_summary_maps",
    "q_dashboard", "q_recent_alerts", "q_paging", "q_class_report", "q_confusion", "q_threshold_sweep", "q_auc",
    "q_classwise_risk", "q_calibrate", "q_stratified_split", "q_iforest_outliers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    everything = {**catalog.QUERIES, **jobs.QUERIES}
    names = sys.argv[1:] or HEADLINE
    # class loading and code generation are not part of any one query
    everything[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        everything[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
