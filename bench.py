"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder with the parquet tables, BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from seriesmill.plans import catalog
from seriesmill.session import local_session

HEADLINE = [
    "form_features",
    "split_by_threshold",
    "series_rollup_threshold",
    "series_rollup_anchor",
    "game_rows",
    "schedule_status",
    "roster_history_features",
    "sessionise",
    "chronological_index",
    "modelling_table",
    "metrics_by_scope",
    "calibration",
    "paired_compare",
    "extract_page_fields",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", shuffle=int(cpus))
    catalog.load_all()
    # One short query first: starting the JVM's code paths is not what is measured.
    catalog.QUERIES["group_sizes"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
