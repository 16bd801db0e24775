"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)

Every query is worked out whole and its rows are thrown away by the noop sink, so nothing is
pruned and nothing comes to the driver. Names given as arguments are timed instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_checks  # noqa: E402
from sceneframe.session import build_session  # noqa: E402

HEADLINE = [
    "asset_scan", "scene_slots", "ambiguous_scenes", "running_order", "pair_two_phase", "intake_summary", "renumber",
    "manifest_scan", "settings_resolve", "resolve_scenes", "problem_report",
    "timeline", "cache_plan", "distinct_work", "retention", "probe_streams", "profile_mismatch", "film_check",
    "paragraphs", "cut_sentences", "cut_time_bins", "gap_cost", "straddle_cost", "cue_timing", "undrawable", "script_profile",
    "redact_corpus", "log_scan", "throttle_episodes", "stream_daily", "stream_throttle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_regionkey").count().write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        all_checks.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[key] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
