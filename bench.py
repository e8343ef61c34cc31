"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query (built and planned afresh each time) is forced end to end with the ``noop`` sink
(every column computed, nothing collected); the best of BENCH_REPEATS runs is reported.  Set BENCH_QUERIES=all to time every registered query.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callwright.plans.catalog import QUERIES  # noqa: E402
from callwright.session import local_session  # noqa: E402

HEADLINE = [
    "func_frequency",
    "func_arg_value_frequency",
    "func_bigrams",
    "parse_args_plain",
    "rule_convert",
    "map_calls_template",
    "emit_message_expected",
    "split_exact",
    "training_text",
    "eval_suite_cases",
    "text_match_by_prompt",
    "call_normalise",
    "augment_rules",
    "template_expand",
    "pair_functions",
    "function_spec_inference",
    "group_by_query",
    "json_repair",
    "schema_repair",
    "prompt_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="callwright-bench")
    # warm-up: JVM, Python workers and the parquet footers
    QUERIES["func_frequency"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    timings = {}
    for name in names:
        best = None
        for _ in range(repeats):  # best of N: plan + run, JVM warm, no cached data from the last run
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            el = time.perf_counter() - t0
            best = el if best is None else min(best, el)
        timings[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
