"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import local_session  # noqa: E402
from milaan.plans.registry import QUERIES  # noqa: E402
from milaan.sources.writers import scratch_path  # noqa: E402

HEADLINE = [
    "cross_doc_pairs", "verdict_summary", "majority_vote", "primary_blocker", "best_form_check", "validate_answers", "case_score",
    "doc_overall_pct", "extract_fields", "standardize", "matrix_vs_reference", "turn_outcomes", "apply_case_patches",
    "assemble_ocr_pages", "std_ocr_noise", "verify",
]


def split(spark, sf_dir: str, parts: int) -> str:
    """An untimed copy of the tables the queries read, in as many files as there are cores: large tables have many splits."""
    copy = scratch_path(spark, "bench")
    for name in ("customer", "conversations", "events", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    given = sf_dir
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = split(spark, sf_dir, int(os.environ.get("BENCH_CPUS", "8")))
    # One untimed run warms the engine.
    QUERIES["verdict_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    cases = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"), "cases": cases,
                "verify_cases_per_sec": round(cases / times["verify"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
