"""Time the headline jobs. Prints one JSON line.

Each job runs twice over whole tables into a sink that discards rows: ``queries`` holds the second run, ``first_run``
the one that also pays for compiling the plan. BENCH_SF_DIR names the data folder and BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import all_queries, jobs, registry  # noqa: E402
from tablesmith.operators.synthesize import Settings, synthesize  # noqa: E402
from tablesmith.plans.presets import low_balance_catalog, suppression_catalog  # noqa: E402
from tablesmith.session import build_session  # noqa: E402

FAST = Settings(seed=registry.SEED, as_of=registry.AS_OF, mode="fast")

# Registered queries timed as they are, on whole tables.
TIMED = [
    "formula_arithmetic", "condition_field_to_field", "edge_case_field_pairs", "eligible_rows_picked", "normal_rows_redrawn",
    "coerce_numbers", "repair_formulas", "repair_payment_methods", "renew_repeated_ids", "journey_order", "journey_order_hot_keys",
    "validation_report", "occurrence_counts", "latest_records", "latest_entities", "nested_documents", "orphan_references",
    "late_references", "apply_changes", "apply_grouped_changes", "clean_placeholders",
]


def bulk_jobs() -> dict:
    """The same jobs with the draws meant for bulk work, on the largest table as keys."""
    def lines(spark, sf):
        # One input file is one task; spread the bare keys over the cores before generating wide rows.
        keys = registry.table(spark, sf, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS unit")
        return keys.repartition(spark.sparkContext.defaultParallelism)

    return {
        "bulk_catalog": lambda spark, sf: synthesize(lines(spark, sf), "unit", low_balance_catalog(), FAST),
        "bulk_suppression": lambda spark, sf: synthesize(lines(spark, sf), "unit", suppression_catalog(), FAST),
        "bulk_flat_records": lambda spark, sf: jobs.flat_records(spark, sf, FAST),
        "bulk_journeys": lambda spark, sf: jobs.journeys(spark, sf, FAST),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = all_queries()
    work = {**{n: registered[n] for n in TIMED}, **bulk_jobs()}
    if only := os.environ.get("BENCH_ONLY"):
        work = {n: run for n, run in work.items() if n in only.split(",")}
    registry.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    first, seconds = {}, {}
    for name, run in work.items():
        for taken in (first, seconds):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "first_run": first, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
