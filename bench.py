"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the input tables, BENCH_CPUS the number of local cores. Each time covers building,
planning and running the query into a sink that keeps nothing; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "b1_detect_mode",
    "d1_refs",
    "d4_findings_in_prose",
    "d5_tokens",
    "d6_lines_with_typos",
    "e3_mapping_sql",
    "e4_mapping_union",
    "f1_redact_sql",
    "f1_redact_batches",
    "f1_redact_prose",
    "f2_redact_columns",
    "f2_redact_columns_in_prose",
    "f3_redact_pyspark",
    "f4_redact_mixed",
    "f5_fix_typos",
    "f5_fix_prose",
    "f6_restore_batches",
    "f6_restore_edited",
    "f6_restore_prose",
    "p1_redact_job",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("refmask-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {name: round(min(run(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
