"""Times every registered query, results fully consumed, and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) choose what is run.
"""

from __future__ import annotations

import json
import os
import time

from evalweave.plans.catalog import BUILDERS
from evalweave.session import build_session, local_cores


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(BUILDERS)
    cores = local_cores()
    spark = build_session(
        "bench",
        f"local[{cores}]",
        spark__sql__shuffle__partitions=str(cores),
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One throw-away query each for the JVM and the Python workers.
    for name in ("example_seed", "ar_logit_summary"):
        BUILDERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in chosen:
        started = time.perf_counter()
        try:
            BUILDERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            errors[name] = f"{type(error).__name__}: {str(error)[:200]}"
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cores,
    }
    if errors:
        result["errors"] = errors
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
