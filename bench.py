"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs in
full, with its rows sent to a sink that drops them: once to warm the JVM, then
timed. Building the frame is part of the time, as some queries run jobs there.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rollcall import session  # noqa: E402
from rollcall.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "agg_summary_wide",
    "agg_audio_wide",
    "agg_30day",
    "stats_participation",
    "chart_daily",
    "flt_summary_range",
    "agg_latest_incentive",
    "agg_daily_entries",
    "dedup_first",
    "dedup_last",
    "dedup_all_columns",
    "collate",
    "stats_response_id",
    "clean_keep_earliest",
    "clean_review",
    "stats_cleaning",
    "transcripts",
    "src_typed_json",
    "src_multi",
    "sink_csv",
    "sink_participation_report",
]


def run(spark, name: str, sf_dir: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(
        "rollcall-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(spark, name, sf_dir)
        start = time.perf_counter()
        run(spark, name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
