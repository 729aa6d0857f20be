"""Time the headline queries; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scrollweave import catalog  # noqa: E402
from scrollweave.ship import ship  # noqa: E402

HEADLINE = ("frame_sampling", "confidence_filter", "reading_order", "bbox_merge", "normalize_text", "line_predicates", "indel_ratio", "parse_entries", "merge_consecutive", "transcript_stats", "format_markdown", "format_srt", "queue_status", "scroll_dedup")


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "*")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8")).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    queries = catalog.queries()
    queries["frame_sampling"](spark, data).write.format("noop").mode("overwrite").save()  # warms up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(data).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
