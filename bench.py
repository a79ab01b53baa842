"""Time the registered queries on a folder of tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from letterloom.plans.catalog import QUERIES

# The queries that say most about a corpus: clean-up, filters, threads, overviews, feeds,
# calendars, identities, payloads and renderings.
HEADLINE = (
    "thread_rollup", "thread_page", "skip_filters", "contact_filter", "resolve_sender", "overview_top", "overview_source",
    "contact_activity", "quarter_histogram", "top_threads", "feed_newest_n", "feed_offsets", "ref_assign", "usage_rollup",
    "label_stats", "apply_actions", "upsert_latest", "chat_context", "day_markers", "sender_tokens", "normalize_subject",
    "normalize_address", "normalize_date", "clean_text", "clean_reduction", "html_to_text_native",
    "agenda_week", "recurring_collapse", "import_plan", "json_headers", "mime_pick", "thread_union", "ical_events",
    "vcards", "render_listing", "render_convo", "render_agenda", "stream_feed", "stream_usage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("letterloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query loads and compiles what every Spark session has to.
    QUERIES["quarter_histogram"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
