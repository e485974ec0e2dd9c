"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.plans import catalog  # noqa: E402
from textloom.session import local_session  # noqa: E402

HEADLINE = (
    "pii_shape_report",
    "mask_documents",
    "mask_by_policy",
    "mask_known",
    "mask_known_joined",
    "unmask_known",
    "value_tier",
    "sequence_events",
    "ring_buffer",
    "request_lifecycle",
    "attribute_changes",
    "detect_loops",
    "settle_windows",
    "template_requests",
    "route_attribution",
    "thread_tree",
    "demote_tiers",
    "rebuild_context",
    "parallelism_stats",
    "assemble_stream",
    "extract_tool_calls",
    "grep_corpus",
    "line_diff",
    "snapshot_diffs",
    "page_outline",
    "search_logs",
    "classify_failures",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
