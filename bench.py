"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plotline.registry import load  # noqa: E402
from plotline.session import local_session  # noqa: E402

HEADLINE = [
    "S3_detect_format", "S5_fountain_units", "S6_plain_units", "F1_normalize", "P4_node_labels", "P12_unusable_names",
    "J6_phrase_containment", "J9_endpoint_join", "J11_named_in_question", "A4_citation_counts", "A5_roster",
    "A6_billable_actions", "W1_row_position", "W2_burst_sessions", "O4_ranked_evidence", "U5_ungrounded_names",
    "G1_graph_diff", "G3_apply_changes", "G6_orphaned_references", "G8_continuity_packet", "G11_merge_entities",
    "G14_rule_graph", "G34_unit_graph", "G45_budget_gate", "G48_scene_sheet", "G49_library_sheet", "O1_paged_list", "O2_lead_first"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    entries = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in only or HEADLINE:
        began = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        if only:
            print(name, seconds[name], flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
