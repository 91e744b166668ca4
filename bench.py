"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lintlake.plans import catalogue
from lintlake.session import build_session, clean_work

HEADLINE = [
    "flagship_document_matrix", "p1_line_explode", "r1_sql_injection", "r4_route_without_auth", "r8_secrets_in_documents", "r12_any_types",
    "r19_async_races", "r21_go_errors", "r31_framework_usage", "r33_keyword_complexity", "u1_union_of_findings", "a3_file_level_matrix",
    "n2_duplicate_blocks", "n4_function_lengths", "j1_changed_files", "j2_grown_files", "j4_symbol_diff", "j7_contract_breaks",
    "j11_unused_exports_repo", "j13_change_impact", "j18_vulnerabilities", "j24_rescored_errors", "j27_suppressed_findings",
    "f1_content_snapshot", "f4_pain_score", "v4_definition_facts", "g1_import_edges", "g3_import_cycles", "a16_component_stats",
    "a43_inferred_domains", "m2_replaced_contracts", "m3_admitted_errors", "n7_failure_streaks", "n8_suppressed_hot_keys",
    "n9_running_occurrences", "x3_stream_suppression", "x7_stream_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalogue()
    queries["p1_line_explode"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    clean_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
