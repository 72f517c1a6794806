"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and
threads.  Every query runs to completion into a sink that keeps nothing.
"""

import json
import os
import time

from wardlight.plans import catalog
from wardlight.session import build_session, clear_scratch

HEADLINE = [
    "src5_hosts_from_visits", "val1_validate_domain", "sf_structural_features", "jn5_nearest_popular",
    "nf1_dns_features", "nf4_whois_features", "asm1_assemble", "asm3_build_feature_matrix",
    "enc1_fit_vocab", "jn3_route_verdicts", "jn6_latest_snapshot", "jn7_cached_hits", "jn9_navigation_pairs",
    "ml13_evaluate", "ag8_threshold_sweep", "wn1_latest_per_domain", "wn4_explain_top_reasons",
    "st2_collapse_inflight", "st4_visit_sessions", "st5_rate_limit_report", "analyze_hosts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
