"""Headline-query timings. Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_text", "preprocess_corpus", "lang_detect", "sentiment", "emotion", "rhetoric",
            "tfidf_weights", "top_terms", "term_context", "mwu_features", "run_stats", "rhetoric_tests",
            "key_findings", "bootstrap_ci", "mwu_lineitem", "chi2_labels", "domain_summary", "box_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from contrasta.session import local_session
    from contrasta.plans.catalog import QUERIES

    spark = local_session(cpus, max(cpus, 8), app="contrasta-bench")
    # warm the JVM and code paths on the smallest tables (not timed)
    QUERIES["top_terms"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    timings = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[n] = round(time.perf_counter() - t0, 3)
        print(f"{n}: {timings[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
