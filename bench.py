"""One JSON line with seconds per headline query: python bench.py."""

import json
import os
import time

from millrace.plans.queries import QUERIES
from millrace.session import build_session

HEADLINE = ("quality_funnel", "silver_rows", "lexicon_match", "term_frequency", "grounding", "validate_extraction", "three_way_assembly", "stratified_proportional", "confusion", "profile_lengths", "knn_topk", "upsert_latest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
