"""Times the headline queries: median of the warm runs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftline.plans import catalog
from weftline.session import local_session

HEADLINE = ("bm25_topk", "text_search_topk", "term_df", "cosine_topk", "rrf_fusion", "neighbors", "khop_forward", "khop_backward", "reachability", "cascade_delete", "minmax_rerank", "categorize", "prefix_pack", "skipfit_pack", "char_entropy", "usage_by_model", "file_card", "page_links")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("weftline-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
