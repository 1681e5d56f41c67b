"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from sparkloom.plans import catalog
from sparkloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["a01_kpi_windows", "a04_hot_tools", "a16_document_frequency", "w04_w05_segments", "w10_net_changes", "w13_merge_intervals", "j07_undelivered", "j20_boundary_links", "j21_c05_item_diff", "r05_bm25", "r07_dense_search", "r11_semantic_search", "r12_hybrid_search", "g07_subgraph", "g10_impact", "x01_session_key", "x06_confirm_offers"]


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy("event_type").count().collect()  # starts the engine
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
