"""Seconds of headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lexispark.plans import catalog

HEADLINE = [
    "tokenize_counts", "chunk_stats", "stem_vocabulary", "term_idf", "bm25_docs", "prf_search", "rrf_hybrid", "retrieve_topk", "relevance_rescore", "vec_search",
    "recategorize_plan", "migrate_plan", "decay_report", "learn_upsert", "manifest_diff", "delta_postings", "overview", "tag_counts_top50", "conv_hash", "parse_tasks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # warm-up
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
