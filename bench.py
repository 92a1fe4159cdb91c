"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "text_normalize", "query_preprocess", "bm25_term_stats", "bm25_topk", "ngram_jaccard_topk", "partial_match", "fused_search", "simple_search", "overlap_search", "dense_cosine_topk",
    "entity_features", "kg_features", "lexical_features_adv", "tfidf_similarity", "confirm_filter", "query_variants", "hard_negatives", "recall_at_k", "pipeline_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from lodestone.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
