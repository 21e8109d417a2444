"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomdex.plans import queries
from loomdex.plans.queries import QUERIES
from loomdex.session import session

HEADLINE = [
    "rank_relevancy", "search_term", "search_and", "search_or", "search_not", "search_phrase", "search_within", "search_prefix",
    "search_fuzzy", "search_stemmed", "search_by_index", "phrase_by_index", "posting_read", "result_count", "virtual_docs", "group_topk", "facet_counts", "abstract_page", "snippet",
    "build_postings", "lexicon_build", "doc_frequency", "forward_index", "put_latest_per_oid", "docattr_update", "stem_english",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["search_term"](spark, folder).write.format("noop").mode("overwrite").save()
    took, began = {}, time.time()
    queries.built(spark, folder)  # the index is written here, and read by the queries that use it
    wrote = time.time() - began
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "index_write_seconds": round(wrote, 3), "indexed_docs_per_second": round(docs / wrote, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
