"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local threads.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from lexivane.operators import index as I
from lexivane.plans import workloads as W
from lexivane.plans.store import TableStore

HEADLINE = [
    "search_all", "search_one_collection", "search_one_base", "search_unified", "search_phonetic", "search_benchmark",
    "recall_candidates", "zipf_exponent", "collection_profile", "word_chains", "bigrams", "append_packed",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexivane-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, action):
        begin = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - begin, 3)

    built = {}
    timed("index_build", lambda: built.update(index=I.build_index(W.corpus(spark, folder), TableStore(spark))))
    W._indexes[(spark.sparkContext.applicationId, folder)] = built["index"]
    for name in HEADLINE:
        timed(name, lambda: W.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    n_chunks = built["index"].chunk_stats.count()
    n_queries = W.table(spark, folder, "benchmark").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "chunks": n_chunks,
                "chunks_per_sec": round(n_chunks / seconds["index_build"], 1),
                "batched_queries_per_sec": round(n_queries / seconds["search_benchmark"], 2),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
