"""Scaling run: the sf pages replicated N times with a changed host per copy.

    python tools/scale_bench.py /root/testdata/sf0.1 100 /tmp/<fresh folder>

Writes ``<out>/pages.parquet`` (derived by Spark from the given table, one
host prefix per copy so resolved URLs and domains differ), then times the
page-heavy queries on it and prints one JSON line.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from linkloom.plans.queries import QUERIES  # noqa: E402
from linkloom.session import get_session  # noqa: E402

NAMES = ["links_extract", "links_resolved", "frontier_step", "domain_edges",
         "seen_exists", "bloom_build", "fetch_outcome"]


def main():
    src, copies, out = sys.argv[1], int(sys.argv[2]), sys.argv[3]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="linkloom-scale", shuffle_partitions=4 * cpus)
    pages_out = os.path.join(out, "pages.parquet")
    if not os.path.exists(pages_out):
        base = spark.read.parquet(f"{src}/pages.parquet")
        big = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) \
            .select(
            (F.col("page_id") + F.col("copy") * 10_000_000).alias("page_id"),
            F.regexp_replace("url", "://", F.concat(F.lit("://c"), F.col("copy").cast("string"),
                                                   F.lit("-"))).alias("url"),
            "html")
        big.repartition(64).write.parquet(pages_out)
    n = spark.read.parquet(pages_out).count()
    times = {}
    for name in NAMES:
        t0 = time.perf_counter()
        QUERIES[name](spark, out).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 2)
    print(json.dumps({"pages": n, "copies": copies, "cpus": cpus, "queries": times}))


if __name__ == "__main__":
    main()
