"""The crawl loop as one stream with feedback.

The frontier's published URLs are files of the folder that the stream reads, so each
micro-batch's output is the next one's input:

    frontier/ -> fetch (join to the stored pages) -> analyse -> frontier step -> frontier/

The seen pairs and domains are levelled stores.  A batch writes the folders named after its id by
overwriting them, and both stores know the batches they hold, so a replay after a failure
gives the same rows; the next batch is planned only after the last one is committed, so the
files that a replay rewrites were never listed.  The run ends at quiescence: when
every file is processed and the last batch has published nothing.  A run that was stopped
goes on from ``path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.analyze import accepted, analyze_pages
from linkloom.operators.frontier import frontier_step, page_candidates
from linkloom.operators.levelled import LevelledStore
from linkloom.operators.rounds import fetch
from linkloom.session import reliable_checkpoint

FETCHED = "round int, page_id long, url string"


def crawl_batches(pages: DataFrame, path: str, deny=None):
    """The foreachBatch function of the loop: a batch is a round's URLs (url, round)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pairs = LevelledStore(spark, f"{path}/pairs")
        domains = LevelledStore(spark, f"{path}/domains", keys=("domain",))
        urls = reliable_checkpoint(batch.groupBy("url").agg(F.min("round").alias("round")))
        turn = urls.agg(F.max("round")).first()[0]
        if turn is None:
            return
        found = fetch(pages, urls.select("url"))
        found.select(F.lit(turn).alias("round"), "page_id", "url").write.mode("overwrite") \
            .parquet(f"{path}/fetched/batch={batch_id}")
        cand = reliable_checkpoint(page_candidates(accepted(analyze_pages(found))))
        res = frontier_step(cand, pairs.read(before=batch_id, touching=cand), deny=deny, flagged=False,
                            domains=domains.read(before=batch_id, touching=cand))
        added = reliable_checkpoint(res.additions)
        pairs.append(batch_id, added)
        domains.add(batch_id, added)
        for store in (pairs, domains):
            store.drop_versions(2)
        if not added.isEmpty():
            added.select("url", F.lit(turn + 1).alias("round")).write.mode("overwrite") \
                .parquet(f"{path}/frontier/batch={batch_id}")
    return run


def crawl_stream(pages: DataFrame, seeds: DataFrame, path: str, seen: DataFrame | None = None, deny=None,
                 wrap=lambda run: run) -> DataFrame:
    """Rows (round, page_id, url) of the pages fetched in each round, as ``rounds.crawl_rounds``
    gives them, from a stream that runs until nothing is left to fetch.

    ``path`` is a folder of the run in shared storage; a run that was stopped or failed is
    taken up there.  ``seen`` starts the seen set of a new run.  ``wrap`` may wrap the batch
    function (to measure it, for instance)."""
    spark = pages.sparkSession
    pairs = LevelledStore(spark, f"{path}/pairs")
    domains = LevelledStore(spark, f"{path}/domains", keys=("domain",))
    if not pairs.has(-2):
        start = seen if seen is not None else spark.createDataFrame([], "domain string, url string")
        domains.add(-2, start)
        seeds.select("url", F.lit(1).alias("round")).distinct().write.mode("overwrite").parquet(f"{path}/frontier/seeds")
        pairs.add(-2, start)            # last: the run has begun
    query = (spark.readStream.schema("url string, round int").option("recursiveFileLookup", True)
             .parquet(f"{path}/frontier").writeStream.option("checkpointLocation", f"{path}/checkpoint")
             .foreachBatch(wrap(crawl_batches(pages, path, deny))).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(FETCHED).option("recursiveFileLookup", True).parquet(f"{path}/fetched")
