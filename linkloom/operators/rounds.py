"""Crawl rounds over a stored snapshot.

The reference's loop (fetch -> analyse -> frontier -> fetch ...) replayed on
stored pages: each round "fetches" the frontier URLs by joining them to the
snapshot on ``url``, analyses the fetched pages, and runs the frontier step
against the seen table.  The driver only sequences the rounds; every round is
a set of Spark jobs.  After each round the new seen pairs and the fetched
pages are written to the shared checkpoint folder, so the lineage never grows
with the number of rounds and a lost executor only repeats part of one round.

The bodies are read in place.  A round first finds the page ids of its URLs
from the slim columns (url, page_id), writes them, and then reads the bodies
with a semi join on page_id: with few ids Spark broadcasts them by measured
size and the bodies are filtered where they are scanned; with many, the rows
of the round are most of what is read anyway.  Nothing is copied beforehand.
"""

from __future__ import annotations

import warnings
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.analyze import accepted, analyze_pages
from linkloom.operators.frontier import frontier_step, page_candidates
from linkloom.session import scratch_path


def fetch(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The stored pages whose url is among ``urls`` (url)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "fetch-ids")
    pages.select("url", "page_id").join(urls.select("url").distinct(), "url", "left_semi") \
        .select("page_id").distinct().write.parquet(path)
    ids = spark.read.parquet(path)
    return pages.join(ids, "page_id", "left_semi").select("page_id", "url", "html")


def crawl_rounds(pages: DataFrame, seeds: DataFrame, seen: DataFrame | None = None,
                 max_rounds: int | None = None, deny=None) -> DataFrame:
    """Rows (round, page_id, url) of the pages fetched in each round.

    ``pages``: snapshot (page_id, url, html); ``seeds``: (url) to fetch in
    round 1 (not added to the seen set, as the reference's seeder bypasses
    the filter); runs until a round fetches nothing.  A caller may bound the
    rounds; a run that the bound ends early warns that it is incomplete.
    """
    spark = pages.sparkSession
    seen_path = scratch_path(spark, "rounds-seen")
    out_path = scratch_path(spark, "rounds-fetched")
    base = seen if seen is not None else spark.createDataFrame([], "domain string, url string")
    base.select("domain", "url").write.parquet(f"{seen_path}/round=0")
    frontier = seeds.select("url").distinct()
    for r in count(1):
        if max_rounds is not None and r > max_rounds:
            if not pages.join(frontier, "url", "left_semi").isEmpty():
                warnings.warn(f"crawl_rounds stopped at max_rounds={max_rounds}; pages are left", stacklevel=2)
            break
        fetched = fetch(pages, frontier)
        fetched.select(F.lit(r).alias("round"), "page_id", "url") \
            .write.parquet(f"{out_path}/r={r}")
        done = spark.read.parquet(f"{out_path}/r={r}")
        if done.isEmpty():
            break
        cand = page_candidates(accepted(analyze_pages(fetched)))
        stored = spark.read.parquet(seen_path).select("domain", "url")
        res = frontier_step(cand, stored, deny=deny, flagged=False)
        res.additions.write.parquet(f"{seen_path}/round={r}")
        frontier = spark.read.parquet(f"{seen_path}/round={r}").select("url")
    return spark.read.parquet(out_path).select("round", "page_id", "url")
