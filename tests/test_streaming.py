"""Streams over several micro-batches equal the batch answers."""

import os
import tempfile

from pyspark.sql import functions as F

from linkloom.operators import analyze as A
from linkloom.operators import frontier as FR
from linkloom.session import scratch_path
from linkloom.streaming import jobs as T

SF = "/root/testdata/sf0.01"


def _split_pages(spark, parts=3):
    d = tempfile.mkdtemp(prefix="linkloom-stream-")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = pages.count()
    step = n // parts + 1
    for i in range(parts):
        # ordered page_id ranges, one file each: batch order = page order
        pages.filter((F.col("page_id") >= i * step) & (F.col("page_id") < (i + 1) * step)) \
            .coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
        src = [f for f in os.listdir(os.path.join(d, f"part{i}")) if f.endswith(".parquet")][0]
        os.link(os.path.join(d, f"part{i}", src), os.path.join(d, f"pages-{i}.parquet"))
    return d, pages


def test_multi_batch_stream_equals_batch(spark):
    d, pages = _split_pages(spark)
    seen = spark.createDataFrame([], "domain string, url string")

    # Frontier per micro-batch against the seen table
    seen_path = scratch_path(spark, "t-seen")
    T.write_seen_batch(seen, seen_path, -1)
    out_path = scratch_path(spark, "t-out")
    stream = T.analyzed_stream(spark, d, glob="pages-*.parquet", max_files=1)
    T.run_to_table(stream, "t-frontier", foreach_batch=T.frontier_batches(seen_path, out_path))
    got = spark.read.parquet(out_path)
    assert got.select("batch_id").distinct().count() == 3
    got = {(r.seq, r.url, r.domain, r.fetch_priority) for r in got.collect()}
    cand = FR.page_candidates(A.accepted(A.analyze_pages(pages)))
    exp = {(r.seq, r.url, r.domain, r.fetch_priority)
           for r in FR.frontier_step(cand, seen, flagged=False).published.collect()}
    assert got == exp

    # Dedupe state across batches
    links = A.explode_links(A.accepted(T.analyzed_stream(spark, d, glob="pages-*.parquet", max_files=1)))
    dd = spark.read.parquet(T.run_to_table(T.dedupe_stream(links.select("domain", "url")), "t-dd"))
    assert dd.count() == dd.distinct().count() == len({(u, dm) for _, u, dm, _ in exp})

    # T4: per-domain state across batches = first URL of each domain
    c = FR.page_candidates(A.accepted(T.analyzed_stream(spark, d, glob="pages-*.parquet", max_files=1)))
    firsts = spark.read.parquet(T.run_to_table(T.domain_first_stream(c), "t-first"))
    assert {(r.seq, r.url, r.domain) for r in firsts.collect()} == \
        {(s, u, dm) for s, u, dm, p in exp if p == 2}

    # T4, all rows: priorities 2 and 3 across batches
    out_path = scratch_path(spark, "t-priority")
    stream = T.analyzed_stream(spark, d, glob="pages-*.parquet", max_files=1)
    T.run_to_table(stream, "t-priority-q", foreach_batch=T.domain_priority_batches(
        scratch_path(spark, "t-priority-state"), out_path))
    assert {(r.seq, r.url, r.domain, r.fetch_priority) for r in spark.read.parquet(out_path).collect()} == exp
    assert {p for *_, p in exp} == {2, 3}

    # T2 with flags across batches
    flags = F.col("url").contains("?"), F.col("url").contains("#")
    out_path = scratch_path(spark, "t-flagged")
    stream = T.analyzed_stream(spark, d, glob="pages-*.parquet", max_files=1)
    T.run_to_table(stream, "t-flagged-q", foreach_batch=T.frontier_batches(
        scratch_path(spark, "t-flagged-seen"), out_path, override=flags[0], recrawl=flags[1]))
    cand = FR.page_candidates(A.accepted(A.analyze_pages(pages)), *flags)
    key = ("seq", "url", "domain", "fetch_priority")
    assert sorted(tuple(r[k] for k in key) for r in spark.read.parquet(out_path).collect()) == \
        sorted(tuple(r[k] for k in key) for r in FR.frontier_step(cand, seen).published.collect())


class _ByRecord(T.MessageHook):
    def on_message(self, message):
        return [{"twice": 2 * message["id"], "id": message["id"]}] * (message["id"] % 3)

    def on_stop(self):
        return [{"id": -1, "twice": -2}]


def test_hook_by_record(spark):
    out = T.map_messages(spark.range(0, 10, 1, 2), _ByRecord, "id long, twice long").collect()
    assert sorted(r.id for r in out) == sorted([-1, -1] + [i for i in range(10) for _ in range(i % 3)])
    assert all(r.twice == 2 * r.id for r in out)
