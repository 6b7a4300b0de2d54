"""Keyed state with an initial state, stored frontier, the crawl loop and metrics over several
micro-batches, after restarts and failures."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from linkloom.operators import analyze as A
from linkloom.operators import frontier as FR
from linkloom.operators.levelled import LevelledStore
from linkloom.operators.rounds import crawl_rounds
from linkloom.session import scratch_path
from linkloom.streaming import jobs as T
from linkloom.streaming import metrics as M
from linkloom.streaming.keyed import dedupe_keyed, priority_keyed
from linkloom.streaming.loop import crawl_stream

SF = "/root/testdata/sf0.001"


class Source:
    """A folder of page files that fills up: ``add(i)`` puts the i-th part in."""

    def __init__(self, spark, parts=3):
        self.folder, self.parts = tempfile.mkdtemp(prefix="linkloom-state-"), []
        self.pages = spark.read.parquet(f"{SF}/pages.parquet")
        step = self.pages.count() // parts + 1
        for i in range(parts):
            out = os.path.join(self.folder, f"part{i}")
            self.pages.where(F.col("page_id").between(i * step, (i + 1) * step - 1)).coalesce(1).write.parquet(out)
            self.parts.append(os.path.join(out, next(f for f in os.listdir(out) if f.endswith(".parquet"))))

    def add(self, i):
        os.link(self.parts[i], os.path.join(self.folder, f"pages-{i}.parquet"))

    def stream(self, spark):
        return T.analyzed_stream(spark, self.folder, glob="pages-*.parquet", max_files=1)

    def analyzed(self, spark):
        return A.accepted(self.stream(spark))


def _run(df, out, foreach=None):
    T.use_rocksdb_state(df.sparkSession)
    w = df.writeStream.option("checkpointLocation", out + "-ckpt").trigger(availableNow=True)
    w = w.foreachBatch(foreach) if foreach else w.format("parquet").option("path", out)
    w.start().awaitTermination()


def _frontier(source, seen):
    cand = FR.page_candidates(A.accepted(A.analyze_pages(source.pages)))
    return {(r.seq, r.url, r.domain, r.fetch_priority) for r in FR.frontier_step(cand, seen, flagged=False).published.collect()}


def _seen(source):
    """Every fifth linked pair, so domains are known and unknown."""
    links = A.explode_links(A.accepted(A.analyze_pages(source.pages))).select("domain", "url").distinct()
    return links.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0)


def _got(df):
    return sorted((r.seq, r.url, r.domain, r.fetch_priority) for r in df.collect())


def test_keyed_state_over_batches_and_a_restart(spark):
    source = Source(spark)
    seen = _seen(source)
    want = _frontier(source, seen)
    out, pairs = scratch_path(spark, "keyed"), scratch_path(spark, "keyed-pairs")
    for step in ((0, 1), (2,)):                     # the second run goes on from the checkpoint
        for i in step:
            source.add(i)
        _run(priority_keyed(FR.page_candidates(source.analyzed(spark)), seen, salts=3), out)
        _run(dedupe_keyed(A.explode_links(source.analyzed(spark)), seen), pairs)
    assert _got(spark.read.parquet(out)) == sorted(want) and {p for *_, p in want} == {2, 3}
    assert sorted((r.domain, r.url) for r in spark.read.parquet(pairs).collect()) == sorted((d, u) for _, u, d, _ in want)


def test_keyed_state_without_initial_state_equals_the_table_form(spark):
    source = Source(spark)
    for i in range(3):
        source.add(i)
    out = scratch_path(spark, "keyed")
    _run(priority_keyed(FR.page_candidates(source.analyzed(spark))), out)
    assert _got(spark.read.parquet(out)) == sorted(_frontier(source, spark.createDataFrame([], "domain string, url string")))


def test_stored_frontier_over_batches_and_a_lost_commit(spark):
    source = Source(spark)
    seen = _seen(source)
    paths = [scratch_path(spark, f"stored-{k}") for k in ("pairs", "domains", "out")]
    LevelledStore(spark, paths[0]).add(-1, seen)
    LevelledStore(spark, paths[1], keys=("domain",)).add(-1, seen)
    run, fails = T.stored_frontier_batches(*paths), [1]

    def once(batch, batch_id):
        run(batch, batch_id)
        if batch_id == 1 and fails:
            fails.pop()
            raise RuntimeError("lost before the batch was committed")

    for i in range(3):
        source.add(i)
    out = scratch_path(spark, "stored-q")
    with pytest.raises(Exception, match="lost before"):
        _run(source.stream(spark), out, once)
    _run(source.stream(spark), out, once)
    assert _got(spark.read.parquet(paths[2])) == sorted(_frontier(source, seen))
    assert LevelledStore(spark, paths[0]).read().count() == LevelledStore(spark, paths[0]).read().distinct().count()


def test_crawl_stream_equals_the_rounds(spark):
    host = "http://h.com"
    links = {1: [2, 3], 2: [4], 3: [4, 1], 4: [5], 5: [1], 6: [7], 7: []}
    pages = spark.createDataFrame([(i, f"{host}/{i}", " ".join(f"<a href='/{k}'>" for k in to)) for i, to in links.items()],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([(f"{host}/1",), (f"{host}/6",), ("http://gone/",)], "url string")
    want = sorted(map(tuple, crawl_rounds(pages, seeds).collect()))
    assert {r[0] for r in want} == {1, 2, 3, 4} and (3, 1, f"{host}/1") in want      # seeds are not seen
    path, fails = scratch_path(spark, "crawl"), [2]

    def wrap(run):
        def batch(df, batch_id):
            run(df, batch_id)
            if batch_id in fails:
                fails.remove(batch_id)
                raise RuntimeError("lost in a round")
        return batch

    with pytest.raises(Exception, match="lost in a round"):
        crawl_stream(pages, seeds, path, wrap=wrap)
    got = crawl_stream(pages, seeds, path, wrap=wrap)     # taken up where it stopped
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, crawl_stream(pages, seeds, path).collect())) == want     # nothing is left to do


def test_metrics_of_each_batch(spark):
    source, out = Source(spark), scratch_path(spark, "metrics")
    for i in range(3):
        source.add(i)
    stream = M.observed(T.analyzed_stream(spark, source.folder, "pages-*.parquet", 1))

    def run():
        stream.select("page_id").writeStream.queryName("counted").format("parquet").option("path", out + "/rows") \
            .option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start().awaitTermination()

    rows = M.run_with_metrics(spark, out + "/records", "counted", run).where("input_rows > 0").orderBy("batch_id").collect()
    per = [spark.read.parquet(p) for p in source.parts]
    assert [r.counters["pages"] for r in rows] == [p.count() for p in per]
    want = [A.accepted(A.analyze_pages(p)).agg(F.sum("n_links")).first()[0] for p in per]
    assert [r.counters["links"] for r in rows] == want and sum(want) > 0
