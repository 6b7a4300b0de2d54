"""Sources/sinks round trips, and the skew-safe shape of the frontier plan."""

import os
import tempfile

from pyspark.sql import functions as F

from linkloom.operators.analyze import accepted, analyze_pages
from linkloom.operators.frontier import frontier_step
from linkloom.operators.graph import append_edges, domain_edges, read_edges
from linkloom.operators.seen import append_seen
from linkloom.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="linkloom-test-")


def test_seed_file(spark):
    d = _tmp()
    path = os.path.join(d, "seeds.txt")
    with open(path, "w") as f:
        f.write("http://a.com/x\n  https://b.org/y  \n\nhttp://c.net\n")
    rows = io.read_seeds(spark, path).collect()
    assert [(r.url, r.domain) for r in rows] == [
        ("http://a.com/x", "a.com"), ("https://b.org/y", "b.org"), ("", ""), ("http://c.net", "c.net")]


def test_messages_roundtrip(spark):
    pages = spark.createDataFrame([(1, "http://h.com/p", "<a href='/a'> http://x.org/q")],
                                  "page_id long, url string, html string")
    a = accepted(analyze_pages(pages))
    d = os.path.join(_tmp(), "msgs")
    io.write_messages(a, d)
    back = io.read_messages(spark, d).collect()
    assert back[0].url == "http://h.com/p"
    assert [(u.url, u.domain) for u in back[0].urls] == [("http://h.com/a", "h.com"),
                                                         ("http://x.org/q", "x.org")]
    js = io.to_messages(a).first().value
    assert js.startswith('{"url":"http://h.com/p","domain":"h.com","urls":[')


def test_malformed_messages(spark):
    import pytest
    d = _tmp()
    lines = ['{"url":"u","domain":"d","urls":[{"url":"v","domain":"e"}]}', '{"url":"cut', "", "[1]", '{"url":null}']
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    with pytest.raises(Exception, match="error 13"):
        io.read_messages(spark, d).collect()
    kept = io.read_messages(spark, d, malformed="reject").collect()
    assert [(r.url, r.domain, r.urls and len(r.urls)) for r in kept] == [("u", "d", 1), (None, None, None)]
    assert sorted((r.value, r.error) for r in io.rejected_messages(spark, d).collect()) == \
        sorted((x, 13) for x in lines[1:4])
    with pytest.raises(ValueError):
        io.read_messages(spark, d, malformed="skip")


def test_small_tables_are_dealt_over_the_cores(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = "/root/testdata/sf0.01/pages.parquet"
    assert io.read_pages(spark, path).rdd.getNumPartitions() == 4
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")       # the table is larger than a split
        plan = io.read_pages(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_edges_append_and_scan(spark):
    pages = spark.createDataFrame([(1, "http://h.com/p", "<a href='http://x.org/'>")],
                                  "page_id long, url string, html string")
    d = os.path.join(_tmp(), "edges")
    e = domain_edges(accepted(analyze_pages(pages)), 7)
    append_edges(e, d)
    append_edges(e, d)
    rows = read_edges(spark, d).collect()
    assert len(rows) == 2 and {(r.source, r.target, r.observed) for r in rows} == {("h.com", "x.org", 7)}


def test_edge_append_is_idempotent_per_batch(spark):
    d = os.path.join(_tmp(), "edges")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 1)], "source string, target string, observed long")
    for batch in (0, 1, 1):                  # the last is a replay
        append_edges(edges, d, batch)
    assert read_edges(spark, d).count() == 4 and read_edges(spark, d).columns == ["source", "target", "observed"]


def test_seen_append_is_idempotent_per_batch(spark):
    d = os.path.join(_tmp(), "seen")
    add = spark.createDataFrame([("a", "a/1"), ("b", "b/1")], "domain string, url string")
    append_seen(add, d, batch_id=0)
    append_seen(add, d, batch_id=0)          # replay of the same batch
    append_seen(add.limit(1), d, batch_id=1)
    assert spark.read.parquet(d).count() == 3


def test_fan_out_feeds_two_sinks(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    got = []
    io.fan_out(df, [lambda d: got.append(d.count()), lambda d: got.append(d.agg(F.sum("x")).first()[0])])
    assert got == [10, 90]


def test_hot_domain_is_combined_before_shuffle(spark):
    # one domain holds a third of all candidates
    rows = []
    for i in range(3000):
        d = "hot.com" if i % 3 == 0 else f"d{i % 97}.com"
        rows.append((i, f"http://{d}/{i % 500}", d))
    cand = spark.createDataFrame(rows, "seq long, url string, domain string")
    seen = spark.createDataFrame([("d1.com", "http://d1.com/1")], "domain string, url string")
    res = frontier_step(cand, seen, flagged=False)
    plan = res.published._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "partial_min(seq" in plan          # map-side combine of the pair minimum
    pub = res.published.collect()
    hot = [r for r in pub if r.domain == "hot.com"]
    assert len(hot) == 500
    assert sorted(r.fetch_priority for r in hot)[:2] == [2, 3]
    pairs = {(d, u) for _, u, d in rows}
    assert len(pub) == len(pairs) - 1         # every unstored pair once


def test_page_work_has_no_shuffle_on_large_scans(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    many = pages.repartition(64)             # a scan with more partitions than cores
    plan = accepted(analyze_pages(many))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1       # only the test's own repartition
    edges = domain_edges(accepted(analyze_pages(many)), 1)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_page_files_and_two_tier(spark):
    from linkloom.operators import bloom as B
    d = _tmp()
    for i in range(3):
        with open(os.path.join(d, f"p{i}.html"), "w") as f:
            f.write(f"<p>page {i}</p>\n<a href='http://x{i}.org/a'>\n")
    pages = io.read_page_files(spark, d).withColumn("page_id", F.monotonically_increasing_id())
    a = accepted(analyze_pages(pages))
    assert sorted(u.domain for r in a.collect() for u in r.urls) == ["x0.org", "x1.org", "x2.org"]
    prm = B.BloomParams(1000, .01)
    stored = spark.createDataFrame([("http://a/1",), ("http://a/2",)], "url string")
    probes = spark.createDataFrame([("http://a/1",), ("http://b/1",), ("http://a/2",)], "url string")
    got = {r.url: (r.in_bloom, r.known) for r in
           B.two_tier_known(probes, "url", B.bloom_build(stored, "url", prm), stored, prm).collect()}
    assert got["http://a/1"] == (True, True) and got["http://a/2"] == (True, True)
    assert got["http://b/1"][1] is False


def test_observed_link_metrics(spark):
    from linkloom.operators.analyze import observe_links
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    df, obs = observe_links(analyze_pages(pages))
    df.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert m["pages"] == 250 and m["accepted"] == 250 and m["rejected"] == 0
    assert m["links"] == 1404


def test_bucketed_seen_is_read_in_place(spark):
    from linkloom.operators.seen import write_seen_table
    from linkloom.session import scratch_path
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = spark.range(2000).select(F.concat(F.lit("d"), (F.col("id") % 50).cast("string")).alias("domain"),
                                        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
        st = write_seen_table(seen, scratch_path(spark, "seen-t"))
        cand = spark.range(500).select(F.col("id").alias("seq"),
                                       F.concat(F.lit("u"), (F.col("id") * 7).cast("string")).alias("url"),
                                       F.concat(F.lit("d"), (F.col("id") * 7 % 50).cast("string")).alias("domain"))
        res = frontier_step(cand, st, flagged=False)
        plan = res.published._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = [i for i, l in enumerate(lines) if "Bucketed: true" in l]
        assert scan, plan
        # the line above the bucketed scan is the join input, not an exchange
        assert "Exchange" not in lines[scan[0] - 1]
        exp = {(i, f"u{i * 7}") for i in range(500) if i * 7 >= 2000}   # urls not stored
        assert {(r.seq, r.url) for r in res.published.collect()} == exp
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_command_line(spark, capsys):
    from linkloom.__main__ import main
    assert main(["list"]) == 0
    assert "frontier_step" in capsys.readouterr().out
    out = os.path.join(_tmp(), "seeds")
    assert main(["run", "seeds", "/root/testdata/sf0.001", out]) == 0
    assert spark.read.parquet(out).count() == 50
    assert main(["run", "no_such_query", "/root/testdata/sf0.001", out]) == 2
