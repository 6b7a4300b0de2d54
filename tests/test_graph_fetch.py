"""Domain edges and fetch results."""

import hashlib

from pyspark.sql import functions as F

from linkloom.operators import fetchlog as R
from linkloom.operators.graph import domain_edges

MSG = "url string, urls array<struct<url:string,domain:string>>"


def test_edges_one_per_distinct_target(spark):
    urls = [{"url": f"http://test{n}.com/a", "domain": f"test{n}.com"} for n in range(100)]
    urls += [{"url": "http://test1.com/b", "domain": "test1.com"}]
    df = spark.createDataFrame([("http://origin.com", urls), (None, urls), ("http://x.com", [])], MSG)
    rows = domain_edges(df, 123).collect()
    assert len(rows) == 100
    assert {r.source for r in rows} == {"origin.com"} and {r.observed for r in rows} == {123}


def test_body_cutoff(spark):
    body = "ab\ncd\nefghij\nk"          # 14 bytes
    df = spark.createDataFrame([(body,), ("科学の限界を超えて私は来たんだよ",)], "b string")
    r = df.select(R.body_cutoff(F.col("b"), 4).alias("c"), R.body_cutoff(F.col("b"), 100).alias("d"),
                  R.body_cutoff(F.col("b"), 13).alias("e"), R.body_md5(F.col("b")).alias("m")).collect()
    assert (r[0].c.ok, r[0].c.kept_bytes) == (False, 6)
    assert (r[0].d.ok, r[0].d.kept_bytes) == (True, 14)
    assert (r[0].e.ok, r[0].e.kept_bytes) == (False, 13)
    assert r[1].m == hashlib.md5("科学の限界を超えて私は来たんだよ".encode()).hexdigest()
    assert r[1].d.kept_bytes == len("科学の限界を超えて私は来たんだよ".encode())


def test_response_parse(spark):
    raws = [
        "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: 1\r\nX-A: 2\r\n\r\nhello\nworld",
        "HTTP/1.1 500 Internal Server Error\r\n\r\n",
        "garbage line\r\n\r\nbody",
        "HTTP/1.0 404 Not Found\r\nA: b\r\n",
    ]
    for code in (200, 301, 412, 404, 500):
        raws.append(f"HTTP/1.1 {code} X\r\n\r\n")
    df = spark.createDataFrame(list(enumerate(raws)), "url long, raw string")
    out = {r.url: r for r in R.response_outcome(df, 1000, 1000).collect()}
    assert out[0].success and out[0].http_code == 200 and out[0].headers["X-A"] == "1"
    assert out[0].md5 == hashlib.md5(b"hello\nworld").hexdigest() and out[0].body_bytes == 11
    assert out[1].success and out[1].http_code == 500
    assert out[2].headers_valid is False and out[2].http_code is None
    assert out[3].headers_valid and out[3].body_bytes == 0
    assert [out[i].http_code for i in range(4, 9)] == [200, 301, 412, 404, 500]
    small = {r.url: r for r in R.response_outcome(df, 8, 1000).collect()}
    assert small[0].success is False and small[0].error == 11
    hdr = {r.url: r for r in R.response_outcome(df, 1000, 40).collect()}
    assert hdr[0].error == 11 and hdr[1].success


def test_head_has_no_body(spark):
    df = spark.createDataFrame([("u", "HTTP/1.1 200 OK\r\n\r\nxyz", "HEAD")], "url string, raw string, m string")
    r = R.response_outcome(df, method_col="m").first()
    assert r.body_bytes == 0 and r.md5 == hashlib.md5(b"").hexdigest()


def test_binary_raw_response(spark):
    body = "科学の限界".encode("utf-8")
    raw = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + body
    df = spark.createDataFrame([("u", bytearray(raw))], "url string, raw binary")
    r = R.response_outcome(df).first()
    assert r.success and r.http_code == 200 and r.body_bytes == len(body)
    assert r.md5 == hashlib.md5(body).hexdigest()
    assert r.headers["Content-Type"] == "text/plain"
