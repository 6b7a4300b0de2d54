"""URL split / resolve / encode against stated results, and seeds."""

import random

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators.analyze import analyze_pages, explode_links
from linkloom.sources import io

# One group a rule of the resolver; (page, link, resolved).
RULES = {
    "a link with a host keeps its scheme, another host's is IDNA-encoded": [
        ("ftp://p.test/q", "https://o.test:81/r;s?t", "https://o.test:81/r;s?t"),
        ("http://p.test", "http://stra\u00dfe.test/", "http://strasse.test/"),
        ("http://p.test", "http://\u00f6.test/\u00f6?\u00f6#x", "http://xn--nda.test/%C3%B6?%C3%B6")],
    "without a scheme: the page's for its own host, http for others": [
        ("https://p.test/q", "//p.test/r", "https://p.test/r"), ("https://p.test/q", "//o.test/r", "http://o.test/r")],
    "a colon in the path makes the path the host as well": [
        ("http://p.test/q", "x:8", "x://p.test/8"), ("https://p.test/", "/k:v", "http:///k:v/k:v")],
    "a dot and a slash make the path a host and a path": [
        ("https://p.test/q", "o.test/r/s", "http://o.test/r/s"), ("https://p.test/q", "/r.s", "http:///r.s"),
        ("https://p.test/q", "o.test/r?lost", "http://o.test/r")],
    "any other path is joined to the page's": [
        ("https://p.test/q/r", "s", "https://p.test/q/s"), ("https://p.test/q/r/", "s.t", "https://p.test/q/r/s.t"),
        ("https://p.test/q/r", "..", "https://p.test/"), ("https://p.test/q?u", "/v/w", "https://p.test/v/w"),
        ("https://p.test/q", "?n=1", "https://p.test/q?n=1"), ("https://p.test/q", "#f", "https://p.test/q")],
    "path and query are percent-encoded, a blank of the query is a plus": [
        ("http://p.test/", "/a b", "http://p.test/a%20b"), ("http://p.test/", "/c?d e", "http://p.test/c?d+e"),
        ("http://p.test/", "/%41|", "http://p.test/%41%7C")],
}
CASES = [case for group in RULES.values() for case in group]


def _resolve(spark, pairs, **kw):
    rows = [(i, o, '<a href="%s">' % l) for i, (o, l) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = analyze_pages(df, **kw).collect()
    return {r.page_id: r for r in out}


def test_stated_cases(spark):
    got = _resolve(spark, [(o, l) for o, l, _ in CASES])
    for i, (o, l, exp) in enumerate(CASES):
        assert got[i].error is None
        assert got[i].urls[0].url == exp, (o, l)


def test_bad_host_rejects_page(spark):
    got = _resolve(spark, [("http://h.com/", "http://a..b/x"), ("http://h.com/", "http://" + "a" * 64 + ".c/"),
                           ("http://h.com/", "http://a.b./x")])
    assert got[0].error == 13 and got[1].error == 13 and got[2].error is None


def test_percent_encode(spark):
    df = spark.createDataFrame([("a b+c%20/é?#[]😀",)], "s string")
    r = df.select(U.percent_encode(F.col("s")).alias("q"),
                  U.percent_encode(F.col("s"), plus_spaces=True).alias("p")).first()
    assert r.q == "a%20b+c%20/%C3%A9?#[]%F0%9F%98%80"
    assert r.p == "a+b+c%20/%C3%A9?#[]%F0%9F%98%80"


def test_endpoint_parts(spark):
    df = spark.createDataFrame([("http://a.com",), ("https://A.com:8443/x?q",), ("/x",)], "u string")
    rows = df.select(U.endpoint(F.col("u")).alias("e")).collect()
    e = [r.e for r in rows]
    assert (e[0].netloc, e[0].hostname, e[0].port, e[0].path, e[0].ssl, e[0].error) == \
        ("a.com", "a.com", 80, "/", False, None)
    assert (e[1].netloc, e[1].hostname, e[1].port, e[1].path, e[1].ssl) == \
        ("A.com:8443", "a.com", 8443, "/x", True)
    assert e[2].error == 13


def test_seeds_strip_and_blank_lines(spark):
    lines = spark.createDataFrame([("  http://a.com/x \t",), ("",), ("　https://b.org ",)], "value string")
    rows = io.seeds_from_lines(lines).collect()
    assert [(r.url, r.domain) for r in rows] == [("http://a.com/x", "a.com"), ("", ""),
                                                 ("https://b.org", "b.org")]


def test_explode_positions(spark):
    df = spark.createDataFrame([(1, "http://h.com/p", "<a href='/a'><a href='/b'>")],
                               "page_id long, url string, html string")
    rows = explode_links(analyze_pages(df)).orderBy("pos").collect()
    assert [(r.pos, r.url) for r in rows] == [(0, "http://h.com/a"), (1, "http://h.com/b")]


def test_jvm_idna_equals_python_codec(spark):
    import random
    from linkloom.functions.idna import idna_host, jvm_idna
    rnd = random.Random(2)
    alphabet = list("abcXYZ09-.") + list("初音ミクはかわいいüéßİıＡＢ。．ﬁ") + ["­", "‍", "😀", "ا", "ب", "́", "ς"]
    hosts = ["初音ミク.com", "ex😀.com", "bücher.de.", "ü" * 70 + ".com", "．", "a。。b", "ΑΒΓ.gr", "初音ミク.com:80"]
    hosts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    hosts = [h for h in hosts if not h.isascii()]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    rows = df.select("h", jvm_idna(F.col("h")).alias("j"), idna_host(F.col("h")).alias("p")).collect()
    assert [r.h for r in rows if r.j != r.p] == []
