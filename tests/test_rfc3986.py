"""Reference resolution by RFC 3986 against the RFC's own examples."""

from pyspark.sql import functions as F

from linkloom.functions import rfc3986 as R
from linkloom.operators.analyze import accepted, analyze_pages, rejected

BASE = "http://a/b/c/d;p?q"

# The examples of RFC 3986, sections 5.4.1 and 5.4.2 (strict).
EXAMPLES = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"),
    ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"),
    ("g;x?y#s", "http://a/b/c/g;x?y#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"),
    ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"),
    ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"),
    ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"),
    ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"),
    ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/./x", "http://a/b/c/g#s/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"),
    ("http:g", "http:g"),
]


def _resolved(spark, base, references):
    df = spark.createDataFrame([(base, references)], "base string, refs array<string>")
    df = df.select("refs", R.components(F.col("base")).alias("b"))
    return df.select(F.transform(R.resolve(F.col("refs"), F.col("b")), R.recompose).alias("out")).first().out


def test_the_examples_of_the_rfc(spark):
    assert _resolved(spark, BASE, [r for r, _ in EXAMPLES]) == [want for _, want in EXAMPLES]


def test_corners(spark):
    assert _resolved(spark, "http://h", ["x", "../x", "?q", ""]) == ["http://h/x", "http://h/x", "http://h?q", "http://h"]
    # empty components are not undefined ones
    assert _resolved(spark, "http://h/p?q", ["?", "#", "g?#", "//"]) == [
        "http://h/p?", "http://h/p?q#", "http://h/g?#", "http://"]
    assert _resolved(spark, "http://h/a//b", ["../c", "..//c", "x//../y"]) == [
        "http://h/a/c", "http://h/a//c", "http://h/a//x/y"]
    assert _resolved(spark, "http://h/a", ["HTTP://X/./y", "s:a/../b", "s:../b", "s:a/.."]) == [
        "http://X/y", "s:/b", "s:b", "s:/"]


def test_pages_skip_what_is_no_web_link(spark):
    html = ("<a href='mailto:a@b.c'> <a href='../x/./y z'> <a href='?q=1 2#f'> <a href='//B\u00fccher.org/'> "
            "<a href='http://no..host/'> <a href='javascript:f()'> <a href='https://k.com'>")
    pages = spark.createDataFrame([(1, "http://h.com/p/q?r", html), (2, None, "x"), (3, "http://h.com/", None)],
                                  "page_id long, url string, html string")
    out = analyze_pages(pages, mode="rfc3986")
    row = accepted(out).first()
    assert [(u.url, u.domain) for u in row.urls] == [
        ("http://h.com/x/y%20z", "h.com"), ("http://h.com/p/q?q=1%202", "h.com"),
        ("http://xn--bcher-kva.org/", "xn--bcher-kva.org"), ("https://k.com", "k.com")]
    assert row.n_links == 4 and {(r.page_id, r.error) for r in rejected(out).collect()} == {(2, 12), (3, 12)}
    kept = accepted(analyze_pages(pages, mode="rfc3986", drop_fragments=False, drop_query=True)).first()
    assert kept.urls[1].url == "http://h.com/p/q#f"
