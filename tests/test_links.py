"""Link extraction: stated cases, edge cases, random strings vs model."""

import random

import pytest
from pyspark.sql import functions as F

from link_model import scan_links
from linkloom.functions.links import extract_links, extract_links_simple



def _anchor_cases():
    """A quoted value after the letters h, r, e, f, = of a tag that begins with '<a'."""
    for opening in ("<a ", "<abbr title=t ", "<a\n\t"):
        for quote in "'\"":
            for value in ("/rooted", "rel/x.y", "#frag", "mailto:p@q.test", "two words", "\u00fc\u4e16"):
                yield f"{opening}href={quote}{value}{quote}>", [value]
    yield "<a h-r-e-f = 'spaced'>", []                      # a blank, no quote, follows the '='
    yield "<a hot red elf='letters in order'>", ["letters in order"]
    yield "<a href=unquoted>", []
    yield "<a rel='nofollow'>", []
    yield "<a href=''>", []
    yield "<b href='other tag'>", []
    yield "<A href='capital'>", []
    yield "<a hre='no f'>", []
    yield "<a href='open to the end", ["open to the end"]
    yield "<a href='cut at > the bracket'>", ["cut at "]
    yield "<a href='mixed quotes\">", ["mixed quotes"]
    yield "<a href='one' href='two' href='one'>", ["one", "two"]
    yield "<a><b href='after the bracket'>", []


def _bare_cases():
    """Bare links: every prefix of the two openings alone gives nothing."""
    for scheme in ("http://", "https://"):
        for k in range(1, len(scheme) + 1):
            yield f"{scheme[:k]} rest", []
        for end in (" ", "\n", "\"", "<", ">", "{", "\u00e9", ""):
            yield f"in text {scheme}k{len(end)}.test/p?q=1#f%20{end}tail" if end else f"{scheme}end.test", \
                [f"{scheme}k{len(end)}.test/p?q=1#f%20"] if end else [f"{scheme}end.test"]
    yield "hhttp://doubled.test", ["http://doubled.test"]
    yield "httphttp://again.test", ["http://again.test"]
    yield "httpshttps://s.test", ["https://s.test"]
    yield "HTTP://upper.test ftp://other.test", []


def _mixed_cases():
    yield ("<ol><li>https://one.test/1</li>\n<li><a class=c href='two'>two</a></li>"
           "<li><a name=n>http://three.test</a></li></ol>", ["https://one.test/1", "two", "http://three.test"])
    yield "<a href='http://in.test/x'>http://in.test/x</a>", ["http://in.test/x"]
    yield "<a title=http://hidden.test href=\"shown\">", ["shown"]
    yield "http://first.test<a href='next'>", ["http://first.test"]      # the '<' is eaten with the link
    yield "<img src=\"https://img.test/i.png\"> <!-- http://comment.test -->", ["https://img.test/i.png",
                                                                                  "http://comment.test"]
    yield "", []


CASES = [*_anchor_cases(), *_bare_cases(), *_mixed_cases()]


def _run(spark, docs, fn=extract_links):
    df = spark.createDataFrame(list(enumerate(docs)), "id long, html string")
    rows = df.select("id", fn(F.col("html")).alias("l")).collect()
    return {r.id: list(r.l) for r in rows}


def test_stated_and_edge_cases(spark):
    got = _run(spark, [d for d, _ in CASES])
    for i, (doc, exp) in enumerate(CASES):
        assert got[i] == exp, doc


def test_model_agrees_on_cases():
    for doc, exp in CASES:
        assert scan_links(doc) == exp, doc


def test_random_documents_match_model(spark):
    rnd = random.Random(11)
    pieces = ["<a", "<", "a", "h", "ttp", "s", ":", "//", "href", "=", "'", '"', ">", " ",
              "x.y/", "é", "r", "e", "f", "\n", "%2F", "?q=1"]
    docs = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    got = _run(spark, docs)
    bad = [d for i, d in enumerate(docs) if got[i] != scan_links(d)]
    assert not bad, bad[:5]


def test_simple_form_misses_only_reentry(spark):
    docs = ["x <a href='u1' id=1 href=\"u2\"> y", "httpsttp://c.d"]
    got = _run(spark, docs, extract_links_simple)
    assert got[0] == ["u1"] and got[1] == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_pages_two_pass_equals_model(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    rows = p.select("page_id", "html", extract_links(F.col("html")).alias("l")).collect()
    assert sum(len(r.l) for r in rows) == 1404
    for r in rows:
        assert list(r.l) == scan_links(r.html)


def test_text_mode_newlines(spark):
    from linkloom.sources.io import text_mode
    docs = ["<a href='x\r\ny'> http://a.b/c\rd <a href='p\rq'>", "plain\n<a href='u'>"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, html string")
    rows = {r.id: list(r.l) for r in
            df.select("id", extract_links(text_mode(F.col("html"))).alias("l")).collect()}
    assert rows[0] == ["x\ny", "http://a.b/c", "p\nq"]
    assert rows[1] == ["u"]


def test_long_runs_need_no_stack(spark):
    """Runs of 20,000 pieces once overflowed the matcher's stack in a task."""
    many = "<a" + "".join(f" href='u{i}'" for i in range(20_000))
    assert len(_run(spark, [many, "h" + "ttp" * 20_000], extract_links)[0]) == 20_000
