"""Crawl rounds over a stored chain of pages (the reference's loop test)."""

import pytest

from linkloom.operators.rounds import crawl_rounds


def test_chain_rounds(spark):
    n = 8
    host = "http://localhost:8080"
    pages = spark.createDataFrame(
        [(i, f"{host}/urls-{i}", f'<html><body><ahref="/urls-{i + 1}">Link</a></body></html>')
         for i in range(1, n + 1)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(f"{host}/urls-1",)], "url string")
    with pytest.warns(UserWarning, match="pages are left"):
        rows = crawl_rounds(pages, seeds, max_rounds=5).orderBy("round").collect()
    assert [(r.round, r.url) for r in rows] == [(k, f"{host}/urls-{k}") for k in range(1, 6)]
    rows = crawl_rounds(pages, seeds).collect()
    assert len(rows) == n            # the last page links to a page not in the snapshot
