"""Every registered query equals its oracle SQL (DuckDB) on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dict):
        return tuple(sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "url", "domain", "fetch_priority"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows, cols = df.collect(), df.columns
    rel = con.sql(E.oracle_sql()[name])
    orows, ocols = rel.fetchall(), rel.columns
    assert sorted(cols) == sorted(ocols)
    ia = [cols.index(c) for c in sorted(cols)]
    ib = [ocols.index(c) for c in sorted(ocols)]
    a = sorted((tuple(_norm(r[i]) for i in ia) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in ib) for r in orows), key=repr)
    assert a == b


def test_oracle_and_spark_agree_on_joined_path_corners(spark):
    """Blanks, '//' forms, params and dot segments in relative links."""
    import random
    import tempfile

    from linkloom.plans import queries as Q
    rnd = random.Random(8)
    origins = ["http://h.com/fr/825?page=2", "https://a.b.c/x/y/", "http://h.com/a//b/c",
               "http://h.com/a/./b/../c"]
    pieces = ["/", "//", ".", "..", "a", "b", ";", " ", "\x01", "x", "=", "-", "%20"]
    rows = [(i, rnd.choice(origins),
             '<a href="%s">' % "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 7))))
            for i in range(800)]
    d = tempfile.mkdtemp(prefix="linkloom-oracle-")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1) \
        .write.parquet(d + "/pages.parquet")
    got = sorted((r.page_id, r.url, r.domain) for r in Q.q_links_resolved(spark, d).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    assert got == sorted(c.sql(E.oracle_sql()["links_resolved"]).fetchall())
