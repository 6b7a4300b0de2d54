"""Bloom filter: hash vectors, sizing, bounds, build/probe."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import bloom as B

FOX = "The quick brown fox jumps over the lazy dog."
# Bit indexes that a compatible hash must give.
VECTORS = [
    (10000, .1, FOX, [106, 28839, 9649]),
    (100000, .1, FOX, [182036, 20641, 338500]),
    (1000000, .1, FOX, [2573904, 4330228, 1294025]),
    (10000000, .1, FOX, [40914088, 47462949, 6086521]),
    (100000000, .1, FOX, [424316384, 47462917, 149862370]),
    (10000, .01, "123", [33468, 87452, 70234, 28372, 11158, 89796]),
    (100000, .01, "asd", [817997, 798561, 685518, 666086, 553047, 440010]),
    (1000000, .01, "123asd", [6968780, 5734018, 4499258, 2403188, 1168432, 8657424]),
    (10000000, .01, "asd123(*#^!", [68148260, 32510192, 74413770, 38775706, 3137644, 45041228]),
    (100000000, .001, "初音ミクはかわいいですか",
     [1109719310, 165476191, 640682858, 1115889527, 153337442, 628544115, 1103750790,
      141198711, 616405390]),
]


@pytest.mark.parametrize("max_n,p,content,expected", VECTORS)
def test_hash_vectors_numpy(max_n, p, content, expected):
    prm = B.BloomParams(max_n, p)
    h, ok = B.fnv1_64_many([content])
    assert ok[0]
    assert list(B.composite_indexes(h, prm.k, prm.m)[0]) == expected


def test_hash_vectors_in_spark(spark):
    rows = [(i, c) for i, (_, _, c, _) in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, "i int, s string")
    for i, (max_n, p, _, exp) in enumerate(VECTORS):
        prm = B.BloomParams(max_n, p)
        got = B.with_bloom_indexes(df.filter(F.col("i") == i), "s", prm, "x").first().x
        assert list(got) == exp


def test_sizing_and_rate():
    prm = B.BloomParams(10_000_000, .01)
    assert (prm.m, prm.k) == (95850583, 6)
    assert round(prm.error_rate(0), prm.decimals) == 0.0
    small = B.BloomParams(10_000, .1)
    rates = [small.error_rate(n) for n in range(0, 10_000, 500)]
    assert rates == sorted(rates) and len(set(rates)) == len(rates)
    assert small.capacity() == 10_000          # the 10,001st add fails with code 4


def test_nul_is_rejected(spark):
    h, ok = B.fnv1_64_many(["a\x00b", "ab", None, ""])
    assert list(ok) == [False, True, False, True]
    assert int(h[3]) == B.FNV64_OFFSET
    df = spark.createDataFrame([("a\x00b",), ("ab",), (None,)], "s string")
    rows = B.with_bloom_indexes(df, "s", B.BloomParams(1000, .01), "x").collect()
    assert rows[0].x is None and len(rows[1].x) == 6 and rows[2].x is None


def test_build_probe_no_false_negatives(spark):
    prm = B.BloomParams(2000, .05)
    members = spark.range(1500).select(F.concat(F.lit("http://m/"), F.col("id").cast("string")).alias("u"))
    others = spark.range(4000).select(F.concat(F.lit("http://o/"), F.col("id").cast("string")).alias("u"))
    bloom = B.bloom_build(members, "u", prm)
    assert bloom.count() <= prm.words
    m = B.bloom_contains(bloom, members, "u", prm)
    assert m.filter(~F.col("in_bloom")).count() == 0
    fp = B.bloom_contains(bloom, others, "u", prm).filter("in_bloom").count() / 4000
    assert fp < 0.1


def test_stats_status(spark):
    prm = B.BloomParams(100, .1)
    df = spark.range(150).select(F.col("id").cast("string").alias("u"))
    st = B.bloom_stats(df, "u", prm).first()
    assert st.n == 150 and st.status == 4 and st.capacity == 100
    ok = B.bloom_stats(df.limit(10), "u", prm).first()
    assert ok.status == 0


def test_strict_bounds_raise(spark):
    from pyspark.errors import PySparkException
    prm = B.BloomParams(100, .1)
    df = spark.range(150).select(F.col("id").cast("string").alias("u"))
    with pytest.raises(PySparkException):
        B.check_bounds(df, "u", prm).collect()
    assert B.check_bounds(df.limit(50), "u", prm).first().status == 0


def test_jvm_hash_mode(spark):
    prm = B.BloomParams(2000, .05, hash="xxhash64")
    members = spark.range(1500).select(F.concat(F.lit("http://m/"), F.col("id").cast("string")).alias("u"))
    others = spark.range(4000).select(F.concat(F.lit("http://o/"), F.col("id").cast("string")).alias("u"))
    bloom = B.bloom_build(members, "u", prm)
    plan = bloom._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert B.bloom_contains(bloom, members, "u", prm).filter(~F.col("in_bloom")).count() == 0
    assert B.bloom_contains(bloom, others, "u", prm).filter("in_bloom").count() / 4000 < 0.1
    nul = spark.createDataFrame([("a\x00b",)], "u string")
    assert B.with_bloom_indexes(nul, "u", prm, "x").first().x is None


def test_overfull_build_and_nul_fail(spark):
    params = B.BloomParams(100, 0.01)
    ids = spark.range(1000).select(F.col("id").cast("string").alias("u"))
    with pytest.raises(Exception, match="code 4"):
        B.bloom_build(ids, "u", params).collect()
    nul = spark.createDataFrame([("a",), ("b\x00",)], "u string")
    with pytest.raises(Exception, match="NUL"):
        B.bloom_build(nul, "u", params).collect()
    few = ids.limit(50)
    got = {r.u: r for r in B.two_tier_known(nul, "u", B.bloom_build(few, "u", params), nul, params).collect()}
    assert got["b\x00"].in_bloom is None and got["b\x00"].known and set(got) == {"a", "b\x00"}
