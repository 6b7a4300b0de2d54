"""Seen set: exists, bulk exists, bulk add status, single add, deny list."""

import pytest
from pyspark.errors import PySparkException

from linkloom.operators import seen as S

SCHEMA = "domain string, url string"


def test_exists_and_bulk(spark):
    seen = spark.createDataFrame([(str(i), str(i + 10)) for i in range(10, 20)], SCHEMA)
    probes = spark.createDataFrame([(str(i), str(i + 10)) for i in range(30, 40)], SCHEMA)
    flags = S.exists_flag(probes, seen, "both").collect()
    assert not any(r.known for r in flags)
    hit = S.exists_flag(spark.createDataFrame([("10", "20"), ("10", "x")], SCHEMA), seen, "both")
    assert sorted((r.url, r.known) for r in hit.collect()) == [("20", True), ("x", False)]
    by_dom = S.exists_flag(spark.createDataFrame([("10", "x")], SCHEMA), seen, "domain").first()
    assert by_dom.known
    assert S.exists_bulk(seen, probes).count() == 0
    assert S.exists_bulk(seen, seen).count() == 10
    with pytest.raises(ValueError):
        S.exists_flag(probes, seen, "neither")


def test_bulk_exists_needs_both_parts(spark):
    seen = spark.createDataFrame([("a", "b")], SCHEMA)
    with pytest.raises(PySparkException):
        S.exists_bulk(seen, spark.createDataFrame([("a", None)], SCHEMA)).collect()


def test_add_bulk_status(spark):
    seen = spark.createDataFrame([("d", "u5")], SCHEMA)
    pairs = spark.createDataFrame([(i, "d", f"u{i}") for i in range(10)] + [(10, "d", "u1")],
                                  "seq long, domain string, url string")
    st = {r.seq: r.inserted for r in S.add_bulk_status(seen, pairs).collect()}
    assert sorted(k for k, v in st.items() if not v) == [5, 10]
    assert S.new_pairs(seen, pairs).count() == 9


def test_add_single_duplicate_fails(spark):
    seen = spark.createDataFrame([("d", "u")], SCHEMA)
    with pytest.raises(PySparkException):
        S.add_single(seen, spark.createDataFrame([("d", "u")], SCHEMA)).collect()
    assert S.add_single(seen, spark.createDataFrame([("d", "v")], SCHEMA)).count() == 1


def test_deny_filter_forms(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], SCHEMA)
    assert df.transform(lambda d: S.deny_filter(d, ["a"])).count() == 2
    deny = spark.createDataFrame([("b",)], "domain string")
    assert {r.url for r in S.deny_filter(df, deny).collect()} == {"1", "3"}
    assert S.parse_deny_list(",a,,b,") == ["a", "b"]
