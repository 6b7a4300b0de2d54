"""Blocked, layered and stored Bloom filters."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import bloom_layers as L
from linkloom.operators.manifest import Manifest
from linkloom.session import scratch_path

KINDS = ["xxhash64", "md5"]


def _urls(spark, a, b, host="m"):
    return spark.range(a, b).select(F.concat(F.lit(f"http://{host}/"), F.col("id").cast("string")).alias("u"))


@pytest.mark.parametrize("kind", KINDS)
def test_blocked_has_no_false_negatives_and_holds_its_rate(spark, kind):
    params = L.BlockParams(3000, 0.02, kind)
    bloom = L.blocked_build(_urls(spark, 0, 3000).union(_urls(spark, 0, 500)), "u", params)
    assert bloom.count() <= params.blocks
    assert L.blocked_contains(bloom, _urls(spark, 0, 3000), "u", params).where("not in_bloom").count() == 0
    wrong = L.blocked_contains(bloom, _urls(spark, 0, 40_000, "o"), "u", params).where("in_bloom").count()
    assert 0 < wrong <= 1.25 * 0.02 * 40_000
    assert params.rate(3000) <= 0.02 < params.rate(3000, int(params.blocks * 0.99))


def test_blocked_bits_lie_in_one_block(spark):
    params = L.BlockParams(100, 0.001)
    rows = L.with_masks(_urls(spark, 0, 50), "u", params.k, params.hash).collect()
    bits = [sum(bin(r[f"m_{w}"] & (1 << 64) - 1).count("1") for w in L.WORDS) for r in rows]
    assert max(bits) == params.k == 10 and min(bits) >= 8      # two of a key's bits may fall together


def test_blocked_probe_is_one_row_a_key(spark):
    params = L.BlockParams(1000, 0.01)
    plan = L.blocked_contains(L.blocked_build(_urls(spark, 0, 9), "u", params), _urls(spark, 0, 9), "u", params) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan


def test_two_tiers_refute_false_positives(spark):
    params = L.BlockParams(400, 0.2)
    stored = _urls(spark, 0, 400)
    probes = _urls(spark, 300, 400).union(_urls(spark, 0, 2000, "o")).union(spark.createDataFrame([(None,)], "u string"))
    rows = L.confirmed(L.blocked_contains(L.blocked_build(stored, "u", params), probes, "u", params), "u", stored).collect()
    assert len(rows) == 2100 and {r.u for r in rows if r.known} == {f"http://m/{i}" for i in range(300, 400)}
    assert sum(r.in_bloom and not r.known for r in rows) > 100


def test_layers_close_with_both_codes():
    plan = L.LayerPlan(10, 0.99, ratio=0.1)        # the first layer's rate passes p before it is full
    rows = L.layer_counts(plan, [6, 20, 5])
    assert [(r["capacity"], r["status"]) for r in rows[:2]] == [(6, 5), (20, 4)] and rows[2]["status"] == 0
    plan = L.LayerPlan(60, 0.01)
    rows = L.layer_counts(plan, [60, 120, 1])
    assert [r["status"] for r in rows] == [4, 4, 0] and sum(r["p"] for r in rows) < 0.01
    assert plan.fill([60], 0) == [] and sum(n for _, n in plan.fill([10], 500)) == 500
    assert plan.fill([60, 100], 30) == [(1, 20), (2, 10)]


def test_hash_cut(spark):
    h = spark.range(2000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h")).union(
        spark.createDataFrame([(7,)] * 5, "h long"))
    values = sorted(r.h for r in h.collect())
    for n in (0, 3, 5, 6, 700, 2004, 2005):
        cut = L.hash_cut(h, n)
        assert sum(v < cut for v in values) == max(k for k in range(n + 1) if k == 0 or k == len(values)
                                                   or values[k] != values[k - 1])


def test_stored_filter_equals_its_rebuild(spark):
    path, plan = scratch_path(spark, "layers"), L.LayerPlan(100, 0.05)
    sizes = [(0, 30), (30, 60), (60, 900), (900, 900), (900, 1000), (1000, 1010)]
    store = L.LayeredBloom(spark, path, plan)
    for i, (a, b) in enumerate(sizes):
        store = L.LayeredBloom(spark, path)              # reopened for every batch
        assert store.add(i, _urls(spark, a, b).repartition(1 + i % 3), "u")
        assert not store.add(i, _urls(spark, a, b), "u")  # a replay
    assert sum(store.counts) == 1010 and len(store.counts) >= 4
    assert all(n <= plan.bounds(i).capacity() for i, n in enumerate(store.counts))
    history = spark.createDataFrame([(i, *ab) for i, ab in enumerate(sizes)], "batch long, a long, b long") \
        .where("a < b") \
        .select("batch", F.explode(F.sequence("a", F.col("b") - 1)).alias("id")) \
        .select("batch", F.concat(F.lit("http://m/"), F.col("id").cast("string")).alias("u"))
    stored, rebuilt = (sorted(map(tuple, df.select("layer", "block", *L.WORDS).collect()))
                       for df in (store.words(), store.rebuilt(history, "u")))
    assert stored == rebuilt
    store.compact()
    assert sorted(map(tuple, store.words().collect())) == stored and len(store.manifest.read()["parts"]) == 1
    assert store.contains(_urls(spark, 0, 1010), "u").where("not in_bloom").count() == 0
    wrong = store.contains(_urls(spark, 0, 20_000, "o"), "u").where("in_bloom").count()
    assert 0 < wrong <= 0.05 * 20_000
    known = store.known(_urls(spark, 900, 1200), "u", _urls(spark, 0, 1010)).where("known").count()
    assert known == 110
    assert store.drop_versions() > 0 and store.contains(_urls(spark, 5, 6), "u").first().in_bloom


def test_old_versions_stay_readable(spark):
    m = Manifest(spark, scratch_path(spark, "manifest"))
    assert m.read() is None
    assert [m.commit({"n": n}) for n in range(3)] == [0, 1, 2]
    assert m.read()["n"] == 2 and m.read(0)["n"] == 0
    m.drop(1, lambda state: [])
    assert m.versions() == [2]


def test_opening_with_another_plan_fails(spark):
    path = scratch_path(spark, "layers")
    L.LayeredBloom(spark, path, L.LayerPlan(100, 0.05))
    with pytest.raises(ValueError):
        L.LayeredBloom(spark, path, L.LayerPlan(200, 0.05))
    with pytest.raises(ValueError):
        L.LayeredBloom(spark, path + "-none")
