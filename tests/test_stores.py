"""The levelled seen store and the exactly-once fan-out."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators.levelled import LevelledStore
from linkloom.session import scratch_path
from linkloom.streaming.fanout import CommitLog, fan_out_batches, to_folder

PAIRS = "domain string, url string"


def _files(spark, folders):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names = []
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        names += [s.getPath().getName() for s in place.getFileSystem(conf).listStatus(place)]
    return [n for n in names if n.startswith("part-")]


def test_fifty_batches_stay_within_buckets_times_levels(spark):
    rng, path, buckets = random.Random(2), scratch_path(spark, "levelled"), 4
    model, store = {}, LevelledStore(spark, path, buckets=buckets)
    for batch in range(50):
        pairs = [("hot" if rng.random() < .4 else f"d{rng.randrange(9)}", f"u{rng.randrange(300)}") for _ in range(12)]
        new = {p for p in pairs if p not in model}
        df = spark.createDataFrame([*pairs, (None, "u"), ("d", None)], PAIRS)
        if batch % 5:
            assert store.append(batch, spark.createDataFrame(sorted(new), PAIRS))
        else:
            assert {tuple(r) for r in store.add(batch, df).collect()} == new
        if batch % 20 == 15:         # a replay, by a store opened anew
            store = LevelledStore(spark, path, buckets=buckets)
            assert {tuple(r) for r in store.add(batch, df).collect()} == new and not store.append(batch, df)
        model |= dict.fromkeys(new, batch)
    runs = store.runs()
    assert len(runs) <= 6 and len(_files(spark, runs.values())) <= buckets * len(runs)
    assert {(r.domain, r.url): r.batch_id for r in store.read().collect()} == model
    assert {(r.domain, r.url) for r in store.read(before=20).collect()} == {p for p, b in model.items() if b < 20}
    old = store.manifest.versions()[10]
    assert store.read(version=old).count() == sum(b < 10 for b in model.values())
    some = spark.createDataFrame([("hot", "u1")], PAIRS)
    near = store.read(touching=some)
    assert near.count() < len(model) and near.where("domain = 'hot' and url = 'u1'").count() == (("hot", "u1") in model)
    store.compact()
    assert len(store.runs()) == 1 and store.read().count() == len(model)
    assert store.drop_versions() > 0 and store.manifest.versions()[:-1] == []
    assert {(r.domain, r.url): r.batch_id for r in store.read().collect()} == model


def test_a_failed_write_leaves_the_last_version(spark):
    store = LevelledStore(spark, scratch_path(spark, "levelled"), buckets=2)
    store.add(0, spark.createDataFrame([("a", "1")], PAIRS))
    bad = spark.createDataFrame([("b", "2")], PAIRS).select(F.raise_error(F.lit("lost")).cast("string").alias("domain"), "url")
    with pytest.raises(Exception, match="lost"):
        store.append(1, bad)
    assert not store.has(1) and [tuple(r) for r in store.read().collect()] == [("a", "1", 0)]
    assert store.append(1, spark.createDataFrame([("b", "2")], PAIRS)) and store.read().count() == 2


def test_add_status_by_row(spark):
    store = LevelledStore(spark, scratch_path(spark, "levelled"), buckets=2)
    store.add(0, spark.createDataFrame([("d", "u5")], PAIRS))
    rows = spark.createDataFrame([(i, "d", f"u{i % 7}") for i in range(12)], "seq long, " + PAIRS)
    for _ in range(2):              # the second is a replay
        got = {r.seq: r.inserted for r in store.add_status(1, rows).collect()}
        assert [i for i, new in sorted(got.items()) if new] == [0, 1, 2, 3, 4, 6]
    with pytest.raises(ValueError):
        LevelledStore(spark, store.manifest.path, keys=("domain",))


def test_empty_batches(spark):
    store = LevelledStore(spark, scratch_path(spark, "levelled"), buckets=2)
    nothing = spark.createDataFrame([], PAIRS)
    assert store.read().count() == 0 and store.add(0, nothing).count() == 0 and store.has(0)
    assert store.add(1, spark.createDataFrame([("a", "1")] * 3, PAIRS)).count() == 1


def _stream(spark, path, run, checkpoint):
    q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path).writeStream \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
    q.awaitTermination()


def test_a_failure_between_sinks_repeats_only_the_other(spark):
    source, out = scratch_path(spark, "fan-source"), scratch_path(spark, "fan-out")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(source)
    calls, fail = [], {"left": 1}
    write = {name: to_folder(f"{out}/{name}") for name in ("first", "second")}

    def sink(name):
        def run(df, batch_id):
            calls.append((name, batch_id))
            if name == "second" and batch_id == 1 and fail["left"]:
                fail["left"] -= 1
                write[name](df.limit(3), batch_id)      # a part is written, then the sink dies
                raise RuntimeError("lost between the sinks")
            write[name](df, batch_id)
        return run

    run = fan_out_batches(f"{out}/log", {"first": sink("first"), "second": sink("second")})
    with pytest.raises(Exception, match="lost between the sinks"):
        _stream(spark, source, run, f"{out}/ckpt")
    assert CommitLog(spark, f"{out}/log").done("first", 1) and not CommitLog(spark, f"{out}/log").done("second", 1)
    _stream(spark, source, run, f"{out}/ckpt")
    for name in ("first", "second"):
        assert sorted(r.id for r in spark.read.parquet(f"{out}/{name}").collect()) == list(range(30))
    assert sorted(calls) == sorted([("first", 0), ("first", 1), ("first", 2), ("second", 0), ("second", 1),
                                    ("second", 1), ("second", 2)])
    run(spark.range(5), 1)          # a batch that every sink has taken is passed over
    assert spark.read.parquet(f"{out}/first").count() == 30
