"""The durable priority queue: successive takes are the sorted frontier."""

import random

import pytest

from linkloom.operators.priority_queue import ORDER, PriorityQueue
from linkloom.session import scratch_path

SCHEMA = "fetch_priority int, seq long, url string, domain string"


def _rows(rng, n, priorities):
    return [(rng.choice(priorities), rng.randrange(50), f"http://h/{rng.randrange(30)}", "h") for _ in range(n)]


def _tuples(df):
    return sorted(tuple(r[c] for c in ORDER) for r in df.collect())


def test_takes_are_the_sorted_frontier(spark):
    rng, path = random.Random(6), scratch_path(spark, "queue")
    first, second = _rows(rng, 400, (2, 3, 3, 4)), _rows(rng, 200, (1, 3))
    second += second[:20]                               # rows that are equal throughout
    queue = PriorityQueue(spark, path, segment_rows=50)
    assert queue.put(0, spark.createDataFrame(first, SCHEMA)) and not queue.put(0, spark.createDataFrame(first, SCHEMA))
    left, got = sorted(first), []
    for i, n in enumerate((7, 60, 1)):
        queue = PriorityQueue(spark, path, segment_rows=50)      # opened anew
        near = queue.next_segments(n)
        assert sum(s["left"] for s in near) < len(queue) or n > len(queue) - 50
        assert _tuples(queue.take(n, i)) == left[:n] == _tuples(queue.take(n, i))     # the second is a replay
        left = left[n:]
    assert len(queue) == len(left)
    with pytest.raises(ValueError):
        queue.take(1, 0)
    queue.put(1, spark.createDataFrame(second, SCHEMA))          # higher priorities come first
    left = sorted(left + second)
    for i, n in enumerate((30, 250, 200, 500), start=3):
        got = _tuples(queue.take(n, i))
        assert got == left[:n]
        left = left[n:]
        queue.drop_versions()
    assert not left and len(queue) == 0 and queue.take(5, 99).count() == 0


def test_a_take_sorts_no_more_than_it_reads(spark):
    queue = PriorityQueue(spark, scratch_path(spark, "queue"), segment_rows=100)
    queue.put(0, spark.range(2000).selectExpr("cast(id % 4 as int) fetch_priority", "id seq", "'u' url", "'d' domain"))
    near = queue.next_segments(50)
    assert len(near) <= 3
    plan = queue._beyond(near).orderBy(*ORDER).limit(50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_empty_put(spark):
    queue = PriorityQueue(spark, scratch_path(spark, "queue"))
    assert queue.put(0, spark.createDataFrame([], SCHEMA)) and len(queue) == 0 and queue.take(3, 0).count() == 0
