"""Durable priority queue of URLs to fetch.

``put`` sorts a batch once, by ranges of the fetch order, into segments (files) of about
``segment_rows`` rows, and notes each segment's first and last key and row count in a manifest.
``take(n)`` looks at the manifest first: the segments that can hold the next n rows are those
that begin at or before the key up to which n rows lie for certain.  It reads these, past
their read pointers, and keeps the n least rows (a top-k, no sort of the queue).  Rows put later with
a higher priority come first, as in a heap: each segment has its own pointer.

The order is (fetch_priority, seq, url, domain), then put and position, so equal rows are
apart.  A batch that was put is not put again, and the last take is given again
under its id: both survive a replay.  Versions are committed through a manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.manifest import Manifest

ORDER = ["fetch_priority", "seq", "url", "domain"]
KEY = [*ORDER, "put", "nth"]
_KINDS = dict(zip(KEY, ("int", "long", "string", "string", "long", "long")))
SCHEMA = ", ".join(f"{c} {_KINDS[c]}" for c in KEY)


def _key() -> Column:
    return F.struct(*KEY)


def _literal(key: list) -> Column:
    return F.struct(*(F.lit(v).cast(_KINDS[c]).alias(c) for c, v in zip(KEY, key)))


class PriorityQueue:
    """The queue stored at ``path``, opened if it is there, else made."""

    def __init__(self, spark: SparkSession, path: str, segment_rows: int = 1_000_000):
        self.spark, self.manifest, self.segment_rows = spark, Manifest(spark, path), segment_rows
        if self.manifest.read() is None:
            self.manifest.commit({"segments": [], "last_put": None, "taken": None})

    def __len__(self) -> int:
        return sum(s["left"] for s in self.manifest.read()["segments"])

    def put(self, put_id: int, rows: DataFrame) -> bool:
        """Add rows (fetch_priority, seq, url, domain); False if put ``put_id`` is in the queue.
        Puts come in rising order."""
        state = self.manifest.read()
        if state["last_put"] is not None and put_id <= state["last_put"]:
            return False
        staged, folder = self.manifest.folder("staged"), self.manifest.folder("put")
        rows.select(*(F.col(c).cast(_KINDS[c]).alias(c) for c in ORDER)).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        n = held.count()
        if n:
            (held.repartitionByRange(-(-n // self.segment_rows), *ORDER).sortWithinPartitions(*ORDER)
             .select(*ORDER, F.lit(put_id).cast("long").alias("put"), F.monotonically_increasing_id().alias("nth"))
             .write.parquet(folder))
            state["segments"] += [{"file": r.file, "first": list(r.first), "last": list(r.last), "after": None,
                                   "left": r.left} for r in self._measured(self._read([folder]))]
        self.manifest.commit(state | {"last_put": put_id})
        self.manifest.discard(staged)
        return True

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def _measured(self, rows: DataFrame) -> list:
        """First and last key and number of rows of each file: as many rows as segments."""
        return rows.select(F.col("_metadata.file_path").alias("file"), _key().alias("key")).groupBy("file").agg(
            F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("left")).collect()

    def _beyond(self, segments: list[dict]) -> DataFrame:
        """The rows of the segments past their pointers."""
        pointers: dict[tuple | None, list[str]] = {}
        for s in segments:
            pointers.setdefault(None if s["after"] is None else tuple(s["after"]), []).append(s["file"])
        out = None
        for after, files in pointers.items():
            rows = self._read(files)
            if after is not None:       # the first comparison lets the scan skip row groups
                rows = rows.where((F.col("fetch_priority") >= after[0]) & (_key() > _literal(list(after))))
            out = rows if out is None else out.unionAll(rows)
        return out

    def next_segments(self, n: int) -> list[dict]:
        """The segments that hold the next ``n`` rows (from the manifest alone)."""
        segments = self.manifest.read()["segments"]
        sure, bound = 0, None
        for s in sorted(segments, key=lambda s: s["last"]):
            sure, bound = sure + s["left"], s["last"]
            if sure >= n:
                break
        return [s for s in segments if s["first"] <= bound] if bound is not None else []

    def take(self, n: int, take_id: int) -> DataFrame:
        """The next ``n`` rows (fewer when the queue runs out) leave the queue.  The last take is
        returned again under its id; its rows are stored until a later take is made and old
        versions are dropped."""
        state = self.manifest.read()
        if state["taken"] is not None and take_id <= state["taken"]["id"]:
            if take_id < state["taken"]["id"]:
                raise ValueError(f"take {take_id} is over: the last one is {state['taken']['id']}")
            return self._read([state["taken"]["folder"]]).select(*ORDER)
        chosen, folder = self.next_segments(n), self.manifest.folder("take")
        rows = self._beyond(chosen) if chosen else self.spark.createDataFrame([], SCHEMA)
        rows.orderBy(*KEY).limit(n).write.parquet(folder)
        last = self._read([folder]).agg(F.max(_key())).first()[0]
        if last is not None:
            moved = [s | {"after": list(last)} for s in chosen if s["first"] <= list(last)]
            left = {r.file: r.left for r in self._measured(self._beyond(moved))}
            kept = {s["file"]: s for s in state["segments"]}
            for s in moved:
                if s["file"] in left:
                    kept[s["file"]] = s | {"left": left[s["file"]]}
                else:
                    del kept[s["file"]]
            state["segments"] = list(kept.values())
        self.manifest.commit(state | {"taken": {"id": take_id, "folder": folder}})
        return self._read([folder]).select(*ORDER)

    def drop_versions(self, keep: int = 1) -> int:
        """Drop old versions and the folders that only they name."""
        def named(state: dict) -> list[str]:
            folders = [s["file"].rsplit("/", 1)[0] for s in state["segments"]]
            return folders + ([state["taken"]["folder"]] if state["taken"] else [])
        return self.manifest.drop(keep, named)
