"""Levelled store of keys met (S6, J4): the seen set as sorted runs.

A batch's rows are a run.  A level holds at most one run; a batch that finds level 0 taken
is merged with the runs of levels 0, 1, .. up to the first free level, in one
job, and becomes that level's run.  So after n batches there are at most log2(n) + 1
runs, each row was rewritten that often at most, and a reader lists at most ``buckets``
files a run.

A run is dealt over ``buckets`` tasks by the hash of its whole key, one file a task, sorted by
(bucket, key).  One domain may hold a third of all pairs: the pairs are
spread by (domain, url), and domains have a store of their own (``keys=("domain",)``).
Row groups carry the least and largest bucket, so a filter on ``bucket`` skips them.

Every row keeps its ``batch_id``.  A batch that is in the store is not written again
(a replay), its rows can still be told from the others, and ``read(before=n)`` is the store
as batch n found it.  Versions are committed through a manifest: a job that fails
leaves the last version, and old versions can be read until they are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.manifest import Manifest


class LevelledStore:
    """The store at ``path``, opened if it is there, else made (with as many buckets as the
    session has shuffle partitions, if no other number is given)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("domain", "url"),
                 buckets: int | None = None):
        self.spark, self.manifest = spark, Manifest(spark, path)
        state = self.manifest.read()
        if state is None:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            state = {"keys": list(keys), "buckets": buckets, "levels": {}, "last_batch": None}
            self.manifest.commit(state)
        self.keys, self.buckets = state["keys"], state["buckets"]
        if self.keys != list(keys):
            raise ValueError(f"the store at {path} has the keys {self.keys}")
        self.schema = ", ".join([*(f"{k} string" for k in self.keys), "batch_id long", "bucket int"])

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ---- reading

    def runs(self, version: int | None = None) -> dict[int, str]:
        """Folder of each level's run."""
        return {int(k): v for k, v in self.manifest.read(version)["levels"].items()}

    def _rows(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*runs)

    def read(self, before: int | None = None, touching: DataFrame | None = None,
             version: int | None = None) -> DataFrame:
        """Keys and batch_id: of all batches, or of those before batch ``before``; only the
        buckets that ``touching``'s keys fall in (at most ``buckets`` numbers
        reach the driver)."""
        rows = self._rows(list(self.runs(version).values()))
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        if touching is not None:
            asked = [r.b for r in touching.select(self.bucket().alias("b")).distinct().collect()]
            if len(asked) < self.buckets:
                rows = rows.where(F.col("bucket").isin(asked))
        return rows.select(*self.keys, "batch_id")

    # ---- writing

    def has(self, batch_id: int) -> bool:
        last = self.manifest.read()["last_batch"]
        return last is not None and batch_id <= last

    def append(self, batch_id: int, rows: DataFrame) -> bool:
        """Add distinct new keys as batch ``batch_id``; False (and nothing is written) if the
        store has that batch.  Batches come in rising order."""
        state = self.manifest.read()
        if state["last_batch"] is not None and batch_id <= state["last_batch"]:
            return False
        levels = {int(k): v for k, v in state["levels"].items()}
        free = next(n for n in range(len(levels) + 1) if n not in levels)
        run = rows.select(*self.keys, F.lit(batch_id).cast("long").alias("batch_id"), self.bucket().alias("bucket"))
        if free:
            run = run.unionByName(self._rows([levels.pop(n) for n in range(free)]))
        levels[free] = self._write(run)
        self.manifest.commit(state | {"levels": levels, "last_batch": batch_id})
        return True

    def _write(self, run: DataFrame) -> str:
        folder = self.manifest.folder("run")
        run.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys).write.parquet(folder)
        return folder

    def compact(self) -> None:
        """Merge all levels into one run."""
        state = self.manifest.read()
        if len(state["levels"]) > 1:
            top = max(map(int, state["levels"]))
            self.manifest.commit(state | {"levels": {top: self._write(self._rows(list(state["levels"].values())))}})

    def drop_versions(self, keep: int = 1) -> int:
        """Drop all but the last ``keep`` versions and the runs that only they name."""
        return self.manifest.drop(keep, lambda state: list(state["levels"].values()))

    # ---- the seen set's operations

    def add(self, batch_id: int, rows: DataFrame) -> DataFrame:
        """J4 as a set: append the keys of ``rows`` that the store lacks; returns them.  A replay
        returns what the batch added the first time."""
        if not self.has(batch_id):
            keys = rows.select(*self.keys).dropna().distinct()
            self.append(batch_id, keys.join(self.read(before=batch_id, touching=keys), self.keys, "left_anti"))
        return self.read().where(F.col("batch_id") == batch_id).select(*self.keys)

    def add_status(self, batch_id: int, rows: DataFrame, seq: str = "seq") -> DataFrame:
        """J4 by row: ``rows`` with ``inserted``, true for the first row (in ``seq`` order) of each
        key that the batch adds.  The rows left equal by ``seq`` are all marked."""
        added = self.add(batch_id, rows)
        first = rows.groupBy(*self.keys).agg(F.min(seq).alias(seq)).join(added, self.keys, "left_semi")
        # The order is part of the join key, so the rows of a hot key are spread.
        return rows.join(first.withColumn("_new", F.lit(True)), [*self.keys, seq], "left").select(
            *rows.columns, F.coalesce("_new", F.lit(False)).alias("inserted"))
