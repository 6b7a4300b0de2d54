"""Fan-out of a stream to several sinks, each batch once per sink.

``fan_out_batches`` is a ``foreachBatch`` function.  A micro-batch is written once to a
staging table, and every sink gets that copy.  When a sink has taken a batch, a commit
record ``commits/<sink>/<batch>`` is written.  If a later sink (or the driver) fails, Spark
replays the batch: the staged rows are the same, sinks with a commit record are passed
over, and only the others run again.  A sink may have written a part before it failed, so
sinks write a batch by overwriting the batch's own folder (``to_folder``): what a replay
writes takes the place of the part.  Rows therefore appear once in every sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Sink = Callable[[DataFrame, int], None]


class CommitLog:
    """Which sink has taken which batch: empty marker files under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def done(self, sink: str, batch_id: int) -> bool:
        files, place = self._place(f"commits/{sink}/{batch_id}")
        return files.exists(place)

    def commit(self, sink: str, batch_id: int) -> None:
        files, place = self._place(f"commits/{sink}/{batch_id}")
        files.create(place, True).close()

    def staged(self, batch_id: int) -> str:
        return f"{self.path}/staged/{batch_id}"

    def is_staged(self, batch_id: int) -> bool:
        files, place = self._place(f"staged/{batch_id}/_SUCCESS")
        return files.exists(place)

    def unstage(self, batch_id: int) -> None:
        files, place = self._place(f"staged/{batch_id}")
        files.delete(place, True)


def to_folder(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet") -> Sink:
    """A sink that writes ``shape(batch)`` to the batch's own folder of ``path``."""
    def write(df: DataFrame, batch_id: int) -> None:
        shape(df).write.mode("overwrite").format(form).save(f"{path}/batch_id={int(batch_id)}")
    return write


def fan_out_batches(path: str, sinks: dict[str, Sink]) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function that feeds every sink of ``sinks`` each batch once; staging and
    commit records live under ``path``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, path)
        todo = [name for name in sinks if not log.done(name, batch_id)]
        if not todo:
            return
        if not log.is_staged(batch_id):
            batch.write.mode("overwrite").parquet(log.staged(batch_id))
        rows = spark.read.schema(batch.schema).parquet(log.staged(batch_id))
        for name in todo:
            sinks[name](rows, batch_id)
            log.commit(name, batch_id)
        log.unstage(batch_id)
    return run
