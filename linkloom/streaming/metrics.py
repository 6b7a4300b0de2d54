"""Job metrics of streams (L5, T1): observed counters, one record a micro-batch.

``observed`` adds counters to a stream of analysed pages; they are gathered by the same job.
``MetricsListener`` writes what each micro-batch observed as one small file named after the
query and the batch, so a replayed batch overwrites its own record; ``read_metrics`` gives the
records as a table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

_SCHEMA = ("query string, query_id string, batch_id long, input_rows long, metric string, "
           "counters map<string, long>")


def observed(analyzed: DataFrame, name: str = "links") -> DataFrame:
    """Count pages, accepted and rejected pages, and the links of accepted pages."""
    fine = F.col("error").isNull()
    return analyzed.observe(
        name, F.count(F.lit(1)).alias("pages"), F.count(F.when(fine, 1)).alias("accepted"),
        F.count(F.when(~fine, 1)).alias("rejected"),
        F.coalesce(F.sum(F.when(fine, F.col("n_links"))), F.lit(0)).cast("long").alias("links"))


class MetricsListener(StreamingQueryListener):
    """Writes the observed counters of the queries called ``query`` (all queries if None) to ``path``."""

    def __init__(self, spark: SparkSession, path: str, query: str | None = None):
        self._spark, self._path, self._query = spark, path.rstrip("/"), query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self._query is not None and p.name != self._query:
            return
        for metric, row in p.observedMetrics.items():
            self._write(f"{p.id}-{p.batchId}-{metric}", {
                "query": p.name, "query_id": str(p.id), "batch_id": p.batchId, "input_rows": p.numInputRows,
                "metric": metric, "counters": {k: int(v) for k, v in row.asDict().items() if v is not None}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _write(self, name: str, record: dict) -> None:
        sc = self._spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}.json")
        out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_id, batch_id, input_rows, metric, counters) of every record."""
    return spark.read.schema(_SCHEMA).json(path)


def run_with_metrics(spark: SparkSession, path: str, name: str, run) -> DataFrame:
    """Run ``run()`` (which starts query ``name`` and waits for it) under a listener and return
    the metrics table, when every event of the run has been written."""
    listener = MetricsListener(spark, path, name)
    spark.streams.addListener(listener)
    try:
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return read_metrics(spark, path)
