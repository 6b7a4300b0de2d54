"""Structured Streaming jobs.

The same DataFrame functions as batch run on streams:

* T1 ``analyzed_stream``: file stream of stored pages -> ``analyze_pages``
  (stateless map).
* T2 ``frontier_batches``: ``foreachBatch`` that runs the batch frontier step
  against the seen table, then writes the batch's published URLs and new
  seen pairs under ``batch_id=N`` with overwrite -- a replayed batch rewrites
  the same folders, and batch N reads only ``batch_id < N`` of the seen table.
  This is the scalable form of the reference's stateful filter: the state is
  a table, not executor memory.
* T3 ``dedupe_stream``: ``dropDuplicates`` on (domain, url) -- state keyed
  and partitioned by pair.
* T4 ``domain_priority_batches``: every new URL of the stream with priority 2
  (first of its domain) or 3, against the domains and pairs stored by earlier
  micro-batches; ``domain_first_stream`` is the keyed-state form of its
  priority-2 rows (one boolean per domain, ``applyInPandasWithState``), each
  partition's rows reduced to one per domain before they are shuffled.
* T5 ``edges_stream``: analysed pages -> domain edges -> parquet sink.
* T6 ``map_messages``: the user hook -- a class with ``on_start``,
  ``on_batch`` or ``on_message`` (0..n records) and ``on_stop`` run per
  partition through ``mapInPandas``, batch or stream alike.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators import analyze as A
from linkloom.operators import frontier as FR
from linkloom.operators import graph as G
from linkloom.operators.levelled import LevelledStore
from linkloom.session import checkpoint_dir, reliable_checkpoint, scratch_path

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType())])


def pages_stream(spark: SparkSession, folder: str, glob: str = "pages*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """File-source stream of stored pages (parquet files in ``folder``)."""
    r = spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def analyzed_stream(spark: SparkSession, folder: str, *args, **kw) -> DataFrame:
    """Continuous link extraction and resolution."""
    return A.analyze_pages(pages_stream(spark, folder, *args, **kw))


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keyed streaming state (dedupe, per-domain state) in RocksDB: state is
    partitioned by key across executors and spills to local disk instead of
    living on the JVM heap; it is checkpointed with the query.  Only set when
    the session has not chosen a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or cur.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 foreach_batch: Callable | None = None) -> str:
    """Run a stream until its input is consumed (availableNow) into a parquet
    folder under the shared checkpoint folder; returns that folder."""
    spark = stream.sparkSession
    use_rocksdb_state(spark)
    out = scratch_path(spark, name)
    w = stream.writeStream.option("checkpointLocation", out + "-ckpt").trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").outputMode(mode).option("path", out).start()
    q.awaitTermination()
    return out


# The seen table is partitioned by a hash bucket of the domain, so a
# micro-batch reads only the buckets its candidates fall in.
DOMAIN_BUCKETS = 1024
FILES_PER_BUCKET = 4


def domain_bucket(domain_col):
    return F.pmod(F.xxhash64(domain_col), F.lit(DOMAIN_BUCKETS)).cast("int")


def write_seen_batch(pairs: DataFrame, seen_path: str, batch_id: int) -> None:
    """Write (domain, url) pairs as batch ``batch_id`` of the seen table
    (overwrite: a replayed batch rewrites the same folder)."""
    # Rows of one bucket go to at most FILES_PER_BUCKET tasks, so a batch never
    # writes tasks x buckets files, and a hot domain is not one task.
    pairs.select("domain", "url", domain_bucket(F.col("domain")).alias("dbucket")) \
        .repartition(F.col("dbucket"), F.pmod(F.xxhash64("url"), F.lit(FILES_PER_BUCKET))).write.mode("overwrite").partitionBy("dbucket") \
        .parquet(f"{seen_path}/batch_id={int(batch_id)}")


def frontier_batches(seen_path: str, out_path: str, deny=None, override=None,
                     recrawl=None) -> Callable:
    """The foreachBatch function for a stream of analysed pages.
    ``override``/``recrawl`` are conditions on a page's columns whose links
    are fetched again (see ``frontier.page_candidates``).

    ``seen_path`` holds the seen table partitioned by ``batch_id`` and
    ``dbucket`` (see ``write_seen_batch``; an initial set goes under
    ``batch_id=-1``).  Each batch's candidates are checkpointed once; the
    list of their domain buckets (at most DOMAIN_BUCKETS small integers, a
    fixed bound) becomes a partition filter, so the scan of the seen table
    skips every other bucket folder."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cand = reliable_checkpoint(FR.page_candidates(A.accepted(batch), override, recrawl))
        seen = _read_seen(spark, seen_path, batch_id)
        if "dbucket" in seen.columns:
            ids = [r[0] for r in cand.select(domain_bucket(F.col("domain")).alias("b"))
                   .distinct().collect()]              # <= DOMAIN_BUCKETS ints
            if len(ids) < DOMAIN_BUCKETS:
                seen = seen.filter(F.col("dbucket").isin(ids))
        res = FR.frontier_step(cand, seen.select("domain", "url"), deny=deny)
        saved = reliable_checkpoint(res.published)
        saved.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        write_seen_batch(saved.filter("added"), seen_path, batch_id)
    return run


def stored_frontier_batches(pairs_path: str, domains_path: str, out_path: str, deny=None, override=None,
                            recrawl=None, keep: int = 2) -> Callable:
    """T2 against levelled stores: the foreachBatch function for a stream of analysed
    pages.  The pairs and the domains met are kept in a ``LevelledStore`` each, so the
    files a batch lists grow with the logarithm of the batches, and a batch reads
    the domain store instead of every stored pair.  Both stores answer as they were
    before the batch, so a replay gives the same rows; a batch that only one of them has
    (the driver failed in between) is added to the other.  ``keep`` versions stay."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pairs = LevelledStore(spark, pairs_path)
        domains = LevelledStore(spark, domains_path, keys=("domain",))
        cand = reliable_checkpoint(FR.page_candidates(A.accepted(batch), override, recrawl))
        res = FR.frontier_step(cand, pairs.read(before=batch_id, touching=cand), deny=deny,
                               domains=domains.read(before=batch_id, touching=cand))
        res.published.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        added = spark.read.schema(res.published.schema).parquet(f"{out_path}/batch_id={batch_id}").where("added")
        pairs.append(batch_id, added)
        domains.add(batch_id, added)
        for store in (pairs, domains):
            store.drop_versions(keep)
    return run


def domain_priority_batches(state_path: str, out_path: str) -> Callable:
    """T4: the foreachBatch function that gives every new URL of a stream of
    analysed pages its priority: 2 for the first URL of a domain the stream
    has not met, 3 for the rest.  The state (domains and pairs met) is the
    table at ``state_path``, empty at the start.  A domain's rows are reduced
    by partial aggregates, so a hot domain is no single group."""
    return frontier_batches(state_path, out_path)


def _read_seen(spark: SparkSession, seen_path: str, batch_id: int) -> DataFrame:
    try:
        seen = spark.read.parquet(seen_path)
    except AnalysisException:              # nothing written yet
        return spark.createDataFrame([], "domain string, url string")
    if "batch_id" in seen.columns:
        seen = seen.filter(F.col("batch_id") < batch_id)
    return seen


def dedupe_stream(links: DataFrame) -> DataFrame:
    """Each (domain, url) once across the whole stream."""
    return links.dropDuplicates(["domain", "url"])


_T4_OUT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("url", T.StringType()),
                        T.StructField("domain", T.StringType()),
                        T.StructField("fetch_priority", T.IntegerType())])
_T4_STATE = T.StructType([T.StructField("known", T.BooleanType())])


def _domain_first(key, chunks: Iterator[pd.DataFrame], state: GroupState):
    known = bool(state.get[0]) if state.exists else False
    # Keep only the first row of each chunk: memory stays one row per chunk.
    firsts = [c.sort_values(["seq", "url"]).head(1) for c in chunks if len(c)]
    if not firsts:
        return
    allfirst = pd.concat(firsts).sort_values(["seq", "url"]).head(1)
    state.update((True,))
    if not known:
        out = allfirst[["seq", "url", "domain"]].copy()
        out["fetch_priority"] = 2
        yield out.astype({"fetch_priority": "int32"})


def _one_per_domain(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for c in chunks:
        yield c.sort_values(["seq", "url"]).drop_duplicates("domain")


def domain_first_stream(candidates: DataFrame) -> DataFrame:
    """T4, priority-2 rows only, from keyed state: the first URL of each
    domain not seen before in the stream.  Each batch of rows is reduced to
    one row per domain before the shuffle; ``domain_priority_batches`` gives
    all rows."""
    c = candidates.select("seq", "url", "domain")
    return c.mapInPandas(_one_per_domain, c.schema).groupBy("domain").applyInPandasWithState(
        _domain_first, _T4_OUT, _T4_STATE, "append", GroupStateTimeout.NoTimeout)


def edges_stream(analyzed: DataFrame, observed: int) -> DataFrame:
    """T5: continuous domain graph log."""
    return G.domain_edges(A.accepted(analyzed), observed)


class MessageHook:
    """Override ``on_batch`` (a pandas frame of messages in, a frame of
    records out) or, for code that handles one message at a time,
    ``on_message`` (returns a list of dict records)."""

    def on_start(self) -> None:
        pass

    def on_batch(self, messages: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([r for m in messages.to_dict("records") for r in self.on_message(m) or []])

    def on_message(self, message: dict) -> list[dict]:
        raise NotImplementedError

    def on_stop(self) -> list[dict]:
        return []


def map_messages(df: DataFrame, hook_factory: Callable[[], MessageHook],
                 schema: T.StructType | str) -> DataFrame:
    """Run a hook over every batch of rows, per partition, via mapInPandas."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hook = hook_factory()
        hook.on_start()
        for b in batches:
            out = hook.on_batch(b)
            if len(out):
                yield out.reindex(columns=names)
        tail = hook.on_stop() or []
        if tail:
            yield pd.DataFrame(tail, columns=names)

    return df.mapInPandas(run, schema)


__all__ = ["pages_stream", "analyzed_stream", "run_to_table", "frontier_batches",
           "dedupe_stream", "domain_first_stream", "edges_stream", "MessageHook",
           "map_messages", "checkpoint_dir"]
