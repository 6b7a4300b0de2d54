"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every run of blanks, tabs and
line ends is replaced by one space (a null text counts as empty).  Three
stages, each comparing the full content and not only its digest:

1. *Local*: a task combines the equal texts of its own chunk (``chunk_bytes``
   of text and CHUNK_ROWS rows at a time), so copies within a chunk never travel.
2. *Salted*: the chunk winners of one digest meet in ``salts`` separate groups.
   A hot text sends one row per chunk, not per copy, over all salts.
3. *Global*: the at most ``salts`` winners of a digest are combined.

The content travels as a zstd frame of one fixed level.  Equal texts give equal
frames and a frame decodes to one text, so comparing frames compares texts.
The decision goes back to the chunk's members by row number, without content.

Defined cases: rows that repeat a doc_id with equal text are copies and one of
them stays; a null doc_id sorts after every number; an empty table gives an
empty result; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import SLICE_BYTES, scratch_table, settled, slices

_GAPS = re.compile("[ \t-\r]+")
CHUNK_ROWS = 1 << 16
_LOCAL = "digest binary, frame binary, first long, n long, members array<long>"


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", text or "")


def _combine_chunks(chunk_bytes: int):
    schema = pa.schema([("digest", pa.binary()), ("frame", pa.binary()), ("first", pa.int64()),
                        ("n", pa.int64()), ("members", pa.list_(pa.int64()))])

    def flush(held: dict[bytes, list]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        members = [sorted(m, key=lambda i: (i is None, i or 0)) for m in held.values()]
        return pa.RecordBatch.from_arrays([
            pa.array([hashlib.sha256(t).digest() for t in held], pa.binary()),
            pa.array([pack.compress(t) for t in held], pa.binary()),
            pa.array([m[0] for m in members], pa.int64()),
            pa.array([len(m) for m in members], pa.int64()),
            pa.array(members, schema.field("members").type)], schema=schema)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = rows = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    content = normalise(text).encode()
                    if content not in held:
                        held[content] = []
                        size += len(content)
                    held[content].append(doc_id)
                rows += part.num_rows
                if size >= chunk_bytes or rows >= CHUNK_ROWS:
                    yield flush(held)
                    held, size, rows = {}, 0, 0
        if held:
            yield flush(held)

    return combine


def exact_dedup(docs: DataFrame, salts: int = 16, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest doc_id of its text),
    group_size, kept, text_sha256 (of the normalised text)."""
    return settled(docs.sparkSession, "exact", lambda: _exact_dedup(docs, salts, chunk_bytes))


def _exact_dedup(docs: DataFrame, salts: int, chunk_bytes: int) -> DataFrame:
    local = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .mapInArrow(_combine_chunks(chunk_bytes), _LOCAL)
             .withColumn("row", F.monotonically_increasing_id()))
    local = scratch_table(local, "exact-local")
    salted = (local.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
              .groupBy("digest", "frame", "salt")
              .agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "row")).alias("best"), F.sum("n").alias("n"),
                   F.collect_list("row").alias("rows")))
    same = Window.partitionBy("digest", "frame")
    winners = (salted.select("rows", F.min("best").over(same).alias("winner"),
                             F.sum("n").over(same).alias("group_size"))
               .select(F.explode("rows").alias("row"), "winner", "group_size"))
    return (local.select("row", "digest", "members").join(winners, "row")
            .select("row", "digest", "winner", "group_size", F.posexplode("members").alias("at", "doc_id"))
            .select("doc_id",
                    F.col("winner.first").alias("keep_id"),
                    "group_size",
                    ((F.col("row") == F.col("winner.row")) & (F.col("at") == 0)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
