"""Helpers shared by the corpus operators: scratch tables in the shared
folder, and numpy views of the words of an Arrow batch.

Scratch tables are written under the folder that ``spark.checkpoint.dir``
names.  They survive lost executors and cut the lineage.  ``settled`` drops the
tables that a result no longer needs; whoever owns the folder clears the rest.
"""

from __future__ import annotations

import gc
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import scratch_path

#: Bytes of text handled at once by the numpy word scans.
SLICE_BYTES = 1 << 19

#: The word separators of every contract here: blank, tab .. carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_calls = threading.local()


def _frames() -> list[list[str]]:
    """The tables written so far, for each ``settled`` call that this thread is in."""
    if not hasattr(_calls, "frames"):
        _calls.frames = []
    return _calls.frames


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    if _frames():
        _frames()[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table, without the scratch tables
    that ``make`` wrote on the way."""
    frames = _frames()
    mine: list[str] = []
    frames.append(mine)
    try:
        made = make()
        path = scratch_path(spark, name)
        schema = made.schema
        made.write.parquet(path)
    finally:
        frames.remove(mine)
        for old in mine:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if frames:
        frames[-1].append(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans nobody holds any more
    (it acts when the driver's garbage is collected)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc32_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


# ---- words of an Arrow column ------------------------------------------------

def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 256
           ) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text of ``column`` passes ``limit`` bytes or
    ``rows`` rows (one row at least, so a text is never cut)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = utf8(col)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + rows, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and for each text the
    index of its first word (with the total at the end).  ``inside`` marks the
    bytes of words where they are not simply those that are no separators."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data] if inside is None else inside
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    head[cut] |= inside[cut]
    tail[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(head)
    ends = np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


# ---- keys of words and of word sequences: what decides that two are equal -----

_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte ranges (words): eight bytes at a time go through a non-linear
    step, so no structure of a word (as in a polynomial) makes words collide."""
    left = ends - starts
    keys = mix(left.astype(np.uint64) ^ _STEP)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, word = starts, np.arange(len(starts))
    while len(word):
        chunk = eight[at] & _TAILS[np.minimum(left, 8)]
        keys[word] = mix(keys[word] ^ (chunk * _STEP))
        more = left > 8
        at, left, word = at[more] + 8, left[more] - 8, word[more]
    return keys


def gram_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Key of every n consecutive words; entry i starts at word i."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= _STEP
        h ^= h >> np.uint64(29)
        h ^= words[k:k + m]
    return mix(h)


def range_keys(grams: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the word ranges (of n words or more), from their n-grams: those at every
    n-th word and the last one."""
    keys = mix((ends - starts).astype(np.uint64) ^ _STEP)
    at, of = starts, np.arange(len(starts))
    while len(of):
        last = ends[of] - n
        keys[of] = mix(keys[of] ^ (grams[np.minimum(at, last)] * _STEP))
        more = at < last
        at, of = at[more] + n, of[more]
    return keys


# ---- 64-bit hashes of features (polynomials: cheap, but structured words can collide) ----

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for all the given ranges at once: a
    polynomial over 64-bit wrap-around arithmetic, then mixed."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_INVERSE, n + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; entry i starts at word i."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[k:k + m]
    return mix(h)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` within each text's range."""
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def texts_of(first: np.ndarray) -> np.ndarray:
    """Index of the text of each word, from the texts' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
