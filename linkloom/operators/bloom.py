"""Bloom filter as a distributed aggregate.

The bit array is a table ``bloom(word long, bits long)``: bit ``i`` lives in
word ``i div 64`` at position ``i mod 64``.  Building it is
explode-indexes -> ``groupBy(word).agg(bit_or(...))`` (partial aggregation on
every map task, so no item ever travels more than once and no driver collect);
probing is explode-indexes -> join on ``word`` -> ``min(bit set)`` per key.
The bit array has at most ``ceil(m / 64)`` rows, a bound known from the
parameters before any data is read; the probe join leaves it to Spark whether
its measured size allows a broadcast.

Hash (B2), reference-compatible: 64-bit FNV-1 of the UTF-8 bytes; with
``hi`` = upper and ``lo`` = lower 32 bits, index i = ((hi + i*lo + i*i) mod
2^32) mod m for i in 0..k-1.  The hash runs in an Arrow-batched pandas UDF
with numpy uint64 arithmetic, because 64-bit wrap-around multiplication is
not expressible in ANSI Spark SQL without overflow errors; the k indexes are
then plain long arithmetic in Spark.  A string holding NUL has no hash: the
build refuses it, and a probe keeps it with a null flag.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from linkloom.operators.seen import SALTS

# 64-bit FNV-1 offset basis and prime.
FNV64_OFFSET = 14695981039346656037
FNV64_PRIME = 1099511628211

LN2 = math.log(2)

ERR_BLOOM_SIZE_OVERFLOW = 4
ERR_BLOOM_ERROR_RATE = 5


@dataclass(frozen=True)
class BloomParams:
    """B1: sizing for ``max_n`` items at error rate ``p``.

    ``hash`` is ``"fnv1"`` (the reference's bits, via a vectorised pandas
    UDF) or ``"xxhash64"`` (Spark's built-in 64-bit hash, all in the JVM;
    same composite-index formula, different bits, same guarantees).
    """
    max_n: int
    p: float
    hash: str = "fnv1"

    def sizing(self) -> tuple[float, float]:
        """Bits and hash functions before truncation: n ln(1/p) / ln(2)^2 bits,
        and ln(2) hash functions for each whole bit of an item."""
        bits = self.max_n * math.log(self.p) / -LN2 ** 2
        return bits, int(bits) / self.max_n * LN2

    @property
    def m(self) -> int:
        return int(self.sizing()[0])

    @property
    def k(self) -> int:
        return int(self.sizing()[1])

    @property
    def decimals(self) -> int:
        """Decimal places of ``p``: rates are compared at this precision."""
        return next(d for d in range(400) if round(self.p, d) == self.p)

    @property
    def words(self) -> int:
        return (self.m + 63) // 64

    @classmethod
    def for_items(cls, n: int, p: float, hash: str = "fnv1") -> "BloomParams":
        """Sized for a measured number of items with room for as many again
        (never under 1,000)."""
        return cls(max(1000, 2 * n), p, hash)

    def error_rate(self, n: int) -> float:
        """B6, unrounded, from the sizes before truncation: the share of bits set
        by n and a half items, to the power of the hash functions."""
        bits, hashes = self.sizing()
        return (1 - math.exp(-hashes * (n + .5) / (bits - 1))) ** hashes

    def capacity(self) -> int:
        """Number of adds that pass the bounds check (n < max_n and the
        rounded rate at n not above p).  The rate rises with n, so this is a
        binary search over the formula -- parameter arithmetic, no data."""
        def ok(n):
            return n < self.max_n and round(self.error_rate(n), self.decimals) <= self.p
        lo, hi = 0, self.max_n
        if not ok(0):
            return 0
        while lo < hi:                      # largest n with ok(n) -> capacity n+1
            mid = (lo + hi + 1) // 2
            if ok(mid):
                lo = mid
            else:
                hi = mid - 1
        return lo + 1

    def closing_status(self) -> int:
        """The code of the add after the last that fits: 4 if max_n is reached first,
        5 if the rate passes p before."""
        return ERR_BLOOM_SIZE_OVERFLOW if self.capacity() >= self.max_n else ERR_BLOOM_ERROR_RATE


def error_rate(n: Column, params: BloomParams) -> Column:
    """B6 as an expression (unrounded)."""
    bits, hashes = params.sizing()
    return F.pow(1 - F.exp(-F.lit(hashes) * (n + 0.5) / F.lit(bits - 1)), F.lit(hashes))


# ---------------------------------------------------------------- hashing --

def fnv1_64_many(values) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1 64 of many strings at once: (uint64 hashes, valid mask).

    The UTF-8 bytes are read straight from an Arrow string array (offsets +
    data buffer, no per-row Python); step j updates every string longer than
    j, so the work is one numpy operation per byte position.  Null strings
    and strings holding NUL are invalid.
    """
    arr = values if isinstance(values, (pa.Array, pa.ChunkedArray)) \
        else pa.array(values, type=pa.string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    n = len(arr)
    h = np.full(n, FNV64_OFFSET, dtype=np.uint64)
    if n == 0:
        return h, np.zeros(0, dtype=bool)
    valid = ~np.asarray(arr.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None \
        else np.zeros(0, dtype=np.uint8)
    starts = offsets[:-1]
    lens = np.where(valid, offsets[1:] - starts, 0)
    if data.size:
        zeros = np.flatnonzero(data[offsets[0]:offsets[-1]] == 0) + offsets[0]
        if zeros.size:
            rows = np.searchsorted(offsets, zeros, side="right") - 1
            valid[rows] = False
            lens[rows] = 0
    if lens.max(initial=0) == 0:
        return h, valid
    order = np.argsort(-lens, kind="stable")       # longest first: active set is a prefix
    sl = lens[order]
    ss = starts[order]
    hs = h[order]
    prime = np.uint64(FNV64_PRIME)
    neg = -sl
    for j in range(int(sl[0])):
        cnt = int(np.searchsorted(neg, -j, side="left"))   # strings with len > j
        hs[:cnt] = (hs[:cnt] * prime) ^ data[ss[:cnt] + j].astype(np.uint64)
    h[order] = hs
    return h, valid


def composite_indexes(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """(n, k) int64 array of bit indexes from 64-bit hashes (numpy form)."""
    hi = h >> np.uint64(32)
    lo = h & np.uint64(0xFFFFFFFF)
    i = np.arange(k, dtype=np.uint64)[None, :]
    v = (hi[:, None] + i * lo[:, None] + i * i) & np.uint64(0xFFFFFFFF)
    return (v % np.uint64(m)).astype(np.int64)


@pandas_udf(LongType())
def fnv1_64(s: pd.Series) -> pd.Series:
    """FNV-1 64 as a signed long (two's complement of the uint64); null for
    a null string or one holding NUL."""
    h, valid = fnv1_64_many(pa.Array.from_pandas(s, type=pa.string()))
    return pd.Series(pd.arrays.IntegerArray(h.view(np.int64), ~valid))


def indexes_from_hash(h: Column, k: int, m: int) -> Column:
    """B2 composite: the k bit indexes of a 64-bit hash column (null stays
    null).  Every term stays below 2^36, so nothing wraps."""
    hi = F.shiftrightunsigned(h, 32)
    lo = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(h.isNotNull(), F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: ((hi + i.cast("long") * lo + i.cast("long") * i.cast("long"))
                   .bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(m)).cast("long")))


def with_bloom_indexes(df: DataFrame, col: str, params: "BloomParams",
                       name: str = "indexes") -> DataFrame:
    """B2: add the k bit indexes of string column ``col`` (null if rejected).

    Only the 64-bit hash comes from Python (its own projection, so the UDF
    is evaluated once per row); the indexes are long arithmetic in Spark.
    """
    if params.hash == "xxhash64":
        c = F.col(col)
        h = F.when(~c.contains("\x00"), F.xxhash64(c))
        return df.withColumn(name, indexes_from_hash(h, params.k, params.m))
    if params.hash != "fnv1":
        raise ValueError(f"unknown Bloom hash {params.hash!r}")
    hashed = df.withColumn("_fnv", fnv1_64(F.col(col)))
    return hashed.withColumn(name, indexes_from_hash(F.col("_fnv"), params.k, params.m)) \
        .drop("_fnv")


# --------------------------------------------------------- build / probe --

def bloom_build(df: DataFrame, col: str, params: BloomParams) -> DataFrame:
    """B3 + B7: the bit array of every (non-null) value of ``col``.

    The query fails when a value holds NUL (it has no hash) and, with code 4 or
    5, when there are more values (repeats included) than the parameters allow.
    The values are counted by a subquery, so ``df`` is read twice: give it a
    stored table or a checkpoint.
    """
    c = F.col(col)
    checked = df.select(F.when(c.contains("\x00"), F.raise_error(F.lit("Bloom filter: NUL in a value")))
                        .otherwise(c).alias(col))
    idx = with_bloom_indexes(checked, col, params, "_idx") \
        .select(F.explode("_idx").alias("i"))
    words = idx.groupBy(F.floor(F.col("i") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(i % 64 as int))")).alias("bits"))
    n = df.agg(F.count(col)).scalar()
    fail = F.raise_error(F.concat(F.lit(f"Bloom filter bounds exceeded, code {params.closing_status()}: n="),
                                  n.cast("string"), F.lit(f", capacity={params.capacity()}")))
    return words.select("word", F.when(n > params.capacity(), fail).otherwise(F.col("bits")).alias("bits"))


def bloom_contains(bloom: DataFrame, probes: DataFrame, col: str, params: BloomParams,
                   name: str = "in_bloom") -> DataFrame:
    """Distinct values of ``col`` with boolean ``name`` (all k bits set).

    No false negatives; false positives at about the designed rate.  A value
    holding NUL has no hash: it is kept with a null flag.  The bit table has at
    most ``params.words`` rows, and Spark broadcasts it when its measured size
    allows.
    """
    keys = probes.select(F.col(col).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    exploded = with_bloom_indexes(keys, "_key", params, "_idx") \
        .select("_key", F.explode_outer("_idx").alias("i"))
    exploded = exploded.select("_key", F.floor(F.col("i") / 64).cast("long").alias("word"),
                               (F.col("i") % 64).cast("int").alias("bit"))
    hit = exploded.join(bloom.select("word", "bits"), "word", "left").select(
        "_key", F.expr("(coalesce(bits, 0L) & shiftleft(1L, bit)) != 0").alias("_set"))
    return hit.groupBy(F.col("_key").alias(col)).agg(F.min(F.col("_set").cast("int"))
                                                      .cast("boolean").alias(name))


def bloom_stats(df: DataFrame, col: str, params: BloomParams) -> DataFrame:
    """One row with n (inserts, repeats included), m, k, the current
    error rate (raw and rounded to the digits of p) and the bounds status:
    0 fits, 4 size overflow (n would pass max_n), 5 error rate exceeded."""
    cap = params.capacity()
    n = F.count(F.col(col))
    rate = error_rate(n, params)
    over_status = params.closing_status()
    return df.agg(n.alias("n")).select(
        F.lit(params.m).cast("long").alias("m"), F.lit(params.k).cast("int").alias("k"),
        "n", error_rate(F.col("n"), params).alias("current_p_float"),
        F.round(error_rate(F.col("n"), params), params.decimals).alias("current_p"),
        F.lit(cap).cast("long").alias("capacity"),
        F.when(F.col("n") <= cap, 0).otherwise(over_status).cast("int").alias("status"))


def check_bounds(df: DataFrame, col: str, params: BloomParams) -> DataFrame:
    """B7, strict: the ``bloom_stats`` row, failing the query (code 4 size
    overflow, 5 error rate) when the items would not all fit."""
    st = bloom_stats(df, col, params)
    return st.withColumn("status", F.when(
        F.col("status") != 0,
        F.raise_error(F.concat(F.lit("Bloom filter bounds exceeded, code "),
                               F.col("status").cast("string"), F.lit(": n="),
                               F.col("n").cast("string"), F.lit(", capacity="),
                               F.col("capacity").cast("string"))))
        .otherwise(F.col("status")).cast("int"))


def two_tier_known(probes: DataFrame, col: str, bloom: DataFrame, stored: DataFrame,
                   params: BloomParams) -> DataFrame:
    """Distinct values of ``col`` with ``in_bloom`` and ``known``.

    The Bloom filter answers "certainly not stored" for most new keys; only
    the keys it may contain are confirmed against the stored table (a
    left-semi join on the survivors).  ``known`` equals a plain lookup; a key
    holding NUL (null ``in_bloom``) is looked up plainly.
    """
    flags = bloom_contains(bloom, probes, col, params)
    confirmed = flags.filter("coalesce(in_bloom, true)").select(col) \
        .join(stored.select(col).distinct(), col, "left_semi") \
        .withColumn("_known", F.lit(True))
    return flags.join(confirmed, col, "left").select(
        col, "in_bloom", F.coalesce("_known", F.lit(False)).alias("known"))


def two_tier_pairs(probes: DataFrame, domains: DataFrame, urls: DataFrame, stored: DataFrame,
                   domain_params: BloomParams, url_params: BloomParams) -> DataFrame:
    """J7 by pair: distinct (domain, url) probes with ``domain_known`` and
    ``pair_known``.

    Tier one asks the Bloom filter of domains, tier two that of URLs; a key that
    a filter may contain is confirmed against the stored (domain, url) table, so
    both flags equal plain lookups.  A pair is known only within a known domain.
    A hot domain's pairs are dealt over SALTS tasks by their URL.
    """
    pairs = probes.select("domain", "url").distinct()
    hosts = two_tier_known(pairs, "domain", domains, stored, domain_params) \
        .select("domain", F.col("known").alias("domain_known"))
    maybe = bloom_contains(urls, pairs, "url", url_params, "_maybe").where("coalesce(_maybe, true)")
    sure = pairs.join(maybe.select("url"), "url", "left_semi") \
        .join(stored.select("domain", "url"), ["domain", "url"], "left_semi") \
        .withColumn("_pair", F.lit(True))
    hosts = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = pairs.join(sure, ["domain", "url"], "left") \
        .withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return pairs.join(hosts, ["domain", "_salt"], "left").select(
        "domain", "url", F.coalesce("domain_known", F.lit(False)).alias("domain_known"),
        F.coalesce("_pair", F.lit(False)).alias("pair_known"))
