"""Blocked, layered and stored Bloom filters.

* **Blocked** (``BlockParams``): all bits of a key lie in one block of 512 bits, a row
  ``(block, w0 .. w7)``.  A probe is one join row a key, where the plain filter needs
  one for each of its k bits.  Blocks fill unevenly, so there are more of them than
  m / 512: as many as hold the designed rate with Poisson-distributed block loads.
* **Layered** (``LayerPlan``): beyond the bounds of B7 a layer is added instead of
  failing.  Layer i is sized for ``first_n * growth^i`` keys at the rate
  ``p * (1 - ratio) * ratio^i``; the rates sum to at most ``p``.  A layer takes as many keys
  as B7 lets the plain filter of that size take, and closes with B7's status (4 or 5).
* **Stored** (``LayeredBloom``): each batch writes the words of its own keys; the filter
  is the bitwise OR of the parts, by layer and block.  A version of the manifest holds the
  parameters, the count of every layer, the parts and which hashes of which batches
  went to which layer, so a restart reopens the filter and a rebuild gives the same bits.

A batch that passes a layer's capacity is cut at a hash value: the keys with smaller
hashes fill the layer.  The cut is found by counting buckets of 15 hash bits
(at most 32,768 counts reach the driver), so it depends on the keys alone, not on
partitions or retries.

Hashes are 60-bit words: ``xxhash64`` (the default) or ``md5`` (the same in any SQL
engine).  Everything runs in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.bloom import BloomParams
from linkloom.operators.manifest import Manifest

BLOCK_BITS = 512
WORDS = [f"w{i}" for i in range(BLOCK_BITS // 64)]
HASH_BITS = 60
_PER_HASH = HASH_BITS // 9      # positions (9 bits each) that one hash word gives


def hash_word(key: Column, number: int, kind: str) -> Column:
    """The ``number``-th independent 60-bit hash of a string column."""
    if kind == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(number), key), 4)
    if kind == "md5":
        digest = F.md5(F.concat(F.lit(f"{number}:"), key).cast("binary"))
        return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    raise ValueError(f"unknown hash {kind!r}")


@dataclass(frozen=True)
class BlockParams:
    """A blocked filter for ``max_n`` keys at rate ``p``."""
    max_n: int
    p: float
    hash: str = "xxhash64"

    @property
    def k(self) -> int:
        return max(1, round(-math.log2(self.p)))

    def rate(self, n: int, blocks: int | None = None) -> float:
        """Expected false positive rate with ``n`` keys: the mean over Poisson block loads."""
        mean = n / (blocks or self.blocks)
        reach = 12 * math.sqrt(mean) + 30
        total = 0.0
        for load in range(max(0, int(mean - reach)), int(mean + reach) + 1):
            weight = math.exp(load * math.log(mean) - mean - math.lgamma(load + 1)) if mean else float(load == 0)
            total += weight * (1 - (1 - 1 / BLOCK_BITS) ** (self.k * load)) ** self.k
        return total

    @property
    def blocks(self) -> int:
        """The least number of blocks that hold ``p`` at ``max_n`` keys."""
        low, high = 0, 1
        while self.rate(self.max_n, high) > self.p:
            low, high = high, 2 * high
        while high - low > max(1, high // 1000):
            middle = (low + high) // 2
            if self.rate(self.max_n, middle) > self.p:
                low = middle
            else:
                high = middle
        return high

    def block(self, key: Column) -> Column:
        return hash_word(key, 0, self.hash) % F.lit(self.blocks)


def with_masks(df: DataFrame, key: str, most: int, kind: str, k: str | None = None) -> DataFrame:
    """``df`` with the words ``m_w0 .. m_w7`` that hold the bits of column ``key`` and no
    others: ``most`` bits, or as many of them as column ``k`` says."""
    hashes = [hash_word(F.col(key), 1 + i, kind) for i in range(-(-most // _PER_HASH))]
    at = [f"_at{i}" for i in range(most)]
    placed = df.select("*", *(F.shiftright(hashes[i // _PER_HASH], 9 * (i % _PER_HASH)).bitwiseAND(F.lit(511)).alias(n)
                              for i, n in enumerate(at)))

    def word(w: int) -> str:
        return " | ".join(f"if(shiftright({a}, 6) = {w}{f' and {i} < {k}' if k else ''}, "
                          f"shiftleft(1L, cast({a} & 63 as int)), 0L)" for i, a in enumerate(at))

    return placed.select(*df.columns, *(F.expr(word(w)).alias(f"m_{name}") for w, name in enumerate(WORDS)))


def _held() -> Column:
    """All bits of the probe's masks are set in the joined block."""
    missing = [F.col(f"m_{w}").bitwiseAND(F.bitwise_not(F.coalesce(F.col(w), F.lit(0).cast("long")))) == 0 for w in WORDS]
    out = missing[0]
    for m in missing[1:]:
        out = out & m
    return out


def _ored(df: DataFrame, *keys: str, prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(*(F.bit_or(prefix + w).alias(w) for w in WORDS))


def _keys(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("_key")).where(F.col("_key").isNotNull()).distinct()


# ---------------------------------------------------------------- blocked --

def blocked_build(df: DataFrame, col: str, params: BlockParams) -> DataFrame:
    """B3, blocked: ``(block, w0 .. w7)`` of every (non-null) value of ``col``.  Repeats
    are combined map-side; the table has at most ``params.blocks`` rows."""
    rows = df.select(F.col(col).alias("_key")).where(F.col("_key").isNotNull())
    masked = with_masks(rows.withColumn("block", params.block(F.col("_key"))), "_key", params.k, params.hash)
    return _ored(masked, "block", prefix="m_")


def blocked_contains(bloom: DataFrame, probes: DataFrame, col: str, params: BlockParams,
                     name: str = "in_bloom") -> DataFrame:
    """B4, blocked: distinct values of ``col`` with boolean ``name``; one join row a value.
    The masks are made after the join, so a probe travels as key and block only."""
    keys = _keys(probes, col).withColumn("block", params.block(F.col("_key")))
    joined = with_masks(keys.join(bloom, "block", "left"), "_key", params.k, params.hash)
    return joined.select(F.col("_key").alias(col), _held().alias(name))


def confirmed(flags: DataFrame, col: str, stored: DataFrame) -> DataFrame:
    """J7, tier two: ``flags`` (col, in_bloom) with ``known``.  Only the values that the
    filter may hold are looked up in ``stored``; the others are certainly new."""
    there = stored.select(col).distinct().withColumn("_there", F.lit(True))
    maybe = flags.where("in_bloom").join(there, col, "left").select(
        col, "in_bloom", F.coalesce("_there", F.lit(False)).alias("known"))
    return maybe.unionByName(flags.where("not in_bloom").withColumn("known", F.lit(False)))


# ---------------------------------------------------------------- layered --

@dataclass(frozen=True)
class LayerPlan:
    """The layers of a filter that grows: sizes, rates, bounds."""
    first_n: int
    p: float
    growth: int = 2
    ratio: float = 0.5
    hash: str = "xxhash64"

    def bounds(self, layer: int) -> BloomParams:
        """B1 and B7 of a layer: the plain filter of its size and rate."""
        return BloomParams(self.first_n * self.growth ** layer, self.p * (1 - self.ratio) * self.ratio ** layer)

    def blocks(self, layer: int) -> BlockParams:
        b = self.bounds(layer)
        return BlockParams(b.max_n, b.p, self.hash)

    def fill(self, counts: list[int], n: int) -> list[tuple[int, int]]:
        """(layer, keys) that ``n`` more keys add to layers holding ``counts``."""
        out, layer = [], max(0, len(counts) - 1)
        while n:
            held = counts[layer] if layer < len(counts) else 0
            room = min(n, self.bounds(layer).capacity() - held)
            if room > 0:
                out.append((layer, room))
                n -= room
            layer += 1
        return out


def layer_counts(plan: LayerPlan, counts: list[int]) -> list[dict]:
    """B5-B7 of every layer: its size, count, rate now, and status (0 open; the code
    it closed with otherwise)."""
    rows = []
    for layer, n in enumerate(counts):
        b = plan.bounds(layer)
        rows.append({"layer": layer, "max_n": b.max_n, "capacity": b.capacity(), "p": b.p, "m": b.m, "k": b.k, "n": n,
                     "status": b.closing_status() if layer + 1 < len(counts) else 0})
    return rows


def hash_cut(hashes: DataFrame, n: int) -> int:
    """The largest hash value below which at most ``n`` of the rows' ``h`` lie."""
    low, width = 0, HASH_BITS
    while width:
        width -= 15
        size = 1 << width
        inside = hashes.where((F.col("h") >= low) & (F.col("h") < low + (size << 15)))
        bucket = F.shiftright(F.col("h") - F.lit(low), width).alias("b")
        for b, count in sorted(inside.groupBy(bucket).count().collect()):
            if count > n:
                low += b * size
                break
            n -= count
        else:
            return low + (size << 15)
    return low


class LayeredBloom:
    """A layered filter stored at ``path``: opened if it is there, else made by ``plan``."""

    #: Parts that are merged into one when there are more.
    MOST_PARTS = 8

    def __init__(self, spark: SparkSession, path: str, plan: LayerPlan | None = None):
        self.spark, self.manifest = spark, Manifest(spark, path)
        state = self.manifest.read()
        if state is None:
            if plan is None:
                raise ValueError(f"no filter is stored at {path}, and no plan is given")
            state = {"plan": vars(plan), "counts": [0], "parts": [], "cuts": [], "last_batch": -1}
            self.manifest.commit(state)
        self.plan = LayerPlan(**state["plan"])
        if plan is not None and plan != self.plan:
            raise ValueError(f"the filter at {path} was made by {self.plan}")

    def _state(self) -> dict:
        return self.manifest.read()

    @property
    def counts(self) -> list[int]:
        return self._state()["counts"]

    def stats(self) -> DataFrame:
        """One row a layer, see ``layer_counts``."""
        return self.spark.createDataFrame(layer_counts(self.plan, self.counts), (
            "layer int, max_n long, capacity long, p double, m long, k int, n long, status int"))

    def words(self) -> DataFrame:
        """(layer, block, w0 .. w7) of the whole filter."""
        schema = ", ".join(["layer int", "block long", *(f"{w} long" for w in WORDS)])
        parts = self._state()["parts"]
        if not parts:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).parquet(*parts)
        return read if len(parts) == 1 else _ored(read, "layer", "block")

    def _layered(self, hashed: DataFrame, cuts: list[dict]) -> DataFrame:
        """Rows (batch, _key, h) with the layer that the cuts send them to, and the block."""
        layer = F.coalesce(*(F.when(F.col("batch").between(c["first"], c["last"]) & (F.col("h") >= c["low"])
                                    & (F.col("h") < c["high"]), F.lit(c["layer"])) for c in cuts)).cast("int")
        rows = hashed.withColumn("layer", layer)
        places = {i: self.plan.blocks(i) for i in sorted({c["layer"] for c in cuts})}
        block = F.coalesce(*(F.when(F.col("layer") == i, F.col("h") % F.lit(b.blocks)) for i, b in places.items()))
        k = F.coalesce(*(F.when(F.col("layer") == i, F.lit(b.k)) for i, b in places.items()))
        return rows.withColumns({"block": block, "k": k})

    def _words_of(self, rows: DataFrame, counts: list[int]) -> DataFrame:
        """OR of the masks of layered rows."""
        most = max(self.plan.blocks(i).k for i in range(len(counts)))
        return _ored(with_masks(rows, "_key", most, self.plan.hash, "k"), "layer", "block", prefix="m_")

    def add(self, batch_id: int, df: DataFrame, col: str) -> bool:
        """Add the distinct (non-null) values of ``col`` as batch ``batch_id``; False if that batch
        is in the filter (a replay).  Batches come in rising order."""
        state = self._state()
        if batch_id <= state["last_batch"]:
            return False
        staged = self.manifest.folder("staged")
        _keys(df, col).withColumn("h", hash_word(F.col("_key"), 0, self.plan.hash)).write.parquet(staged)
        rows = self.spark.read.parquet(staged).withColumn("batch", F.lit(batch_id).cast("long"))
        n = rows.count()
        counts, cuts, low = list(state["counts"]), [], 0
        fills = self.plan.fill(counts, n)
        while fills:
            layer, room = fills[0]
            rest = rows.where(F.col("h") >= low)
            high = 1 << HASH_BITS if len(fills) == 1 else hash_cut(rest, room)
            taken = n if high == 1 << HASH_BITS else rest.where(F.col("h") < high).count()
            counts += [0] * (layer + 1 - len(counts))
            if taken:
                cuts.append({"first": batch_id, "last": batch_id, "layer": layer, "low": low, "high": high})
                counts[layer] += taken
            elif layer + 1 == len(counts):
                counts.append(0)            # equal hashes do not fit in what is left: the layer closes
            n, low = n - taken, high
            fills = self.plan.fill(counts, n) if n else []
        if cuts:
            part = self.manifest.folder("words")
            self._words_of(self._layered(rows, cuts), counts).write.parquet(part)
            state["parts"] = [*state["parts"], part]
        self.manifest.commit(state | {"counts": counts, "cuts": _merged(state["cuts"], cuts), "last_batch": batch_id})
        self.manifest.discard(staged)
        if len(state["parts"]) > self.MOST_PARTS:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the parts into one."""
        state = self._state()
        if len(state["parts"]) > 1:
            part = self.manifest.folder("words")
            self.words().write.parquet(part)
            self.manifest.commit(state | {"parts": [part]})

    def drop_versions(self, keep: int = 1) -> int:
        return self.manifest.drop(keep, lambda state: state["parts"])

    def rebuilt(self, history: DataFrame, col: str) -> DataFrame:
        """The words made anew from all keys, ``history`` (batch, col), in one job."""
        hashed = history.select("batch", F.col(col).alias("_key")).where(F.col("_key").isNotNull()).distinct() \
            .withColumn("h", hash_word(F.col("_key"), 0, self.plan.hash))
        state = self._state()
        return self._words_of(self._layered(hashed, state["cuts"]), state["counts"])

    def contains(self, probes: DataFrame, col: str, name: str = "in_bloom") -> DataFrame:
        """Distinct values of ``col`` with boolean ``name``: one join row a value and layer."""
        h, layers = hash_word(F.col("_key"), 0, self.plan.hash), range(len(self.counts))
        places = [self.plan.blocks(i) for i in layers]
        asked = _keys(probes, col).select("_key", F.inline(F.array(*(
            F.struct(F.lit(i).alias("layer"), (h % F.lit(p.blocks)).alias("block"), F.lit(p.k).alias("k"))
            for i, p in zip(layers, places)))))
        joined = asked.join(self.words(), ["layer", "block"], "left")
        joined = with_masks(joined, "_key", max(p.k for p in places), self.plan.hash, "k")
        return joined.groupBy(F.col("_key").alias(col)).agg(F.bool_or(_held()).alias(name))

    def known(self, probes: DataFrame, col: str, stored: DataFrame) -> DataFrame:
        """``contains``, then the survivors looked up in ``stored``."""
        return confirmed(self.contains(probes, col), col, stored)


def _merged(old: list[dict], new: list[dict]) -> list[dict]:
    """Batches that went whole into one layer are kept as one range of batches."""
    whole = {"low": 0, "high": 1 << HASH_BITS}
    if len(new) == 1 and old and old[-1]["layer"] == new[0]["layer"] \
            and all(c[k] == v for c in (old[-1], new[0]) for k, v in whole.items()):
        return [*old[:-1], old[-1] | {"last": new[0]["last"]}]
    return [*old, *new]
