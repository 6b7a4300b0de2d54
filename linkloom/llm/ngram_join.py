"""Similarity join of documents by word shingles, with parity sketches.

A document is the set of its distinct ``words``-word shingles (64-bit hashes).
Two sets link when 100 |A and B| >= ``percent`` |A or B|.  For such a pair the
symmetric difference d is small: d <= (100 - percent) / percent of the smaller
set.  A *parity sketch* keeps, per cell, the parity (XOR) of the shingles
hashed into it, so a cell differs only where the symmetric difference has an
odd number of members: differing cells never exceed d.

* *Candidates.*  Per size band the hash range is cut into k = D + 1 + E blocks,
  D bounding d within the band.  At most D blocks of a linked pair differ, so
  1 + E or more have the same XOR of 64-bit shingle hashes and meet in a join on
  (band, block, XOR).  The E spare blocks let a document leave out up to E empty
  blocks, which would meet by chance; a document with more of them sends all.
  Nothing is lost either way.
* *Filter.*  The blocks that share their smallest class make up a bucket.
  Within it the Hamming distance of the whole bit sketches lower-bounds d and
  drops most pairs that are no links.
* *Contract, verify.*  A bucket sends only a spanning forest of the pairs left.
  They are verified on the full sets and give components; then the pairs left
  between different components are all verified as well.  A group of g mutual
  near copies thus costs about g verified pairs, not their square, and no link
  that joins two components is lost.

Equal sets are one class from the start.  A bucket beyond ``BUCKET`` classes is
dealt out as pairs of blocks, so a task never holds a whole hot group.

Defined cases: null or empty texts have no shingles and link with nothing;
texts with fewer words are one shingle; rows that repeat a doc_id belong to the
class of their text; a null doc_id sorts last; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import (gram_keys, lower_ascii, mix, release, scratch_table, settled, signed, slices,
                                 texts_of, utf8, word_bounds, word_keys)
from linkloom.llm.components import components

BUCKET = 512
#: Pairs of one class that a copy of its set verifies.
PAIRS_A_COPY = 256
_LAST = (1 << 63) - 1


# ---- shingle sets ------------------------------------------------------------

def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of all texts, and the
    index of each text's first one."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_keys(lower_ascii(data), starts, ends)
    n, text = len(column), texts_of(first)
    count = np.diff(first)
    grams = gram_keys(hashes, words)
    owner = text[:len(grams)]
    whole = owner == text[words - 1:] if len(grams) else np.empty(0, bool)
    grams, owner = grams[whole], owner[whole]
    short = np.flatnonzero((count > 0) & (count < words))
    alone = np.zeros(len(short), dtype=np.uint64)
    for k in range(1, words):
        at = count[short] >= k
        alone[at] = mix(alone[at] ^ hashes[first[short[at]] + k - 1])
    grams = np.concatenate([grams, mix(alone ^ count[short].astype(np.uint64))])
    owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(n + 1))


def _identity(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set (0 for an empty one)."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    if len(full):
        again = mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        out[full] = mix(np.add.reduceat(again, first[full]) ^ mix(np.bitwise_xor.reduceat(hashes, first[full])))
    return out


@lru_cache
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper size, blocks, spare blocks) of the size bands; the first holds the
    sizes that link only with equal sets."""
    rest = 100 - percent
    if not rest:        # equal sets only, and those are one class
        return np.array([1 << 40]), np.array([3]), np.array([2])
    upper = [(percent - 1) // rest]
    while upper[-1] < 1 << 40:
        upper.append(max(upper[-1] + 1, upper[-1] * 7 // 5))
    size = np.array(upper, dtype=np.int64)
    most = rest * size // percent
    spare = most // 10 + 2
    return size, most + 1 + spare, spare


def _block_keys(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set index) of the blocks by which the sets meet."""
    upper, blocks, spare = _bands(percent)
    n = np.diff(first)
    high = np.searchsorted(upper, n)
    low = np.searchsorted(upper, -(-n * percent // 100))
    keys, owners = [], []
    for down in range(int((high - low).max(initial=0)) + 1):
        band = high - down
        sets = np.flatnonzero((n > 0) & (band >= np.maximum(low, 1)))
        if not len(sets):
            continue
        k = blocks[band[sets]]
        size = n[sets]
        at = np.arange(size.sum()) + np.repeat(first[sets] - np.cumsum(size) + size, size)
        h = hashes[at]
        base = np.cumsum(k) - k
        block = ((h >> np.uint64(32)) * np.repeat(k, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        block += np.repeat(base, size)
        heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        value = np.zeros(k.sum(), dtype=np.uint64)
        value[block[heads]] = np.bitwise_xor.reduceat(mix(h), heads)
        poor = np.ones(k.sum(), dtype=bool)
        poor[block[heads]] = False
        of = np.repeat(np.arange(len(sets)), k)
        all_sent = np.bincount(of, weights=poor, minlength=len(sets)) > spare[band[sets]]
        send = np.flatnonzero(~poor | all_sent[of])
        of = of[send]
        place = (band[sets][of] << 32) + (send - base[of])
        keys.append(mix(value[send] ^ mix(place.astype(np.uint64))))
        owners.append(sets[of])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _sketches(hashes: np.ndarray, first: np.ndarray, percent: int) -> list[bytes]:
    """The parity bits of each set, a power of two of at least 8 D cells."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        cells = 1 << max(7, int(8 * ((100 - percent) * (b - a) // percent + 1) - 1).bit_length())
        odd = np.bincount((mix(hashes[a:b]) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def _describe(words: int, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(first)), signed(_identity(hashes, first)),
                     pa.array(_sketches(hashes, first, percent), pa.binary())],
                    names=["doc_id", "text_key", "n", "class", "sketch"])
    return describe


def _index(words: int, percent: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # a class sends its blocks once per so many classes of a task
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = shingle_sets(part.column(0), words)
                ids = _identity(hashes, first)
                keys, owner = _block_keys(hashes, first, percent)
                fresh = np.zeros(len(ids), dtype=bool)
                for i, c in enumerate(ids.tolist()):
                    if c not in sent:
                        sent.add(c)
                        fresh[i] = True
                if len(sent) > 200_000:
                    sent.clear()
                send = fresh[owner]
                yield pa.RecordBatch.from_arrays([signed(keys[send]), signed(ids[owner[send]])],
                                                 names=["key", "class"])
    return index


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = shingle_sets(part.column(0), words)
                yield pa.RecordBatch.from_arrays(
                    [signed(_identity(hashes, first)),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), signed(hashes))],
                    names=["class", "members"])
    return sets


# ---- pairs of a bucket -------------------------------------------------------

def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of equal length: halves XORed down to the shortest."""
    least = min(map(len, sketches))
    rows = np.empty((len(sketches), least // 8), dtype=np.uint64)
    for i, s in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, least // 8), axis=0)
    return rows


def bucket_pairs(sizes: np.ndarray, sketches: list[bytes], groups: list[int] | None, percent: int
                 ) -> list[tuple[int, int]]:
    """Pairs (i < j) that may link.  Without ``groups``: a spanning forest of
    them; otherwise all that lie in two different groups."""
    rows = _folded(sketches)
    limit = 100 - percent
    label = np.arange(len(sizes)) if groups is None else np.asarray(groups)
    out = []
    for i in range(len(sizes) - 1):
        # Only what is not yet in one tree (one group) is compared, so g mutual
        # near copies of a bucket cost one pass and not one each.
        rest = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
        if not len(rest):
            continue
        differ = np.bitwise_count(rows[rest] ^ rows[i]).sum(axis=1, dtype=np.int64)
        near = rest[differ * (100 + percent) <= limit * (sizes[i] + sizes[rest])].tolist()
        for j in near:
            if groups is not None:
                out.append((i, j))
            elif label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _pairs(percent: int, grouped: bool):
    """Over rows (bucket, class, n, sketch[, c]) that arrive bucket by bucket."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            _, ids, sizes, sketches, *group = zip(*held)
            return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in bucket_pairs(
                np.array(sizes), list(sketches), list(group[0]) if grouped else None, percent)]

        out: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out.update(close())
                    held.clear()
                held.append(row)
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out.clear()
        out.update(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
    return pairs


# ---- verification ------------------------------------------------------------

def _attach(pairs: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    """Join the set of ``side`` to each pair; the set of a class with many
    pairs is copied, one copy for every PAIRS_A_COPY of them."""
    other = "b" if side == "a" else "a"
    copies = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(side)) / PAIRS_A_COPY).cast("int")
    pairs = (pairs.withColumn("copies", copies)
             .withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies"))
    spread = (pairs.groupBy(side).agg(F.max("salt").alias("salts"))
              .join(sets.withColumnRenamed("class", side), side)
              .select(side, F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), F.col("members").alias(name)))
    return pairs.join(spread, [side, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) on the full sets."""
    both = _attach(_attach(pairs, sets, "a", "of_a"), sets, "b", "of_b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return (both.withColumn("shared", shared)
            .select("a", "b", (F.col("shared") * 100 >= union * percent).alias("linked")))


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links), text_key (of the text, to tell rows of one doc_id apart) and
    component (a label that only the rows linked to each other share; null without shingles)."""
    return settled(docs.sparkSession, "ngram-join", lambda: _ngram_join(docs, words, percent))


def _ngram_join(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    described = scratch_table(docs.mapInArrow(
        _describe(words, percent), "doc_id long, text_key long, n long, class long, sketch binary"), "shingle-sets")
    order = F.coalesce("doc_id", F.lit(_LAST))
    classes = scratch_table(described.where("n > 0").groupBy("class").agg(
        F.min(order).alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n"),
        F.max("sketch").alias("sketch")), "classes")

    # A bucket is the union of the blocks that have one smallest class: near copies
    # meet in many blocks, and so each of them is sent to a bucket once.
    key = Window.partitionBy("key")
    indexed = docs.select("text").mapInArrow(_index(words, percent), "key long, class long")
    met = (indexed.select("class", F.min("class").over(key).alias("lead"), F.max("class").over(key).alias("most"))
           .where(F.col("lead") != F.col("most")).select("lead", "class").distinct())
    met = scratch_table(met, "met")
    release(spark)
    # Only the leads of large buckets; both sides of the join are plain tables, so
    # adaptive execution can broadcast the few or split a hot one.
    large = scratch_table(met.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("parts"))
                          .where("parts > 1"), "large-buckets")
    met = met.join(large, "lead", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts, part = F.col("parts"), F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    meets = F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda p: p != part),
        lambda p: F.least(p, part).cast("long") * 1_000_000 + F.greatest(p, part)))
    buckets = scratch_table(met.select("lead", "class", F.explode(meets).alias("meet"))
                            .select(F.xxhash64("lead", "meet").alias("bucket"), "class"), "buckets")
    members = buckets.join(classes.drop("rep", "least"), "class")

    def pairs_of(rows: DataFrame, grouped: bool) -> DataFrame:
        rows = rows.select("bucket", "class", "n", "sketch", *(["c"] if grouped else []))
        return (rows.repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(_pairs(percent, grouped), "a long, b long").distinct())

    forest = scratch_table(pairs_of(members, False), "pairs")
    # Every class with a pair left in some bucket is in the forest, so these sets serve both verifications.
    needed = (forest.select(F.explode(F.array("a", "b")).alias("class")).distinct()
              .join(classes.select("class", "rep"), "class"))
    texts = docs.select(order.alias("rep"), "text").join(needed.select("rep").distinct(), "rep")
    sets = (texts.select("text").mapInArrow(_sets(words), "class long, members array<long>")
            .join(needed.select("class"), "class", "left_semi").groupBy("class").agg(F.first("members").alias("members")))
    sets = scratch_table(sets, "sets")
    release(spark)
    tested = scratch_table(_verified(forest, sets, percent), "tested")
    release(spark)
    links = tested.where("linked").select("a", "b")
    grouped = components(links)

    split = members.join(grouped.withColumnRenamed("v", "class"), "class", "left") \
        .withColumn("c", F.coalesce("c", "class"))
    rest = pairs_of(split.join(needed.select("class"), "class", "left_semi"), True) \
        .join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = scratch_table(_verified(scratch_table(rest, "pairs"), sets, percent).where("linked").select("a", "b"),
                         "links")
    if more.limit(1).count():
        grouped = components(links.union(more))
    release(spark)

    named = (classes.select("class", "least").join(grouped.withColumnRenamed("v", "class"), "class", "left")
             .withColumn("c", F.coalesce("c", "class")))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))     # a null doc_id counts only alone
    named = scratch_table(named.join(least, "c").select("class", "component_id", F.col("c").alias("component")),
                          "components")
    # Both sides are plain tables, so adaptive execution splits the join at a class with very many documents.
    return (described.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
            .join(named, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "text_key", "component"))
