"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased letter runs, hashed into ``BUCKETS``.  The
machine adds to the linear weights an inner product of factors for every pair
of present terms, so that two terms together (an insult and whom it is aimed
at) can weigh more, or less, than their sum.

Training uses a bounded sample: at most ``sample`` labelled rows, one a doc_id,
chosen by the hash of their ids.  Spark counts their terms.  Two tests choose the
inputs: at most ``TERMS`` terms whose share differs most between the classes;
and, among the terms that ``LEAST_SHARE`` of the sampled rows hold, every term of a
pair whose texts are mislabelled by the machine of the first terms more than
chance allows -- neither of the pair needs an effect of its own.  With the second
terms the machine is trained again.  The driver gets the sampled rows' terms as
small numbers.  Every whole text is scored.  (All terms as inputs were tried:
on few labelled rows the many rare ones drown the rest.)

Defined cases: a null or empty text has no terms and gets the bias; labels
that are null are ignored; with a class missing from the sample the score is
the share of label 1 (0.5 without any); an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import (crc32_remainder, lower_ascii, slices, texts_of, utf8, word_bounds,
                                 word_hashes)

BUCKETS = 1 << 18
TERMS = 1024
FOLDS = 5
LEAST_Z = 3.5
#: Pairs are tested among terms of this share of the sampled rows, where this many rows hold both.
LEAST_SHARE, LEAST_BOTH = 0.02, 20
#: Standard deviations of a pair's summed error that count (millions of pairs are tested).
PAIR_Z = 6.5
#: Training weight of a toxic row over a plain one.
TOXIC_WEIGHT = 4.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct hashed terms of each text."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets, _LETTER[data])
    bucket = word_hashes(lower_ascii(data), starts, ends) & np.uint64(BUCKETS - 1)
    both = np.unique(texts_of(first) * BUCKETS + bucket.astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (bucket, texts of label 0, texts of label 1)."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            label = part.column(1).to_numpy()
            text, bucket = terms(part.column(0))
            for c in (0, 1):
                counts[c] += np.bincount(bucket[label[text] == c], minlength=BUCKETS)
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])],
                                     names=["bucket", "plain", "toxic"])


def _inputs(lookup: np.ndarray):
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, bucket = terms(part.column(0))
                held = lookup[bucket] >= 0
                ends = np.searchsorted(text[held], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(lookup[bucket[held]]))],
                    names=["label", "inputs"])
    return inputs


class FactorizationMachine:
    def __init__(self, n: int, rank: int = 4, seed: int = 7):
        self.bias = 0.0
        self.weights = np.zeros(n)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (n, rank))

    def raw(self, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of n texts given by their (text, term) pairs, and the
        sums of the factors of each text."""
        out = self.bias + np.bincount(text, weights=self.weights[term], minlength=n)
        sums = np.column_stack([np.bincount(text, weights=f[term], minlength=n) for f in self.factors.T])
        squares = np.bincount(text, weights=(self.factors ** 2).sum(axis=1)[term], minlength=n)
        return out + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def fit(self, text: np.ndarray, term: np.ndarray, label: np.ndarray, steps: int = 300, rate: float = 0.1,
            decay: float = 3e-5) -> "FactorizationMachine":
        """Logistic loss with weight decay, by Adam over the whole sample."""
        n, size = len(label), len(self.weights)
        state = {k: [0.0, 0.0] for k in ("bias", "weights", "factors")}
        self.bias = float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
        for step in range(1, steps + 1):
            raw, sums = self.raw(text, term, n)
            err = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label) * np.where(label > 0, TOXIC_WEIGHT, 1.0) / n
            e = err[text]
            grads = {"bias": err.sum(), "weights": np.bincount(term, weights=e, minlength=size) + decay * self.weights}
            own = np.bincount(term, weights=e, minlength=size)[:, None] * self.factors
            grads["factors"] = np.column_stack([np.bincount(term, weights=e * s[text], minlength=size)
                                                for s in sums.T]) - own + decay * self.factors
            for k, g in grads.items():
                m, v = state[k]
                state[k] = m, v = [0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g]
                setattr(self, k, getattr(self, k)
                        - rate * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8))
        return self


def _score(machine: FactorizationMachine | None, lookup: np.ndarray, share: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = np.full(part.num_rows, share)
                if machine is not None:
                    text, bucket = terms(part.column(1))
                    held = lookup[bucket] >= 0
                    raw, _ = machine.raw(text[held], lookup[bucket[held]], part.num_rows)
                    scores = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])
    return score


def fit(rows: DataFrame) -> tuple[FactorizationMachine | None, np.ndarray, float]:
    """From the sampled rows (text, label): the machine, its terms, the share of label 1."""
    lookup = np.full(BUCKETS, -1, dtype=np.int32)
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return None, lookup, float(sizes.get(1, 0)) / total if total else 0.5
    plain, toxic = F.col("plain") / sizes[0], F.col("toxic") / sizes[1]
    both = (F.col("plain") + F.col("toxic")) / total
    z = F.abs(toxic - plain) / F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    counted = (rows.mapInArrow(_count_terms, "bucket long, plain long, toxic long").groupBy("bucket")
               .agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic")).withColumn("z", z)
               .withColumn("n", F.col("plain") + F.col("toxic")))
    chosen = [r.bucket for r in counted.where((F.col("n") >= 5) & (F.col("z") >= LEAST_Z))
              .orderBy(F.col("z").desc(), "bucket").limit(TERMS).collect()]
    held = set(chosen)
    # Rows hold a few hundred terms each, so a few hundred / LEAST_SHARE terms have that share.
    often = [r.bucket for r in counted.where(F.col("n") >= max(LEAST_BOTH, LEAST_SHARE * total)).select("bucket")
             .orderBy("bucket").collect()]
    known = chosen + [b for b in often if b not in held]
    if not known:
        return None, lookup, sizes[1] / total
    lookup[known] = np.arange(len(known))
    table = rows.mapInArrow(_inputs(lookup), "label int, inputs array<int>").toArrow()
    inputs, label = table.column("inputs").combine_chunks(), table.column("label").to_numpy().astype(float)
    text = np.repeat(np.arange(len(inputs)), inputs.value_lengths().to_numpy())
    term = inputs.flatten().to_numpy()
    first = term < len(chosen)
    machine = FactorizationMachine(len(chosen)).fit(text[first], term[first], label)
    raw, _ = machine.raw(text[first], term[first], len(label))
    error = label - 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
    place = np.full(len(known), -1)
    place[[lookup[b] for b in often]] = np.arange(len(often))
    common = place[term] >= 0
    paired = {often[k] for k in paired_terms(text[common], place[term[common]], len(often), error - error.mean())} - held
    if paired:
        place = np.full(len(known), -1)
        place[:len(chosen)] = np.arange(len(chosen))
        place[[lookup[b] for b in sorted(paired)]] = len(chosen) + np.arange(len(paired))
        used = place[term] >= 0
        machine = FactorizationMachine(len(chosen) + len(paired)).fit(text[used], place[term[used]], label)
    final = np.full(BUCKETS, -1, dtype=np.int32)
    final[chosen + sorted(paired)] = np.arange(len(chosen) + len(paired))
    return machine, final, sizes[1] / total


def paired_terms(text: np.ndarray, term: np.ndarray, n: int, error: np.ndarray, block: int = 512) -> set[int]:
    """Terms (of n) in a pair whose common texts have a summed error that chance does not explain.
    Blocks of terms against all terms, rows block by block: memory is block x n."""
    order = np.argsort(text, kind="stable")
    text, term = text[order], term[order]
    bounds = np.searchsorted(text, np.arange(0, len(error) + 2048, 2048))
    out: set[int] = set()
    for low in range(0, n, block):
        size = min(block, n - low)
        total, spread, both = (np.zeros((size, n), dtype=np.float32) for _ in range(3))
        for k in range(len(bounds) - 1):
            rows = error[2048 * k:2048 * (k + 1)].astype(np.float32)
            if not len(rows):
                continue
            dense = np.zeros((len(rows), n), dtype=np.float32)
            a, b = bounds[k], bounds[k + 1]
            dense[text[a:b] - 2048 * k, term[a:b]] = 1
            mine = dense[:, low:low + size].T
            both += mine @ dense
            total += (mine * rows) @ dense
            spread += (mine * rows ** 2) @ dense
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = (both >= LEAST_BOTH) & (np.abs(total) >= PAIR_Z * np.sqrt(spread))
        odd[np.arange(size), low + np.arange(size)] = False
        at, to = np.nonzero(odd)
        out.update((low + at).tolist(), to.tolist())
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Rows whose
    crc32(doc_id) mod FOLDS is 0 are held out of training."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``sample`` rows of two numbers, so the broadcast is bounded.
    # One row a doc_id (the least label, the least text), so a repeated id brings no more rows.
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & (crc32_remainder(F.col("doc_id"), FOLDS) != 0))
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    machine, lookup, share = fit(rows.select("text", "label"))
    return (texts.mapInArrow(_score(machine, lookup, share), "doc_id long, score double")
            .select("doc_id", (crc32_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
