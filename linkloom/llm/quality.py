"""Quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed document statistics (``STATISTICS``).
Each class is a Gaussian whose covariance is shrunk towards the pooled one and
a multiple of the identity; a score is the logistic of the difference of the
log densities (half Mahalanobis distance and log determinant, both from the
class's cached Cholesky factor) and the log prior ratio.

The class counts, sums and products are aggregated by Spark over all training
rows; only these few numbers reach the driver.

Defined cases: a null text is empty (all counts 0) and is scored like any
other; training rows without a label are ignored and repeated ones count as
often as they occur; with a class missing from the training rows the score is
the share of label 1 (0.5 without any); an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import (crc32_remainder, lower_ascii, mix, per_text, scratch_table, slices,
                                 texts_of, utf8, word_bounds, word_hashes)

STATISTICS = ("words", "word_length", "upper", "digit", "symbol", "beyond_ascii", "distinct", "repeated",
              "short_words", "distinct_pairs", "lines")
FOLDS = 5
EXTRA_BYTES, EXTRA_WORDS = 30, 5
SHRINK_TO_POOLED, SHRINK_TO_IDENTITY = 0.1, 0.02


def _class_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a:b] = True
    return out


_UPPER = _class_table((65, 91))
_DIGIT = _class_table((48, 58))
_SYMBOL = _class_table((33, 48), (58, 65), (91, 97), (123, 127))
_BEYOND = _class_table((128, 192), (192, 256))


def _distinct(keys: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(mix(keys ^ mix(texts.astype(np.uint64))), return_index=True)
    return np.bincount(texts[at], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x STATISTICS) matrix: shares as square roots, counts as logarithms.
    The denominators of shares start at EXTRA_BYTES and EXTRA_WORDS, so that a
    single mark doesn't dominate a very short text."""
    n = len(offsets) - 1
    size = np.diff(offsets) + EXTRA_BYTES
    starts, ends, first = word_bounds(data, offsets)
    texts, count = texts_of(first), np.diff(first)
    words = count + EXTRA_WORDS
    lengths = ends - starts
    hashes = word_hashes(lower_ascii(data), starts, ends)
    joined = np.flatnonzero(texts[1:] == texts[:-1])
    pairs = hashes[joined] * np.uint64(0x2545F4914F6CDD1D) + hashes[joined + 1]
    n_pairs = np.maximum(count - 1, 0) + EXTRA_WORDS

    def share(marks: np.ndarray) -> np.ndarray:
        return np.sqrt(per_text(marks, offsets) / size)

    return np.column_stack([
        np.log1p(count),
        np.log1p(np.bincount(texts, weights=lengths, minlength=n) / np.maximum(count, 1)),
        share(_UPPER[data]), share(_DIGIT[data]), share(_SYMBOL[data]), share(_BEYOND[data]),
        np.log1p(_distinct(hashes, texts, n) + EXTRA_WORDS) / np.log1p(words),
        np.sqrt(np.bincount(texts[joined], weights=hashes[joined] == hashes[joined + 1], minlength=n) / n_pairs),
        np.sqrt(np.bincount(texts, weights=lengths <= 3, minlength=n) / words),
        np.log1p(_distinct(pairs, texts[joined], n) + EXTRA_WORDS) / np.log1p(n_pairs),
        np.sqrt(per_text(data == 10, offsets) / words)])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(*utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)],
                                             names=["doc_id", *STATISTICS])


class Discriminant:
    """Two Gaussians with shrunk covariances, held as Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(m[0] for m in moments.values())
        self.share = moments.get(1, (0.0,))[0] / total if total else 0.5
        self.fitted = all(moments.get(c, (0.0,))[0] >= 2 for c in (0, 1))
        if not self.fitted:
            return
        means = {c: s / n for c, (n, s, _) in moments.items()}
        spread = {c: q / n - np.outer(means[c], means[c]) for c, (n, _, q) in moments.items()}
        pooled = sum(n * spread[c] for c, (n, _, _) in moments.items()) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        unit = np.outer(self.scale, self.scale)
        self.means, self.factors, self.offsets = {}, {}, {}
        for c, (n, _, _) in moments.items():
            cov = (1 - SHRINK_TO_POOLED) * spread[c] / unit + SHRINK_TO_POOLED * pooled / unit
            cov = (1 - SHRINK_TO_IDENTITY) * cov + SHRINK_TO_IDENTITY * np.trace(cov) / len(cov) * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.means[c] = means[c] / self.scale
            self.factors[c] = np.linalg.inv(lower)  # whitens: |factor (x - mean)| is the Mahalanobis distance
            self.offsets[c] = np.log(n / total) - np.log(np.diag(lower)).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        log = {c: self.offsets[c] - 0.5 * (((x / self.scale - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1)
               for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows (STATISTICS, label 0/1): one aggregation over all of them."""
    p = len(STATISTICS)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.sum(F.col(s)) for s in STATISTICS]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i, j in pairs]
    moments = {}
    for row in rows.groupBy("label").agg(F.count(F.lit(1)), *sums, *products).collect():
        q = np.zeros((p, p))
        for (i, j), v in zip(pairs, row[2 + p:]):
            q[i, j] = q[j, i] = v
        moments[int(row[0])] = (float(row[1]), np.array(row[2:2 + p], dtype=float), q)
    return Discriminant(moments)


def _score(model: Discriminant):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns[1:]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Rows whose
    crc32(doc_id) mod FOLDS is 0 are held out of training."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    described = scratch_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                              .mapInArrow(_describe, schema), "quality")
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & (crc32_remainder(F.col("doc_id"), FOLDS) != 0)))
    model = fit(described.join(marked, "doc_id"))
    return (described.mapInArrow(_score(model), "doc_id long, score double")
            .select("doc_id", (crc32_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
