"""Embedding whitening by bit-sliced scatter.

Entries become integers, y = floor(scale * c), x = y + shift.  The distinct
vectors are the fit list, written once as packed bytes.  Each task shifts its
vectors by the dimension's least value, cuts every dimension into bit planes and
packs a plane's bits of 64 rows into one word.  The cross-product of two
dimensions is then the sum, over pairs of their planes, of 2^(a+b) times the
population count of plane a AND plane b: exact integers, whatever the order.
Planes without a bit are left out, so one far-out value costs a few planes.
Tasks send one row per pair of dimensions, in limbs of 30 bits, which Spark sums;
the driver gets d (d + 1) / 2 sums, a number that the dimension bounds.

Centring is integer, too: n * XX - S S', divided by n^2 only at the end.  So the
covariance has no error but its last rounding, and ``eigh`` sees that.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries have no result.  Vectors must have one length: the length that most
distinct vectors have counts (of equally many, the longest), and rows of another
length have no result.  A component whose eigenvalue is zero to double precision (one
distinct vector, for instance) has a null ``whitened``, and ``identity_error``
covers the others (null if there are none).  Entries beyond +-2^62 count as that;
a ``deviation`` beyond the long range is null.  Repeated rows each have their
result and count once in the fit; vec_id may be null or repeated; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table, settled

SCALE, SHIFT = 64, 1_000_000
#: Values of one block of rows, and rows of one block at most (a multiple of 64).
_BLOCK_VALUES, _BLOCK_ROWS = 1 << 19, 4096
_LIMB, _LIMBS = 30, 6
_FAR = 1 << 62
_WIDTHS = (1, 2, 4, 8)


# ---- vectors as integers and as bytes ---------------------------------------

def whole_numbers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, starts, lengths): floor(scale * entry) of every vector, one after the
    other; the length of an unusable vector is 0."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    lengths = np.diff(offsets)
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    fine = np.isfinite(entries)
    if not fine.all():
        bad = np.concatenate(([0], np.cumsum(~fine)))
        lengths[bad[offsets[1:]] > bad[offsets[:-1]]] = 0
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.clip(np.floor(np.where(fine, entries, 0.0) * scale), -float(_FAR), float(_FAR)).astype(np.int64)
    return y, offsets[:-1], lengths


def pack(y: np.ndarray) -> bytes:
    """One vector as bytes: equal vectors, and only they, have equal bytes."""
    least, most = int(y.min()), int(y.max())
    width = next(w for w in _WIDTHS if -(1 << 8 * w - 1) <= least and most < 1 << 8 * w - 1)
    return bytes((width,)) + y.astype(f"<i{width}").tobytes()


def unpack(column: pa.Array, d: int) -> np.ndarray:
    """The d-dimensional vectors of packed bytes as rows."""
    rows = column.to_pylist()
    widths = np.array([r[0] for r in rows])
    out = np.empty((len(rows), d), dtype=np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), dtype=f"<i{width}").reshape(len(at), d)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("d", pa.int32()), ("x", pa.binary())])
    for batch in batches:
        y, starts, lengths = whole_numbers(batch.column(0))
        used = np.flatnonzero(lengths)
        yield pa.RecordBatch.from_arrays([
            pa.array(lengths[used].astype(np.int32)),
            pa.array([pack(y[starts[i]:starts[i] + lengths[i]]) for i in used], pa.binary())], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    rows = min(_BLOCK_ROWS, max(64, _BLOCK_VALUES // d // 64 * 64))
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield unpack(batch.column(0).slice(first, rows), d)


# ---- the scatter ------------------------------------------------------------

def scatter(u: np.ndarray) -> np.ndarray:
    """Exact cross-products of the columns of ``u`` (rows x d, uint64): the upper
    triangle, as Python integers, with the column sums as one column more."""
    rows, d = u.shape
    out = np.zeros((d, d + 1), dtype=object)
    if not rows:
        return out
    padded = np.zeros((-(-rows // 64) * 64, d), dtype=np.uint64)
    padded[:rows] = u
    bits = int(padded.max()).bit_length()
    planes, owner, weight = [], [], []
    for b in range(bits):
        plane = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        used = np.flatnonzero(plane.any(axis=1))
        planes.append(np.ascontiguousarray(plane[used]).view(np.uint64))
        owner.append(used)
        weight.append(np.full(len(used), b))
    if not planes:
        return out
    planes, owner, weight = np.concatenate(planes), np.concatenate(owner), np.concatenate(weight)
    order = np.lexsort((weight, owner))
    planes, owner, weight = planes[order], owner[order], weight[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])  # first plane of each dimension that has one
    kind = np.int64 if 2 * bits + 13 < 63 else object
    two = np.array([1 << int(b) for b in weight], dtype=kind)
    total = np.zeros((d, d + 1), dtype=kind)
    counts = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    total[owner[heads], d] = np.add.reduceat(counts.astype(kind) * two, heads)
    for k in range(len(planes)):
        own = int(np.searchsorted(heads, k, side="right")) - 1
        first = heads[own]
        common = np.bitwise_count(planes[first:] & planes[k]).sum(axis=1, dtype=np.int64)
        total[owner[k], owner[heads[own:]]] += np.add.reduceat(
            common.astype(kind) * two[first:], heads[own:] - first) * two[k]
    return total.astype(object)


def _bounds(d: int):
    schema = pa.schema([("at", pa.int32()), ("least", pa.int64()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = most = None
        for y in _blocks(batches, d):
            low, high = y.min(axis=0), y.max(axis=0)
            least, most = (low, high) if least is None else (np.minimum(least, low), np.maximum(most, high))
        if least is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(least), pa.array(most)], schema=schema)

    return run


def _scatters(d: int, least: list[int]):
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((f"l{k}", pa.int64()) for k in range(_LIMBS))])
    base = np.array(least, dtype=np.int64)
    at, to = np.triu_indices(d, 0, d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1), dtype=object)
        for y in _blocks(batches, d):
            total += scatter((y - base).view(np.uint64))
        sums = total[at, to]
        limbs = [(sums >> _LIMB * k & ((1 << _LIMB) - 1)).astype(np.int64) for k in range(_LIMBS - 1)]
        limbs.append((sums >> _LIMB * (_LIMBS - 1)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)), *map(pa.array, limbs)], schema=schema)

    return run


# ---- the model --------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """n distinct vectors; sums of y = x - shift per dimension; the covariance's
    leading components (columns), their eigenvalues and shares of the trace."""
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    usable: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exact (Python integers where 64 bits do not do)."""
        far = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))), 1)
        kind = np.int64 if self.n * far + max(map(abs, self.sums)) < _FAR else object
        return y.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows on the usable components; NaN on the others."""
        out = np.full((len(centred), len(self.values)), np.nan)
        ok = self.usable
        out[:, ok] = (centred / self.n).astype(np.float64) @ self.vectors[:, ok] / np.sqrt(self.values[ok])
        return out


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """n * XX - S S' over n^2, each entry rounded once (``products``: upper triangle)."""
    d = len(sums)
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * int(products[i, j]) - sums[i] * sums[j]) / (n * n)
    return out


def fit(distinct: DataFrame, n: int, d: int, components: int) -> Whitening:
    x = distinct.where(F.col("d") == d).select("x")
    low = x.mapInArrow(_bounds(d), "at int, least long, most long").groupBy("at").agg(F.min("least").alias("least"))
    least = [r.least for r in sorted(low.collect(), key=lambda r: r.at)]
    limbs = ", ".join(f"l{k} long" for k in range(_LIMBS))
    summed = (x.mapInArrow(_scatters(d, least), f"i int, j int, {limbs}").groupBy("i", "j")
              .agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS))))
    u = np.zeros((d, d + 1), dtype=object)
    for i, j, *parts in summed.collect():
        u[i, j] = sum(p << _LIMB * k for k, p in enumerate(parts))
    values, vectors = np.linalg.eigh(covariance(n, list(u[:, d]), u))  # a shift leaves the covariance as it is
    order = np.argsort(-values, kind="stable")
    trace, top = float(values.sum()), order[:components]
    values, kept = np.maximum(values[top], 0.0), vectors[:, top]
    usable = values > d * np.finfo(float).eps * max(values.max(initial=0.0), np.finfo(float).tiny)
    sums = tuple(int(s) + n * b for s, b in zip(u[:, d], least))
    return Whitening(n, sums, kept, values, values / trace if trace > 0 else np.zeros(len(top)), usable)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened fit list - identity|, measured."""
    k = len(model.values)
    if not model.usable.any():
        return None
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
    at, to = np.triu_indices(k, 0, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for y in _blocks(batches, model.d):
            w = model.whitened(model.centred(y))
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)),
                                          pa.array(total[at, to])], schema=schema)

    rows = distinct.where(F.col("d") == model.d).select("x").mapInArrow(run, "i int, j int, v double") \
        .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r.i: r.v / model.n for r in rows if r.j == k}
    errors = [abs(r.v / model.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows
              if r.j < k and model.usable[r.i] and model.usable[r.j]]
    return float(max(errors))


def _apply(model: Whitening, error: float | None, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()),
                        ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()),
                        ("identity_error", pa.float64())])
    k, d = len(model.values), model.d
    step = max(1, _BLOCK_VALUES // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            y, starts, lengths = whole_numbers(batch.column(1), scale)
            used = np.flatnonzero(lengths == d)
            for first in range(0, len(used), step):
                at = used[first:first + step]
                c = model.centred(y[starts[at][:, None] + np.arange(d)])
                if len(c) and d * max(abs(int(c.max())), abs(int(c.min()))) ** 2 >= 1 << 63:
                    squares = (c.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
                else:
                    deviation = pa.array((c.astype(np.int64) ** 2).sum(axis=1))
                w = model.whitened(c)
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)).cast(pa.int64()).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, model.n)),
                    deviation.take(each),
                    pa.array(w.ravel(), mask=np.tile(~model.usable, len(at))),
                    pa.array(np.tile(model.explained, len(at))),
                    pa.array([error] * (len(at) * k), pa.float64())], schema=schema)

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling
    eigenvalue): vec_id, component, n, deviation, whitened, explained, identity_error."""
    return settled(vectors.sparkSession, "whitened", lambda: _whiten(vectors, column, components))


def _whiten(vectors: DataFrame, column: str, components: int) -> DataFrame:
    entries = F.col(column).cast("array<double>")
    distinct = scratch_table(vectors.select(entries.alias("v")).mapInArrow(_packed, "d int, x binary")
                             .groupBy("d", "x").agg(F.lit(1).alias("once")).select("d", "x"), "distinct-vectors")
    most = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], out)
    model = fit(distinct, most["count"], most["d"], components)
    error = identity_error(distinct, model)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("v")) \
        .mapInArrow(_apply(model, error, SCALE), out)
