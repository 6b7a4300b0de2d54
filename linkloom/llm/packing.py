"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

A document is its byte-level BPE ids followed by id 0; only a longer one is
cut, its first piece taking the remainder.  Sequences come from the
configuration linear program: a configuration is a multiset of lengths that
fits one sequence, and the program covers the length histogram with as few
configurations as possible.  It is solved by multiplicative weights -- every
length has a price that falls as it gets covered, and each round prices all
configurations at once with the knapsack dynamic program over the capacity --
until all but a stated share of the tokens is covered -- and then rounded to
whole sequences.  What rounding leaves over is placed best fit, largest length
first.  A piece of ``capacity`` tokens is a sequence of its own.

Only the histogram, at most ``capacity`` x ``SALTS`` numbers, reaches the
driver, whatever the size of the corpus.  Pieces are ranked within their
(length, salt) group, so that one frequent length is spread over many tasks,
and each task looks up the slot of a rank in the bounded slot table.

Defined cases: null and empty texts are the single id 0; repeated rows are
packed as often as they occur; which of equal pieces gets which slot is open; an empty table gives an empty result; other
columns of ``docs`` are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import SLICE_BYTES, scratch_table, slices

SALTS = 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"
_encoders: dict[str, object] = {}


def _encoder(ranks_path: str, json_path: str):
    """ids of one text.  The rank file holds the same vocabulary and merges as
    the JSON tokenizer and gives the same ids several times faster.  The JSON
    file names the special tokens: a text is cut at them first, and what lies
    between two of them is encoded on its own, as the JSON tokenizer does."""
    if ranks_path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
        with open(json_path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must match literally")
        special = {t["content"]: t["id"] for t in added}
        cuts = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

        def encode(text: str) -> list[int]:
            ids: list[int] = []
            end = 0
            for m in cuts.finditer(text):
                ids += fast.encode_ordinary(text[end:m.start()])
                ids.append(special[m[0]])
                end = m.end()
            return ids + fast.encode_ordinary(text[end:]) if end else fast.encode_ordinary(text)

        _encoders[ranks_path] = encode
    return _encoders[ranks_path]


def _cut_documents(capacity: int, ranks_path: str, json_path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, json_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), 0], dtype="<u4")
                    end = len(ids) % capacity or min(len(ids), capacity)
                    start, piece = 0, 0
                    while start < len(ids):
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                        start, end, piece = end, end + capacity, piece + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return cut


# ---- the configuration linear program ----------------------------------------

def _price_all(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the greatest total price within each room, and the
    length to take there first (0: none fits)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1::-1] + prices[1:room + 1]
        at = int(gain.argmax())
        if gain[at] > best[room - 1]:
            best[room], took[room] = gain[at], at + 1
        else:
            best[room], took[room] = best[room - 1], took[room - 1]
    return best, took


def _configuration(length: int, took: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration that holds ``length`` at least once."""
    out = {length: 1}
    room = capacity - length
    while took[room]:
        k = int(took[room])
        out[k] = out.get(k, 0) + 1
        room -= k
    return out


def solve_configurations(counts: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 24, rate: float = 8.0,
                         slack: float = 0.02) -> list[tuple[float, dict[int, int]]]:
    """Fractional solution [(x, configuration)] for ``counts`` (index = length).

    Passes of ``rounds`` rounds go on until all but the share ``gap`` of the tokens is covered.
    In round r of a pass every length may be covered up to the share r / ``rounds`` of what the
    passes before left.  A round prices all configurations with one knapsack, then raises those
    within ``slack`` of the best, one for each length that they hold for certain.  A covered
    length has no price, so it stands in no configuration of a later pass.  The best value of a
    round bounds the optimum from below; a pass that covers nothing more ends the program."""
    sizes = np.arange(capacity + 1)
    left = counts.astype(float)
    total = float(left @ sizes)
    chosen: dict[tuple, float] = {}
    while left @ sizes > gap * total:
        need, live, covered = left, left > 0, np.zeros(capacity + 1)
        for r in range(1, rounds + 1):
            allowed = need * r / rounds
            share = covered / np.where(live, need, 1)
            prices = np.where(live, sizes * np.exp(rate * (share[live].mean() - share)), 0.0)
            best, took = _price_all(prices, capacity)
            value = prices + best[::-1]
            for length in np.flatnonzero(live & (value >= (1 - slack) * value.max())).tolist():
                config = _configuration(length, took, capacity)
                step = min((allowed[k] - covered[k]) / m for k, m in config.items())
                if step > 0:
                    key = tuple(sorted(config.items()))
                    chosen[key] = chosen.get(key, 0.0) + step
                    for k, m in config.items():
                        covered[k] += m * step
        left = np.where(need - covered > 1e-9 * counts, need - covered, 0.0)
        if (need - left) @ sizes <= 0:
            break
    return [(x, dict(key)) for key, x in chosen.items()]


def round_configurations(counts: np.ndarray, capacity: int, fractional: list[tuple[float, dict[int, int]]]
                         ) -> list[tuple[int, list[int]]]:
    """Whole sequences [(how many, lengths in order)] that hold every piece
    exactly once.  The work depends on the number of lengths, not of pieces."""
    left = counts.astype(np.int64).copy()
    done: list[tuple[int, list[int]]] = []
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}

    def put(n: int, lengths: list[int]) -> None:
        room = capacity - sum(lengths)
        if room:
            open_bins.setdefault(room, []).append((n, lengths))
        else:
            done.append((n, lengths))

    for x, config in sorted(fractional, key=lambda c: -c[0]):
        n = min(int(np.ceil(x)), *(int(left[k]) // m for k, m in config.items()))
        if n > 0:
            for k, m in config.items():
                left[k] -= n * m
            put(n, [k for k, m in sorted(config.items(), reverse=True) for _ in range(m)])
    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            room = min((r for r in open_bins if r >= length), default=capacity)
            if room in open_bins:
                n, held = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                n, held = rest, []
            each = min(room // length, rest)
            use = min(n, rest // each)
            if held and n > use:
                open_bins.setdefault(room, []).append((n - use, held))
            put(use, held + [length] * each)
            rest -= use * each
    return done + [b for bins in open_bins.values() for b in bins]


def slot_table(sequences: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """(key, rank, sequence, offset) arrays sorted by key = length << 40 | first
    rank: the pieces of a length fill its slots in the order of their ranks."""
    next_rank: dict[int, int] = {}
    rows = []
    base = 0
    for n, lengths in sequences:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length << 40 | rank, rank, base, offset))
            next_rank[length] = rank + n
            offset += length
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(4))


def _place(bases: np.ndarray, slots: tuple[np.ndarray, ...]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = slots
        for b in batches:
            length, salt, nth = (b.column(i).to_numpy() for i in (3, 5, 6))
            rank = bases[length, salt] + nth - 1
            at = np.searchsorted(key, (length << 40) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return place


def pack_documents(docs: DataFrame, ranks_path: str, json_path: str, capacity: int = 2048,
                   gap: float = 0.002) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    pieces = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(_cut_documents(capacity, ranks_path, json_path), _PIECES)
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
              .withColumn("row", F.monotonically_increasing_id()))
    pieces = scratch_table(pieces, "pieces")
    part = pieces.where(F.col("length") < capacity)
    counts = np.zeros((capacity, SALTS), dtype=np.int64)
    for length, salt, n in part.groupBy("length", "salt").count().collect():
        counts[length, salt] = n
    bases = np.cumsum(counts, axis=1) - counts
    totals = np.append(counts.sum(axis=1), 0)
    sequences = round_configurations(totals, capacity, solve_configurations(totals, capacity, gap)) \
        if totals.any() else []
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    packed = (part.drop("row").withColumn("nth", F.row_number().over(group).cast("long"))
              .mapInArrow(_place(bases, slot_table(sequences)), _PACKED))
    # A full piece is a sequence of its own and needs no rank.
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
