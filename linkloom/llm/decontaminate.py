"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of white space becomes one space.  An item
of L characters may differ by e = floor(``error_rate`` x L) edits.  It is split
into e + 1 pieces, of which an occurrence with at most e edits keeps at least
one unchanged.  One automaton finds all pieces of a block of items in a text;
around each hit Myers' bit-parallel algorithm takes the least edit distance of
the item to a substring, which decides.

The items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, so a
task's memory is bounded; each block reads every whole text.  Documents are
neither shuffled nor compared with each other.

Items of fewer than ``SHORT`` normalised characters are searched as they are,
without edits, and only between word boundaries: a short answer inside a longer
word is no hit.

Defined cases: null or empty texts match nothing; items with a null or empty text
match nothing; of the places with an item's least distance the first counts;
repeated rows match alike; an empty table gives an empty result; other
columns of ``docs`` stay as they are in ``clean_documents`` and are ignored in
``contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import slices

BLOCK_CHARS = 1 << 20
#: Items shorter than this are matched exactly, as whole words.
SHORT = 24
_MATCH = "doc_id long, item_id long, distance int, budget int, start long, end long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, its end):
    Myers' algorithm, one bit for each character of the pattern."""
    mask: dict[str, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    m = len(pattern)
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus = every, 0
    score = best = m
    end = 0
    for i, c in enumerate(text, 1):
        match = mask.get(c, 0)
        xv = match | minus
        xh = (((match & plus) + plus) ^ plus) | match
        up = minus | (every & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & every
        down = down << 1 & every
        plus = down | (every & ~(xv | up))
        minus = up & xv
        if score < best:
            best, end = score, i
    return best, end


def _apart(text: str, start: int, end: int) -> bool:
    """The range begins and ends at word boundaries."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()
                or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class ItemBlock:
    """Items with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, text, int(len(text) * error_rate) if len(text) >= SHORT else 0) for i, text in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            n = budget + 1
            cuts = [len(text) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """item_id -> (distance, budget, start, end) of its best place in the normalised text."""
        spans: dict[int, list[list[int]]] = {}
        alone: dict[int, tuple[int, int, int, int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                budget = self.items[k][2]
                at = last + 1 - length - offset
                if len(self.items[k][1]) < SHORT:
                    if _apart(text, at, at + length):
                        alone.setdefault(self.items[k][0], (0, 0, at, at + length))
                    continue
                low, high = at - budget, at + len(self.items[k][1]) + budget
                held = spans.setdefault(k, [])
                if held and low <= held[-1][1] and high >= held[-1][0]:
                    held[-1][0] = min(low, held[-1][0])
                    held[-1][1] = max(high, held[-1][1])
                else:
                    held.append([low, high])
        found = alone
        for k, places in spans.items():
            item, pattern, budget = self.items[k]
            for low, high in places:
                low = max(low, 0)
                distance, end = best_substring(pattern, text[low:high])
                if distance <= budget and (item not in found or distance < found[item][0]):
                    back, length = best_substring(pattern[::-1], text[low:low + end][::-1])
                    found[item] = (distance, budget, low + end - length, low + end)
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, block by block.  The items pass through the driver, which holds a
    partition at a time, and every block stays in the plan: memory is that of the benchmark."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    for item_id, text in rows.toLocalIterator():
        text = normalise(text)
        if text:
            block.append((item_id, text))
            size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _find(items: list[tuple[int, str]], error_rate: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ItemBlock(items, error_rate)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(doc_id, item, *hit)
                        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for item, hit in sorted(block.matches(normalise(text)).items())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6,
                                                    [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2)],
                    names=["doc_id", "item_id", "distance", "budget", "start", "end"])
    return find


def _keep(items: list[tuple[int, str]], error_rate: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ItemBlock(items, error_rate)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([not block.matches(normalise(t)) for t in texts], pa.bool_()))
    return keep


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance,
    budget, and the range [start, end) of the normalised text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], _MATCH)
    for items in item_blocks(benchmark):
        out = out.union(texts.mapInArrow(_find(items, error_rate), _MATCH))
    return out.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("distance", "budget", "start", "end")).alias("best")).select("doc_id", "item_id", "best.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_keep(items, error_rate), docs.schema)
    return docs
