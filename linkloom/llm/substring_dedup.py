"""Substring deduplication with suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts in a document with a smaller doc_id is
removed.

1. *Runs.*  The minimizer of a window is the least hash of its ``GRAM``-word
   grams; consecutive windows with one minimizer form a run.  Equal windows have
   equal minimizers, so a window can repeat only where its minimizer occurs in
   two documents.  One small row per run finds these.
2. *Owners.*  Equal runs belong to the smallest document that has them.  Where a
   minimizer has several different runs, only their windows are compared one by
   one, at every place where the owner has them.  Both are minima that combine in each task before the shuffle.
3. *Matching statistics.*  The owners' spans are the reference.  A shard is one
   owner's spans; its suffix automaton reads the spans of the later documents
   that point to it and yields, word by word, the longest match ending there.
   Maximal spans of ``window`` words or more are removed.  The reference grows
   with the corpus, so no broadcast of it has a size bound: spans and shards meet
   in a shuffle instead, and the shard of an owner with many spans is copied,
   one copy for every ``SPANS_A_COPY`` of them.

Words are compared as 64-bit keys (``common.word_keys``).  Defined cases: a null text has no words;
rows with one doc_id and different texts are told apart by text and neither is
smaller than the other; a null doc_id is larger than every number (the largest
long ranks with it); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import (gram_keys, range_keys, release, scratch_table, settled, signed, slices, texts_of,
                                 utf8, word_bounds, word_keys)

GRAM = 16
SPANS_A_COPY = 1024
_LAST = (1 << 63) - 1


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets)
    return word_keys(data, starts, ends), first


def window_runs(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(minimizer, run hash, text, start word, windows) of all runs."""
    n = len(words) - window + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty(0, np.uint64), e, e, e
    grams = gram_keys(words, GRAM)
    low, span, held = grams, window - GRAM + 1, 1
    while held < span:
        step = min(held, span - held)
        low, held = np.minimum(low[:-step], low[step:]), held + step
    text = texts_of(first)
    at = np.flatnonzero(text[:n] == text[window - 1:])
    least = low[at]
    heads = np.flatnonzero(np.concatenate((
        [True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (text[at[1:]] != text[at[:-1]])))
        if len(at) else [])
    start, count = at[heads], np.diff(np.append(heads, len(at)))
    whole = range_keys(grams, GRAM, start, start + count + window - 1)
    return least[heads], whole, text[start], start - first[text[start]], count


def _runs(window: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                least, whole, text, start, count = window_runs(*_words(part.column(2)), window)
                yield pa.RecordBatch.from_arrays(
                    [signed(least), signed(whole), part.column(0).take(pa.array(text)),
                     part.column(1).take(pa.array(text)), pa.array(start), pa.array(count)],
                    names=["least", "run", "doc", "version", "start", "n"])
    return runs


def _windows(window: int):
    """Hashes of the single windows of the asked runs (start, n, least) of each text."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = _words(part.column(2))
                grams = gram_keys(words, window)
                asked = part.column(3).to_pylist()
                rows = [(i, r["start"], r["n"], r["least"]) for i, runs in enumerate(asked) for r in runs]
                text, start, n, least = (np.array(c, dtype=np.int64) for c in zip(*rows))
                of = np.repeat(np.arange(len(n)), n)
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of]
                at = pa.array(text[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[of]), signed(grams[first[text[of]] + pos]), part.column(0).take(at),
                     part.column(1).take(at), pa.array(pos)],
                    names=["least", "hash", "doc", "version", "start"])
    return windows


# ---- suffix automata ---------------------------------------------------------

class SuffixAutomaton:
    """Of several word sequences; states hold the length and the suffix link."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that reads exactly one word more than p along ``word``."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.step[last]:
                last = self._split(last, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            last = new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal ranges of ``words`` covered by matches of ``least`` or more."""
        step, link, length = self.step, self.link, self.length
        state = held = 0
        out: list[list[int]] = []
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                held = length[state]
            if word in step[state]:
                state = step[state][word]
                held += 1
                if held >= least:
                    a = i + 1 - held
                    if out and a <= out[-1][1]:
                        out[-1][0] = min(a, out[-1][0])
                        out[-1][1] = i + 1
                    else:
                        out.append([a, i + 1])
            else:
                held = 0
        return [(a, b) for a, b in out]


def _merged(ranges: list[tuple]) -> list[tuple]:
    """Sorted (group..., start, end) rows with touching ranges of a group joined."""
    out: list[tuple] = []
    for *group, a, b in sorted(ranges):
        if out and list(out[-1][:-2]) == group and a <= out[-1][-1]:
            out[-1] = (*group, out[-1][-2], max(b, out[-1][-1]))
        else:
            out.append((*group, a, b))
    return out


def _spans(window: int):
    """Rows of the shards: the spans that a text has as an owner (role 0, once
    per copy of its shard) and those that point to an earlier owner (role 1)."""
    names = ["owner", "owner_version", "copy", "role", "doc", "version", "start", "words"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = _words(part.column(2))
                rows = []
                for i, (doc, version, own, copies, later) in enumerate(zip(
                        *(part.column(k).to_pylist() for k in (0, 1, 3, 4, 5)))):
                    base = int(first[i])

                    def cut(a: int, b: int) -> bytes:
                        return words[base + a:base + b].tobytes()

                    for a, b in _merged([(r["start"], r["start"] + r["n"] + window - 1) for r in own or ()]):
                        rows += [(doc, version, k, 0, doc, version, a, cut(a, b)) for k in range(copies)]
                    for o, v, k, a, b in _merged([
                            (r["owner"], r["owner_version"], r["copy"], r["start"], r["start"] + r["n"] + window - 1)
                            for r in later or ()]):
                        rows.append((o, v, k, 1, doc, version, a, cut(a, b)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], names=names)
    return spans


def _read_shards(window: int):
    """Over the rows of ``_spans`` in shard order, references first."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            out = []
            for owner, owned, copy, role, doc, version, start, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (owner, owned, copy):
                    shard, automaton = (owner, owned, copy), SuffixAutomaton()
                words = np.frombuffer(raw, dtype=np.int64).tolist()
                if role == 0:
                    automaton.add(words)
                else:
                    out += [(doc, version, start + a, start + b) for a, b in automaton.matches(words, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 4)],
                names=["doc", "version", "start", "end"])
    return read


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = utf8(part.column(1))
            starts, ends, first = word_bounds(data, offsets)
            raw = data.tobytes()
            counts, removed, digests = [], [], []
            for i, spans in enumerate(part.column(2).to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                keep = np.ones(b - a, dtype=bool)
                for s in spans or ():
                    keep[s["start"]:s["end"]] = False
                kept = b" ".join(raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist()))
                counts.append(b - a)
                removed.append(b - a - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc, version, start, end): the word ranges to remove, of rows (doc, version, text)."""
    return settled(docs.sparkSession, "spans", lambda: _repeated_spans(docs, window))


def _repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    spark = docs.sparkSession
    runs = scratch_table(docs.mapInArrow(
        _runs(window), "least long, run long, doc long, version long, start long, n long"), "runs")
    # Minimizers of several documents, and whether their runs differ.  Both joined
    # sides are written tables, so adaptive execution can split a hot minimizer.
    shared = scratch_table(runs.groupBy("least").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("run").alias("a"), F.max("run").alias("b"))
        .where(F.col("low") != F.col("high")).select("least", (F.col("a") != F.col("b")).alias("differ")),
        "shared-minimizers")
    runs = scratch_table(runs.join(shared, "least"), "shared-runs")
    release(spark)
    by_run = scratch_table(runs.groupBy("least", "run").agg(
        F.min(F.struct("doc", "version", "start", "n")).alias("first"), F.max("doc").alias("last"),
        F.max("differ").alias("differ"), F.count(F.lit(1)).alias("held")), "run-owners")
    release(spark)

    # Equal runs: the smallest document owns them.
    owned = by_run.where(F.col("last") != F.col("first.doc")).select("least", "run", "first")
    equal = (runs.join(owned, ["least", "run"]).where(F.col("doc") > F.col("first.doc"))
             .select("doc", "version", "start", "n", F.col("first.doc").alias("owner"),
                     F.col("first.version").alias("owner_version"), F.col("first.start").alias("owner_start")))
    # Different runs of one minimizer: window by window, over the owners of the runs.
    # An owner can hold a run at several places, and in several texts of one doc_id.
    again = by_run.where("differ AND held > 1").select("least", "run", F.col("first.doc").alias("doc"))
    asked = (by_run.where("differ AND held = 1").select("first.*", "least")
             .union(runs.join(again, ["least", "run", "doc"]).select("doc", "version", "start", "n", "least"))
             .groupBy("doc", "version").agg(F.collect_set(F.struct("start", "n", "least")).alias("asked")))
    windows = scratch_table(docs.join(asked, ["doc", "version"]).dropDuplicates(["doc", "version"])
                            .select("doc", "version", "text", "asked")
                            .mapInArrow(_windows(window), "least long, hash long, doc long, version long, start long"),
                            "windows")
    release(spark)
    firsts = scratch_table(windows.groupBy("least", "hash").agg(
        F.min(F.struct("doc", "version", "start")).alias("first"), F.max("doc").alias("last"))
        .where(F.col("last") != F.col("first.doc")), "first-windows")
    single = (windows.join(firsts.drop("last"), ["least", "hash"]).where(F.col("doc") > F.col("first.doc"))
              .select("doc", "version", "start", F.lit(1).cast("long").alias("n"), F.col("first.doc").alias("owner"),
                      F.col("first.version").alias("owner_version"), F.col("first.start").alias("owner_start")))
    points = scratch_table(equal.union(single), "points")
    release(spark)

    # Only owners with many spans have copies; both sides are plain tables, so
    # adaptive execution can broadcast the few or split the hot.
    hot = scratch_table(points.groupBy("owner", "owner_version")
                        .agg(F.ceil(F.count(F.lit(1)) / SPANS_A_COPY).cast("int").alias("copies"))
                        .where("copies > 1"), "hot-owners")
    points = points.join(hot, ["owner", "owner_version"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    points = points.withColumn("copy", F.pmod(F.xxhash64("doc", "version"), F.col("copies")).cast("int"))
    later = points.groupBy("doc", "version").agg(
        F.collect_list(F.struct("start", "n", "owner", "owner_version", "copy")).alias("later"))
    own = points.groupBy(F.col("owner").alias("doc"), F.col("owner_version").alias("version")).agg(
        F.collect_set(F.struct(F.col("owner_start").alias("start"), "n")).alias("own"),
        F.max("copies").alias("copies"))
    needs = own.join(later, ["doc", "version"], "full")
    spans = (docs.join(needs, ["doc", "version"]).dropDuplicates(["doc", "version"])
             .select("doc", "version", "text", "own", "copies", "later")
             .mapInArrow(_spans(window), "owner long, owner_version long, copy int, role int, doc long, version long, "
                                         "start long, words binary"))
    return (spans.repartition("owner", "owner_version", "copy")
            .sortWithinPartitions("owner", "owner_version", "copy", "role")
            .mapInArrow(_read_shards(window), "doc long, version long, start long, end long"))


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space)."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
                        F.xxhash64("text").alias("version"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    spans = (repeated_spans(texts.drop("doc_id"), window).groupBy("doc", "version")
             .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    return (texts.join(spans, ["doc", "version"], "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
