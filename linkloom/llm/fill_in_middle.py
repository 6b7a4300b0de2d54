"""Fill-in-middle transformation by block rotation in place.

A text is cut into tokens (a word with the separators before it; separators at
the end are one token more).  Two hashed cuts make prefix, middle and suffix.
``<P>``, ``<M>`` and ``<S>`` are inserted before them in one bytearray, and the
blocks are exchanged where they lie, by rotations of three reversals each:

* psm, ``<P>prefix<S>suffix<M>middle``: the two blocks behind the prefix rotate;
* spm, ``<S>suffix<P>prefix<M>middle``: the whole buffer rotates.

``restored`` rotates back and takes the sentinels out, from output and form
alone.  A text that holds a sentinel stays plain, so the first ``<M>``, ``<P>`` or
``<S>`` found is the inserted one: a sentinel starts with its only ``<`` and ends
with its only ``>``, so none can arise across a seam.

The cuts fall on ASCII separators or text ends, so the UTF-8 bytes are moved as
they are.  Rows are handled one slice of a batch at a time; no shuffle.

Defined cases: a null or empty text has no tokens and is plain; a null doc_id is
hashed as the empty string; rows of one doc_id get the same hashes; equal cuts
give an empty middle; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import slices, utf8, word_bounds

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = 3

_MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                   ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_BACK = pa.schema([("doc_id", pa.int64()), ("restored", pa.string())])


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange buf[lo:mid] and buf[mid:hi] in place by three reversals."""
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        buf[a:b] = buf[a:b][::-1]


def arrange(text: bytes, a: int, b: int, form: str) -> bytearray:
    """The text with sentinels, middle text[a:b], in the order of ``form``."""
    buf = bytearray(text)
    buf[b:b] = SUFFIX
    buf[a:a] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = a + _MARK, b + 2 * _MARK
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restore(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    buf = bytearray(output)
    start = buf.index(SUFFIX) if form == "psm" else 0
    turn = buf.index(MIDDLE if form == "psm" else PREFIX)
    rotate(buf, start, turn, len(buf))
    suffix = len(buf) - (turn - start)
    middle = buf.index(MIDDLE)
    for at in (suffix, middle, 0):
        del buf[at:at + _MARK]
    return bytes(buf)


def _choices(doc_id: int | None, seed: int, n: int, rate: int, spm: int) -> tuple[int, int, str]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k:k + 4]) for k in range(0, 16, 4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    return low, high, form


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _transform(seed: int, rate: int, spm: int):
    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(part.column(1))
        starts, ends, first = word_bounds(data, off)
        tails = np.zeros(len(off) - 1, dtype=np.int64)
        full = off[1:] > off[:-1]
        worded = np.diff(first) > 0
        tails[full & ~worded] = 1
        tails[worded] = ends[first[1:][worded] - 1] < off[1:][worded]
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        held = data.tobytes()
        rows = []
        for i, doc_id in enumerate(part.column(0).to_pylist()):
            lo, hi = int(off[i]), int(off[i + 1])
            text, words = held[lo:hi], int(first[i + 1] - first[i])
            n = words + int(tails[i])
            low, high, form = _choices(doc_id, seed, n, rate, spm)
            if form == "plain" or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
                rows.append((doc_id, n, "plain", None, None, text))
                continue
            a, b = (lo if k == 0 else hi if k > words else int(ends[first[i] + k - 1]) for k in (low, high))
            rows.append((doc_id, n, form, int(chars[a] - chars[lo]), int(chars[b] - chars[a]),
                         bytes(arrange(text, a - lo, b - lo, form))))
        *short, output = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(short, _MADE)] + [_strings(list(output))], schema=_MADE)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield made(part)

    return transform


def _undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "output"):
            data, off = utf8(part.column(2))
            held, forms = data.tobytes(), part.column(1).to_pylist()
            texts = [restore(held[off[i]:off[i + 1]], form) for i, form in enumerate(forms)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _strings(texts)], schema=_BACK)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per document: doc_id, n (tokens), form (plain, psm, spm),
    prefix_chars and middle_chars (code points; null if plain), output.

    ``rate`` percent of the documents are transformed, ``spm`` percent of those
    with the suffix first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_transform(seed, rate, spm),
                           "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame) -> DataFrame:
    """doc_id and the exact text (``restored``), rebuilt from output and form."""
    return transformed.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output") \
        .mapInArrow(_undo, "doc_id long, restored string")


def round_trip(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of each output and of the text rebuilt from it."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                data, off = utf8(part.column(5))
                held, forms = data.tobytes(), part.column(2).to_pylist()
                outputs = [held[off[i]:off[i + 1]] for i in range(len(forms))]
                sums = ([hashlib.sha256(x).hexdigest() for x in outputs],
                        [hashlib.sha256(restore(x, f)).hexdigest() for x, f in zip(outputs, forms)])
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *map(pa.array, sums)], names=[
                    *part.schema.names[:5], "output_sha256", "restored_sha256"])

    return fill_in_middle(docs).mapInArrow(
        digests, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                 "output_sha256 string, restored_sha256 string")


#: DuckDB SQL of ``round_trip``; the restored text must be the text itself.
ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    k AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                 CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
                 greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                           OR h3 % 100 >= 50 THEN 'plain'
                      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
                 array_to_string(u[b + 1:], '') AS suf FROM c)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p"""
