"""Language identification by hierarchical discrimination.

A text is the L2-normalised square roots of its hashed byte-trigram counts.
The language family is predicted first, by one linear support vector machine
per family; within the family, one-versus-one linear support vector machines
separate each pair of languages and the most votes win (ties: the larger sum
of margins).  ``FAMILIES`` is the default tree; a language that it does not
name is a family of its own.

Training uses a bounded sample: at most ``per_language`` rows of each language,
chosen by the hash of their ids.  Every whole text is scored.

Defined cases: a null text and one without letters are ``und`` with score 0;
rows without a lang teach nothing; repeated rows are each scored; without
training rows everything is ``und``; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import crc32_remainder, lower_ascii, slices, utf8

FEATURES = 1 << 11
FOLDS, HELD_OUT = 3, 1
SALTS = 32
UNDETERMINED = "und"
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
            "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
            "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl")}


def trigrams(column: pa.Array) -> np.ndarray:
    """(texts x FEATURES) matrix of unit rows."""
    data, offsets = utf8(column)
    n = len(column)
    data = lower_ascii(data).astype(np.int64)
    out = np.zeros(n * FEATURES)
    if len(data) >= 3:
        text = np.repeat(np.arange(n), np.diff(offsets))
        whole = text[2:] == text[:-2]
        mixed = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * 0x9E3779B1 >> 12) & (FEATURES - 1)
        out = np.bincount((text[:-2] * FEATURES + mixed)[whole], minlength=n * FEATURES).astype(float)
    out = np.sqrt(out.reshape(n, FEATURES))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def linear_svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (the bias last) of a squared-hinge machine for y = +1/-1, the
    classes weighted alike; accelerated gradient over the whole sample."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = np.zeros(x.shape[1])
    ahead, t = w, 1.0
    rate = 1 / (4 * 2 + decay)  # rows have squared norm 2 at most
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (decay * ahead - 2 * x.T @ (c * y * slack))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, ahead = new, new + (last - 1) / t * (new - w)
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]]):
        of = {code: name for name, codes in families.items() for code in codes}
        self.tree: dict[str, list[str]] = {}
        for code in sorted(set(lang.tolist())):
            self.tree.setdefault(of.get(code, f"={code}"), []).append(code)
        family = np.array([of.get(code, f"={code}") for code in lang])
        self.names = sorted(self.tree)
        self.family = np.column_stack([linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.names]) \
            if len(self.names) > 1 else None
        self.pairs = {}
        for codes in self.tree.values():
            for a, b in combinations(codes, 2):
                at = (lang == a) | (lang == b)
                self.pairs[a, b] = linear_svm(x[at], np.where(lang[at] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the score is the product of the logistic margins
        by which the family and the language won."""
        n = len(x)
        x = np.column_stack([x, np.ones(n)])
        score = np.ones(n)
        chosen = np.zeros(n, dtype=int)
        if self.family is not None:
            margins = x @ self.family
            chosen = margins.argmax(axis=1)
            top = np.sort(margins, axis=1)
            score = 1 / (1 + np.exp(-2 * (top[:, -1] - top[:, -2])))
        lang = np.empty(n, dtype=object)
        for f, name in enumerate(self.names):
            rows = np.flatnonzero(chosen == f)
            codes = self.tree[name]
            votes = np.zeros((len(rows), len(codes)))
            least = np.full((len(rows), len(codes)), np.inf)
            for i, j in combinations(range(len(codes)), 2):
                m = x[rows] @ self.pairs[codes[i], codes[j]]
                votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                least[:, i] = np.minimum(least[:, i], m)
                least[:, j] = np.minimum(least[:, j], -m)
            best = votes.argmax(axis=1)
            lang[rows] = np.array(codes, dtype=object)[best]
            if len(codes) > 1:
                score[rows] *= 1 / (1 + np.exp(-4 * least[np.arange(len(rows)), best]))
        return lang, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = trigrams(part.column(0)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x), pa.list_(pa.float32()))],
                                             names=["lang", "x"])


def _predict(model: Hierarchy | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang = np.full(part.num_rows, UNDETERMINED, dtype=object)
                score = np.zeros(part.num_rows)
                known = np.array([has_letter(t) for t in part.column(1).to_pylist()])
                if model is not None and known.any():
                    lang, score = model.predict(trigrams(part.column(1)))
                    lang[~known], score[~known] = UNDETERMINED, 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])
    return predict


def _keep(model: Hierarchy | None):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text"))
                known = np.array([has_letter(t) for t in texts.to_pylist()])
                if model is None:
                    known[:] = False
                elif known.any():
                    known &= model.predict(trigrams(texts))[0] != UNDETERMINED
                yield part.filter(pa.array(known))
    return keep


def fit(docs: DataFrame, per_language: int, families: dict[str, tuple[str, ...]]) -> Hierarchy | None:
    keyed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
             .where(F.col("lang").isNotNull() & (crc32_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)))
    picked = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for group in (["lang", "salt"], ["lang"]):  # a task sees at most SALTS x per_language rows of a language
        order = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        picked = picked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    picked = picked.select("doc_id").distinct()
    # At most per_language ids for each language, so the broadcast is bounded.
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .join(F.broadcast(picked), "doc_id").select("text", "lang"))
    table = rows.mapInArrow(_vectors, "lang string, x array<float>").toArrow()
    if not table.num_rows:
        return None
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    return Hierarchy(x, np.array(table.column("lang").to_pylist()), families)


def identify(docs: DataFrame, per_language: int = 800, families: dict[str, tuple[str, ...]] | None = None
             ) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.  Rows whose
    crc32(doc_id) mod FOLDS is HELD_OUT are held out of training."""
    model = fit(docs, per_language, families or FAMILIES)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
            .select("doc_id", (crc32_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                    "lang_pred", "score"))


def identified_documents(docs: DataFrame, per_language: int = 800,
                         families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not ``und``."""
    return docs.mapInArrow(_keep(fit(docs, per_language, families or FAMILIES)), docs.schema)
