"""Secret scan with corpus-wide ownership frequency.

A scan of every whole text finds the base candidates (see ``KINDS``).  The
hashes of the candidate values are then counted over the corpus by distinct
repositories and distinct owners, and each candidate whose count decides it
gets one more span:

* ``copied``: the value has ``min_owners`` owners or more: a widely copied example;
* ``live``: the value belongs to one owner in one repository and looks like a
  real credential (letters and digits mixed, at least ``min_entropy`` bits a character).

The counts combine within each task before the shuffle, and the verdicts go
back over ``SALTS`` copies of each count, so a value that a third of all rows
hold is spread.

Defined cases: a null text is empty; a null repository or owner counts as one
value of its own; repeated rows are each scanned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table, slices

KINDS = ("assign", "access", "hex", "live", "copied")
SALTS = 16

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # the maximal runs of 32 or more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
_KEYWORD = re.compile("password|passwd|secret|token|api_?key")

_SPAN = "struct<start:int,kind:int,end:int>"
_SCANNED = (f"doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, "
            f"base_sha256 string, base array<{_SPAN}>, "
            "secrets array<struct<hash:long,start:int,end:int,live:boolean>>")


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end), by start, then kind."""
    out = []
    if _KEYWORD.search(text.lower()):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str, min_entropy: float) -> bool:
    if not (any(c.isalpha() for c in value) and any(c.isdigit() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= min_entropy


def _scan(min_entropy: float):
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    secret = pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("live", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, bases, secrets = ([], [], []), [], [], []
                for text in part.column(1).to_pylist():
                    found = base_spans(text or "")
                    for kind, column in enumerate(counts):
                        column.append(sum(f[1] == kind for f in found))
                    digests.append(hashlib.sha256(",".join(
                        f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in found).encode()).hexdigest())
                    bases.append([{"start": s, "kind": k, "end": e} for s, k, e, _, _ in found])
                    values = sorted({(s, e) for *_, s, e in found})
                    secrets.append([{
                        "hash": int.from_bytes(hashlib.blake2b(text[s:e].encode(), digest_size=8).digest(),
                                               "little", signed=True),
                        "start": s, "end": e, "live": looks_live(text[s:e], min_entropy)} for s, e in values])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(digests), pa.array(bases, pa.list_(span)), pa.array(secrets, pa.list_(secret))],
                    names=["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256",
                           "base", "secrets"])
    return scan


def secret_scan(docs: DataFrame, repository: str = "source", owner: str = "source", min_owners: int = 3,
                min_entropy: float = 3.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (``kind:start:end`` by start, then kind as listed in ``KINDS``)."""
    scanned = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                           F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
                           F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
               .mapInArrow(_scan(min_entropy), _SCANNED)
               .withColumn("row", F.monotonically_increasing_id()))
    scanned = scratch_table(scanned, "secrets")
    found = (scanned.where(F.size("secrets") > 0)
             .select("row", "repository", "owner", F.explode("secrets").alias("secret"))
             .select("row", "repository", "owner", "secret.*"))
    owners = (found.groupBy("hash", "repository", "owner").count()
              .groupBy("hash").agg(F.count_distinct("repository").alias("repositories"),
                                   F.count_distinct("owner").alias("owners")))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    judged = (found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
              .join(owners.select("*", copies), ["hash", "salt"])
              .withColumn("kind", F.when(F.col("owners") >= min_owners, KINDS.index("copied"))
                          .when((F.col("owners") == 1) & (F.col("repositories") == 1) & F.col("live"),
                                KINDS.index("live")))
              .where(F.col("kind").isNotNull())
              .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))
    return (scanned.join(judged, "row", "left")
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                    F.array_join(F.transform(every, lambda s: F.concat_ws(
                        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                        s["end"].cast("string"))), ",").alias("spans")))
