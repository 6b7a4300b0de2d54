"""Keyed streaming state with an initial state.

Two stateful steps of ``transformWithStateInPandas``, each started from stored tables:

1. *Pairs* -- keyed by (domain, salt), the salt a hash of the URL, so a domain that holds a third
   of all links is ``salts`` groups.  A map state holds the URLs met.  A batch's first row of
   each URL not met goes on; the least of a group is its candidate for "first URL of the domain".
2. *Domains* -- the candidates meet in one group a domain (at most ``salts`` rows a batch), whose
   value state says whether the domain is known.  The least candidate of an unknown domain gets
   priority 2.  All other rows pass by in groups of their own and get priority 3.

The initial state is a stored seen set: what it holds is met before the first row.  A restart
goes on from the query's checkpoint; the initial state is read for the first batch only.
State is in RocksDB, by key.  A map lookup costs a call to the JVM, so
``jobs.stored_frontier_batches`` (tables) is the form for large batches; this one answers
where each key's latency matters more.

Order within a batch is (seq, url); rows without URL or domain are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SALTS = 8
_MET = "domain string, salt int, seq long, url string, lead boolean"
_RANKED = "seq long, url string, domain string, fetch_priority int"


class MetPairs(StatefulProcessor):
    """First rows of the URLs that the group has not met."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._met = handle.getMapState("met", "url string", "met boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for chunk in rows:
            for url, seq in chunk.groupby("url")["seq"].min().items():
                first[url] = min(int(seq), first.get(url, int(seq)))
        new = sorted((seq, url) for url, seq in first.items() if not self._met.containsKey((url,)))
        for _, url in new:
            self._met.updateValue((url,), (True,))
        if new:
            out = pd.DataFrame(new, columns=["seq", "url"]).assign(domain=key[0], salt=key[1], lead=False)
            out.loc[0, "lead"] = True
            yield out[["domain", "salt", "seq", "url", "lead"]].astype({"salt": "int32"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for url in initialState["url"]:
            self._met.updateValue((url,), (True,))

    def close(self) -> None:
        pass


class RankedDomains(StatefulProcessor):
    """Priority 2 for the first URL of an unknown domain, 3 for the rest.  Lane 0 holds a
    domain's candidates; the other lanes decide nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1]:
            for chunk in rows:
                yield self._ranked(chunk)
            return
        held = pd.concat(list(rows)).sort_values(["seq", "url"], ignore_index=True)
        out = self._ranked(held)
        if not self._known.exists():
            self._known.update((True,))
            out.loc[0, "fetch_priority"] = 2
        yield out.astype({"fetch_priority": "int32"})

    @staticmethod
    def _ranked(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["seq", "url", "domain"]].assign(fetch_priority=3).astype({"fetch_priority": "int32"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._known.update((True,))

    def close(self) -> None:
        pass


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.where(F.col("domain").isNotNull() & F.col("url").isNotNull()) \
        .withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))


def _one_per_pair(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for c in chunks:
        yield c.sort_values("seq").drop_duplicates(["domain", "url"])


def met_pairs(candidates: DataFrame, seen: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Step 1: (domain, salt, seq, url, lead) of each pair's first row in the stream."""
    rows = _salted(candidates.select("seq", "url", "domain"), salts)
    rows = rows.mapInPandas(_one_per_pair, rows.schema)      # repeats of a chunk do not travel
    start = None if seen is None else _salted(seen.select("domain", "url").distinct(), salts).groupBy("domain", "salt")
    return rows.groupBy("domain", "salt").transformWithStateInPandas(
        MetPairs(), _MET, "append", "None", initialState=start)


def dedupe_keyed(links: DataFrame, seen: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Each (domain, url) of the stream once, without those of ``seen``."""
    return met_pairs(links.select(F.lit(0).cast("long").alias("seq"), "domain", "url"), seen, salts) \
        .select("domain", "url")


def priority_keyed(candidates: DataFrame, seen: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """T4: every new URL (seq, url, domain, fetch_priority) with priority 2 or 3, both from keyed state."""
    new = met_pairs(candidates, seen, salts)
    lane = F.when(F.col("lead"), 0).otherwise(F.col("salt") + 1).alias("lane")
    start = None if seen is None else seen.where(F.col("domain").isNotNull()).select(
        "domain", F.lit(0).alias("lane")).distinct().groupBy("domain", "lane")
    return new.select("domain", lane, "seq", "url").groupBy("domain", "lane").transformWithStateInPandas(
        RankedDomains(), _RANKED, "append", "None", initialState=start)
