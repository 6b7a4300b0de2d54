"""Crawl frontier (F1-F6) in set form.

The reference decides candidate by candidate against a mutable seen set.
Processed in (seq, url, domain) order, after the deny filter, that loop is
equivalent to:

    domain_known = domain stored   OR an earlier candidate had this domain
    url_known    = pair stored     OR an earlier candidate had this pair
    ignore       = domain_known AND url_known AND NOT (override OR recrawl)  (F1)
    add          = NOT url_known                                            (F2)
    publish      = add OR override OR recrawl          (when not ignored)
    priority     = 1 override | 2 domain unknown | 4 recrawl | 3 url unknown (F3)

because the first candidate of any pair is always added, and with it its
domain.  So only first occurrences matter, and those are minimum aggregates:

* ``pairs``: min(seq) per (domain, url) -- a hash aggregate with partial
  aggregation, so a domain holding a third of all rows is combined map-side
  (with override/recrawl candidates, min(seq) per combination of flags);
* ``doms``: min(first seq, url) per domain over ``pairs`` (one row per pair,
  already combined), minus stored domains -- names the one pair per new
  domain that gets priority 2;
* published = first occurrences of unstored pairs (priority 2 or 3, or 1/4
  from their own flags) plus every other override/recrawl candidate (1/4),
  repeated rows included.

The order is total: rows that agree in (seq, url, domain) follow their flags,
plain rows first, and the rows left equal are interchangeable.  Give ``seq`` as
a struct (message, position) to order the candidates of one message.

The joins are on (domain, url), on one-row-per-domain tables, or, for flagged
rows, on the whole order key, so a pair named by a third of all rows is spread
over its messages; nothing is windowed over a domain.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.seen import deny_filter


class FrontierResult(NamedTuple):
    published: DataFrame   # seq, url, domain, override, recrawl, fetch_priority, added
    additions: DataFrame   # domain, url: pairs to append to the seen set
    rejects: DataFrame     # candidates without url or domain


def priority(override: Column, domain_known: Column, recrawl: Column,
             url_known: Column) -> Column:
    """F3 (5 is unreachable for published rows)."""
    return (F.when(override, 1).when(~domain_known, 2).when(recrawl, 4)
            .when(~url_known, 3).otherwise(5)).cast("int")


def _normalise(cand: DataFrame, seq: str) -> DataFrame:
    cols = set(cand.columns)
    ov = F.coalesce(F.col("override").cast("boolean"), F.lit(False)) if "override" in cols \
        else F.lit(False)
    rc = F.coalesce(F.col("recrawl").cast("boolean"), F.lit(False)) if "recrawl" in cols \
        else F.lit(False)
    return cand.select(F.col(seq).alias("seq"), "url", "domain",
                       ov.alias("override"), rc.alias("recrawl"))


def _absent(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    # Rows of ``df`` whose keys are not in ``other``, written as an outer join
    # + null test: a left-anti join on grouping keys would be pushed below
    # the aggregates and stop the candidates' exchange from being reused.
    flag = other.select(*keys).distinct().withColumn("_present", F.lit(True))
    return df.join(flag, keys, "left").filter(F.col("_present").isNull()).drop("_present")


def frontier_step(cand: DataFrame, seen: DataFrame, deny=None, seq: str = "seq",
                  flagged: bool | None = None, domains: DataFrame | None = None) -> FrontierResult:
    """F4 over a batch of candidates.

    ``cand`` needs ``seq``, ``url``, ``domain`` and optionally
    ``override``/``recrawl``.  Candidates are processed in (seq, url, domain)
    order; a long ``seq`` keeps the per-pair aggregate a hash aggregate.
    ``seen`` is the stored (domain, url) table; ``domains``, where there is one,
    the table of its domains, which is then asked instead of all of ``seen``.
    ``flagged=False`` promises
    there are no override/recrawl rows (links read from pages), which skips
    the second pass over the candidates.
    """
    if flagged is None:
        flagged = "override" in cand.columns or "recrawl" in cand.columns
    c = _normalise(cand, seq)
    rejects = c.filter(F.col("url").isNull() | F.col("domain").isNull())
    c = deny_filter(c.filter(F.col("url").isNotNull() & F.col("domain").isNotNull()), deny)

    # First occurrence of every pair (within a pair, url and domain are fixed,
    # so of the order's tie-breakers only the flags need aggregating).
    if flagged:
        code = F.col("override").cast("int") * 2 + F.col("recrawl").cast("int")
        firsts = [F.min(F.when(code == i, F.col("seq"))).alias(f"_f{i}") for i in range(4)]
        pairs = c.groupBy("domain", "url").agg(*firsts) \
            .withColumn("first", F.least(*[F.col(f"_f{i}") for i in range(4)]))
        lowest = F.coalesce(*[F.when(F.col(f"_f{i}") == F.col("first"), F.lit(i)) for i in range(4)])
        pairs = pairs.select("domain", "url", "first", (lowest >= 2).alias("f_override"),
                             (lowest % 2 == 1).alias("f_recrawl"))
    else:
        pairs = c.groupBy("domain", "url").agg(F.min("seq").alias("first")).select(
            "domain", "url", "first", F.lit(False).alias("f_override"),
            F.lit(False).alias("f_recrawl"))
    stored = seen.select("domain", "url").withColumn("_pair_stored", F.lit(True))
    pairs = pairs.join(stored, ["domain", "url"], "left")

    # The first pair of every domain that is not stored.
    doms = pairs.groupBy("domain").agg(F.min(F.struct("first", "url")).alias("_d")) \
        .select("domain", F.col("_d.url").alias("url"))
    new_doms = _absent(doms, seen if domains is None else domains, ["domain"]).withColumn("_dom_first", F.lit(True))

    first_new = pairs.filter(F.col("_pair_stored").isNull()) \
        .join(new_doms, ["domain", "url"], "left")
    a = first_new.select(
        F.col("first").alias("seq"), "url", "domain",
        F.col("f_override").alias("override"), F.col("f_recrawl").alias("recrawl"),
        priority(F.col("f_override"), ~F.coalesce(F.col("_dom_first"), F.lit(False)),
                 F.col("f_recrawl"), F.lit(False)).alias("fetch_priority"),
        F.lit(True).alias("added"))
    additions = first_new.select("domain", "url")

    published = a
    if flagged:
        key = ["domain", "url", "seq", "override", "recrawl"]
        rows = c.filter(F.col("override") | F.col("recrawl")).groupBy(*key).agg(
            F.count(F.lit(1)).alias("_n"))
        fl = rows.join(a.select(*key, F.lit(1).alias("_taken")), key, "left")
        again = F.col("_n") - F.coalesce(F.col("_taken"), F.lit(0))
        b = fl.select("seq", "url", "domain", "override", "recrawl",
                      priority(F.col("override"), F.lit(True), F.col("recrawl"), F.lit(True))
                      .alias("fetch_priority"), F.lit(False).alias("added"),
                      F.explode(F.array_repeat(F.lit(1), again.cast("int"))).alias("_copy")).drop("_copy")
        published = a.unionByName(b)
    return FrontierResult(published, additions, rejects)


def page_candidates(analyzed: DataFrame, override: Column | None = None,
                    recrawl: Column | None = None) -> DataFrame:
    """Candidates from analysed pages (accepted rows), with ``seq`` = page_id,
    so the order is (page_id, url, domain).  Without flags, one per distinct
    link of a page -- later copies in the same page would be ignored anyway --
    deduplicated inside the page's own array: no shuffle.  With ``override``
    or ``recrawl`` (conditions on the page's columns) every link counts."""
    flags = [] if override is None and recrawl is None else [
        F.coalesce(F.lit(False) if x is None else x, F.lit(False)).alias(name)
        for name, x in (("override", override), ("recrawl", recrawl))]
    links = F.col("urls") if flags else F.array_distinct("urls")
    out = [F.col("_u.url").alias("url"), F.col("_u.domain").alias("domain")]
    return analyzed.select(F.col("page_id").alias("seq"), *flags, F.explode(links).alias("_u")) \
        .select("seq", *out, *(["override", "recrawl"] if flags else []))


def published_per_message(published: DataFrame) -> DataFrame:
    """number of published URLs per message (``seq`` = page_id)."""
    return published.groupBy(F.col("seq").alias("page_id")) \
        .agg(F.count(F.lit(1)).alias("published"))


def next_to_fetch(published: DataFrame, n: int) -> DataFrame:
    """the ``n`` first URLs in (fetch_priority, seq) order (a top-k)."""
    return published.orderBy("fetch_priority", "seq", "url", "domain").limit(n)
