"""Seen set (D8) lookups and inserts as joins.

The seen set is a table ``seen(domain string, url string)`` with unique
pairs.  Every operation is a set operation against it:

* membership flags are left joins on *distinct* keys (no row fan-out),
* bulk existence is a left-semi join,
* bulk insert status is "not stored and first in the batch", where "first"
  is the minimum ``seq`` per pair -- an aggregate with map-side partial
  combine, so one hot pair or domain never becomes one huge sort.

Lay the table out hash-partitioned (or bucketed) by ``domain`` on a cluster;
Spark then plans the lookups as co-partitioned joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERR_QUERY = 2
SALTS = 16      # tasks that share one domain's probes


class SeenSetError(ValueError):
    code = ERR_QUERY


def _keys(by: str) -> list[str]:
    if by == "both":
        return ["domain", "url"]
    if by in ("domain", "url"):
        return [by]
    raise SeenSetError(f"cannot look up by {by!r}: use domain, url or both")


def exists_flag(df: DataFrame, seen: DataFrame, by: str = "both",
                name: str = "known") -> DataFrame:
    """Add boolean ``name``: the key (domain, url or both) is stored."""
    keys = _keys(by)
    stored = seen.select(*keys).distinct().withColumn(f"_{name}", F.lit(True))
    salt = []
    if by == "domain" and "url" in df.columns:
        # One domain may hold a third of the probes: its probes are dealt over
        # SALTS tasks by their url, and each stored domain goes to all of them.
        salt = [f"_{name}_salt"]
        df = df.withColumn(salt[0], F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        stored = stored.withColumn(salt[0], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(stored, keys + salt, "left") \
        .withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit(False))).drop(f"_{name}", *salt)


def exists_bulk(seen: DataFrame, probes: DataFrame) -> DataFrame:
    """Each stored (domain, url) pair that appears among the probes, once.

    Every probe needs both parts; a probe missing one fails the query
    (error 2), as the reference does.
    """
    bad = (F.col("domain").isNull() | (F.col("domain") == "")
           | F.col("url").isNull() | (F.col("url") == ""))
    fail = F.raise_error(F.lit("a probe lacks its domain or its url"))
    # Both join keys carry the check, so the null filters Spark infers for
    # the join evaluate it instead of dropping the bad probe silently.
    checked = probes.select(F.when(bad, fail).otherwise(F.col("domain")).alias("domain"),
                            F.when(bad, fail).otherwise(F.col("url")).alias("url"))
    return seen.select("domain", "url").join(checked, ["domain", "url"], "left_semi")


def add_bulk_status(seen: DataFrame, pairs: DataFrame, seq: str = "seq") -> DataFrame:
    """Per input pair, ``inserted`` = not stored and first of its pair in
    ``seq`` order (later repeats in the same batch are False)."""
    first = pairs.groupBy("domain", "url").agg(F.min(seq).alias(seq))
    new = first.join(seen.select("domain", "url"), ["domain", "url"], "left_anti") \
        .withColumn("_new", F.lit(True))
    # The order is part of the key, so the rows of a hot pair are spread.
    return pairs.join(new, ["domain", "url", seq], "left").select(
        *pairs.columns, F.coalesce("_new", F.lit(False)).alias("inserted"))


def new_pairs(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """J4 rows that are inserted: distinct pairs not yet stored (left anti)."""
    return pairs.select("domain", "url").distinct() \
        .join(seen.select("domain", "url"), ["domain", "url"], "left_anti")


def add_single(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Like ``new_pairs`` but a pair that is already stored or repeated
    fails the query (key constraint)."""
    counted = pairs.groupBy("domain", "url").agg(F.count(F.lit(1)).alias("_n"))
    stored = seen.select("domain", "url").withColumn("_stored", F.lit(True))
    j = counted.join(stored, ["domain", "url"], "left")
    return j.select(
        F.when(F.col("_stored").isNotNull() | (F.col("_n") > 1),
               F.raise_error(F.concat(F.lit("UNIQUE constraint failed: "),
                                      F.col("domain"), F.lit(" "), F.col("url"))))
        .otherwise(F.col("domain")).alias("domain"), "url")


def parse_deny_list(text: str | None) -> list[str]:
    """Comma list, blank entries dropped."""
    return [d for d in (text or "").split(",") if d]


def deny_filter(df: DataFrame, deny) -> DataFrame:
    """Drop rows whose ``domain`` is on the deny list.

    A Python list becomes an ``IN`` list (a literal set of bounded size); a
    DataFrame list is a left anti join whose strategy Spark picks from its
    measured size.
    """
    if deny is None:
        return df
    if isinstance(deny, DataFrame):
        return df.join(deny.select(F.col(deny.columns[0]).alias("domain")).distinct(),
                       "domain", "left_anti")
    deny = list(deny)
    if not deny:
        return df
    return df.filter(~F.col("domain").isin(deny) | F.col("domain").isNull())


def write_seen_table(pairs: DataFrame, path: str, buckets: int | None = None,
                     name: str | None = None) -> DataFrame:
    """Store the seen set bucketed by (domain, url) and return it as a table.

    With as many buckets as ``spark.sql.shuffle.partitions``, the frontier's
    pair join and the J1-J4 pair lookups read it in place: only the batch side
    is shuffled, never the (large, growing) seen set.  The table lives at
    ``path`` (the shared checkpoint folder or a warehouse location).
    """
    spark = pairs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or "seen_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    pairs.select("domain", "url").repartition(n, "domain", "url").write.bucketBy(n, "domain", "url") \
        .option("path", path).saveAsTable(name)
    return spark.table(name)


def append_seen(additions: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append new pairs to the seen table; with ``batch_id`` the write
    replaces exactly that batch's folder, so a replayed batch is idempotent."""
    out = additions.select("domain", "url")
    if batch_id is None:
        out.write.mode("append").parquet(path)
    else:
        out.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")
