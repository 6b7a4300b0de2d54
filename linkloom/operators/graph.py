"""Domain link graph.

One row per (page, distinct target netloc): source is the page URL's netloc,
targets are the netlocs of the page's resolved links (re-read from the URL
string), ``observed`` is one timestamp per batch passed in as a parameter so a
rerun gives the same rows.  Self edges are kept, and the same edge coming from
another page is another row.  All per page, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import netloc


def domain_edges(analyzed: DataFrame, observed: int) -> DataFrame:
    """G1 + G2 over analysed (accepted) pages."""
    valid = analyzed.filter(F.col("url").isNotNull() & (F.size("urls") > 0))      # G1
    targets = F.array_distinct(F.transform("urls", lambda u: netloc(u["url"])))
    return valid.select(netloc(F.col("url")).alias("source"),
                        F.explode(targets).alias("target"),
                        F.lit(int(observed)).cast("long").alias("observed"))


def append_edges(edges: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append-only edge table.  With ``batch_id`` the write replaces exactly that
    batch's folder, so a replayed batch leaves no doubled edge (a table takes either
    numbered batches or plain appends)."""
    out = edges.select("source", "target", "observed")
    if batch_id is None:
        out.write.mode("append").parquet(path)
    else:
        out.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def read_edges(spark, path: str) -> DataFrame:
    """``SELECT source, target, observed``."""
    return spark.read.parquet(path).select("source", "target", "observed")
