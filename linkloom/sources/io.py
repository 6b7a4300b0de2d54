"""Sources and sinks.

* S1 seeds: a text file, one URL per line, stripped; ``domain`` = netloc.
  Blank lines are kept (empty url and domain), as the reference does.
* S2 pages: parquet ``pages(page_id, url, html)``, or a folder of stored
  bodies read whole (``wholetext``) with the file path as the URL key.
* S3 messages: newline-delimited UTF-8 JSON with the analysed-page schema.
* S7 fan-out: one analysed batch feeding two sinks without recomputing it.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.urls import netloc
from linkloom.session import reliable_checkpoint

# Python's str.strip() whitespace: ASCII whitespace, separators and the
# C0/C1 information separators.
_WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_STRIP = f"^[{_WS}]+|[{_WS}]+$"

ERR_PARSE = 13

LINK_STRUCT = T.StructType([T.StructField("url", T.StringType()),
                            T.StructField("domain", T.StringType())])

# Analysed page message.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("urls", T.ArrayType(LINK_STRUCT)),
])


def text_mode(body):
    """A stored body as the analyser reads it: text mode with universal
    newlines, so CRLF and a lone CR become LF.  Bodies without CR pass
    unchanged after one containment check."""
    return F.when(body.contains("\r"),
                  F.translate(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\r", "\n")) \
        .otherwise(body)


def strip(col):
    return F.regexp_replace(col, _STRIP, "")


def seeds_from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """S1 on a one-column frame of lines."""
    u = strip(F.col(col))
    return lines.select(u.alias("url"), netloc(u).alias("domain"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.text`` + strip + netloc."""
    return seeds_from_lines(spark.read.text(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as parquet (page_id, url, html).

    A table no larger than one scan split (``spark.sql.files.maxPartitionBytes``) is dealt over the
    cores, so that the per-page work of a small table uses them all; that bounds what is moved.  A
    larger table is scanned by its own splits.  Sizes come from the file listing: no job runs."""
    pages = spark.read.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if files.getContentSummary(place).getLength() > split:
        return pages
    return pages.repartition(spark.sparkContext.defaultParallelism)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """S2 for a folder of stored bodies: one row per file, ``url`` is the
    file path; a missing path fails the read (error 12 in the reference)."""
    return spark.read.option("wholetext", True).text(path) \
        .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def to_messages(analyzed: DataFrame) -> DataFrame:
    """S3: JSON text of each analysed page (url, domain, urls)."""
    return analyzed.select(F.to_json(F.struct("url", "domain", "urls")).alias("value"))


def parse_messages(lines: DataFrame, col: str = "value") -> DataFrame:
    """S3: ``message`` (null where the line is no JSON object of the D5 schema) and ``error`` (13 there)."""
    schema = T.StructType([*MESSAGE_SCHEMA, T.StructField("_line", T.StringType())])
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    good = F.col("_m").isNotNull() & F.col("_m._line").isNull()
    return lines.withColumn("_m", parsed).select(*lines.columns, F.when(good, F.struct(
        *(F.col(f"_m.{f.name}").alias(f.name) for f in MESSAGE_SCHEMA))).alias("message"),
        F.when(~good, F.lit(ERR_PARSE)).cast("int").alias("error"))


def _message_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def read_messages(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """S3: newline-delimited JSON messages with the D5 schema.  A malformed line fails
    the query; with ``malformed="reject"`` it is passed over (see ``rejected_messages``)."""
    if malformed not in ("fail", "reject"):
        raise ValueError(f"malformed is 'fail' or 'reject', not {malformed!r}")
    rows = parse_messages(_message_lines(spark, path))
    if malformed == "reject":
        return rows.where("error is null").select("message.*")
    fail = F.raise_error(F.concat(F.lit("malformed message (error 13): "), F.col("value")))
    return rows.select(F.when(F.col("error").isNull(), F.col("message")).otherwise(fail).alias("message")) \
        .select("message.*")


def rejected_messages(spark: SparkSession, path: str) -> DataFrame:
    """S3: the malformed lines (value, error 13)."""
    return parse_messages(_message_lines(spark, path)).where("error is not null").select("value", "error")


def write_messages(analyzed: DataFrame, path: str) -> None:
    analyzed.select("url", "domain", "urls").write.mode("append").json(path)


def fan_out(df: DataFrame, sinks: Iterable[Callable[[DataFrame], None]]) -> None:
    """Feed one result to several sinks.  The result is written once to
    the shared checkpoint folder (``checkpoint()``, which survives executor
    loss, unlike a cache) and each sink reads that copy."""
    saved = reliable_checkpoint(df)
    for sink in sinks:
        sink(saved)
