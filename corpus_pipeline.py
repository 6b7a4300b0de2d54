"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark
decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before it kept.  All but the last return the columns of ``docs``; the last
returns the packed pieces.  ``run`` writes each stage's result to the shared
folder and reads it again, so an executor lost in one stage never costs the
stages before it.  The kept documents:

* language ID drops those without a language (``und``: no letters or no text);
* exact dedup keeps the row of the smallest doc_id of each text, and one row
  where a row is repeated;
* the n-gram join (five words, 0.8) keeps one row of each component, that of the smallest doc_id;
* decontamination drops documents that hold a benchmark item;
* a null doc_id is larger than every number.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table
from linkloom.llm.decontaminate import clean_documents
from linkloom.llm.exact_dedup import exact_dedup
from linkloom.llm.language import identified_documents
from linkloom.llm.ngram_join import ngram_join
from linkloom.llm.packing import pack_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").alias("k")
    content = F.sha2(F.regexp_replace(F.coalesce("d.text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    # Rows that repeat id and text are combined before they travel.
    return (docs.alias("d").join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.kept_id"))
                                 & (content == F.col("k.text_sha256")))
            .select("d.*", F.col("k.text_sha256").alias("sha of the text"))
            .dropDuplicates(["doc_id", "sha of the text"]).drop("sha of the text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = ngram_join(docs, words=5, percent=80)
    # Rows are told apart by id and text: one id may have several texts, in several components.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = (joined.where("component is not null").groupBy("component").agg(first.alias("first"))
            .select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
            .unionByName(joined.where("component is null").select(F.col("doc_id").alias("kept_id"),
                                                                  F.col("text_key").alias("kept_key"))))
    return docs.alias("d").join(kept.distinct().alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.kept_id"))
                                & (F.xxhash64("d.text") == F.col("k.kept_key")), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          json_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the language model nor the tokenizer; tests/llm holds
#: the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
