"""The registered queries of this subpackage and their DuckDB SQL.

Every query reads its whole table.  Where SQL cannot express a query the tests
hold it against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import fill_in_middle, line_rules
from linkloom.llm import license_scan as licenses
from linkloom.llm.common import table
from linkloom.llm.decontaminate import contaminated
from linkloom.llm.exact_dedup import exact_dedup
from linkloom.llm.language import identify
from linkloom.llm.ngram_join import ngram_join
from linkloom.llm.packing import pack_documents
from linkloom.llm.quality import quality_scores
from linkloom.llm.secret_scan import secret_scan
from linkloom.llm.substring_dedup import substring_dedup
from linkloom.llm.toxicity import toxicity_scores
from linkloom.llm.whitening import whiten


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"),
                          ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          json_path=public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents; the table has no paths, so a document's is source/lang/doc_id."""
    return licenses.license_scan(table(spark, sf_dir, "documents"),
                                 path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.round_trip(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_licenses": licenses.oracle_sql("concat_ws('/', source, lang, CAST(doc_id AS VARCHAR))"),
    "op11_quality_rules": line_rules.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
