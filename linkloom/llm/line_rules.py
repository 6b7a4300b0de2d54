"""Quality rules by cross-document line frequency, in DataFrame functions only.

Each text is cut into lines; a line is normalised (ASCII letters lower-cased,
digits to 0, runs of separators to one blank) and hashed.  For each host the
distinct documents that hold a line are counted.  A line is over the limits when
at least ``least_docs`` documents of the host, and more than ``percent_docs``
percent of them, hold it; such lines are removed.  A document is depleted, and
rejected, when fewer than ``least_words`` words or under ``percent_left`` percent of its
words are left.  Documents of one text are one document here, so copies alone never
turn a text's lines into boilerplate (exact deduplication is another operator).

The base rules look at one text: its words, symbols, repeated lines and repeated
windows of three words.  Windows are compared by content: they are sorted and each is held
against its neighbours, within the row.

Plan: one pass over the texts writes a slim table (counts, and a hash and word count
for each line).  Counting shuffles (host, line, text) hashes with map-side combining, so the
copies of a hot line or text meet combined.  The lines over the limits go back by a
join on (host, line), salted on both sides, because a hot line may be in a third of all
documents; each row then meets only its own removed lines.

Defined cases: a null text has no words and fails the base rules; a null host counts
as the empty name; lines without a word are never removed nor counted; rows that repeat a
doc_id are judged row by row; a null doc_id stays; an empty table gives an empty
result; other columns are ignored by ``quality_rules`` and kept by ``apply_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table, settled

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 16

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def normalised(words: Column) -> Column:
    """The normalised line of these words."""
    return F.translate(F.array_join(words, " "), _UPPER + "123456789", _UPPER.lower() + "0" * 9)


def _key(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(value.cast("binary"), 256)), 1, 16)


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _neighbours(items: Column, pair) -> Column:
    """``pair`` of each two neighbours of an array."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), pair)


def measured(docs: DataFrame, host: str | Column = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row in a struct ``kept_columns``, host, text_key,
    the five base measures, and lines: array of (at, line hash, words)."""
    host = F.col(host) if isinstance(host, str) else host
    names = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("kept_columns"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    # A line end is a separator, so the words of a text are those of its lines.
    rows = rows.withColumn("line_text", F.split("text", "\n"))
    rows = rows.withColumn("line_words", F.transform("line_text", words_of))
    rows = rows.select("*", F.flatten("line_words").alias("words"),
                       F.filter(F.arrays_zip(F.col("line_text").alias("text"), F.col("line_words").alias("words"),
                                             F.sequence(F.lit(0), F.size("line_text") - 1).alias("at")),
                                lambda s: F.size(s["words"]) > 0).alias("lines"))
    size, words = F.size("words"), F.col("words")
    windows = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), size).alias("b"),
                                   F.slice(words, F.lit(3), size).alias("c"),
                                   F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))).alias("at")),
                      F.lit(1), F.greatest(size - 2, F.lit(0)))
    rows = rows.select(
        "kept_columns", "host", _key(F.col("text")).alias("text_key"), size.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _without(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"),
        F.sort_array(windows).alias("windows"),
        F.transform("lines", lambda s: s["text"]).alias("full"),
        F.transform("lines", lambda s: F.struct(s["at"].alias("at"), _key(normalised(s["words"])).alias("line"),
                                                F.size(s["words"]).alias("words"))).alias("lines"))

    def repeats(x, y):
        same = (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.when(same, F.array(x["at"], y["at"]))

    rows = rows.withColumn("twice", F.filter(_neighbours(F.col("windows"), repeats), lambda p: p.isNotNull()))
    rows = rows.withColumn("twice", F.sort_array(F.array_distinct(F.flatten("twice"))))
    covered = F.aggregate(_neighbours(F.col("twice"), lambda x, y: F.least(y - x, F.lit(3))),
                          F.lit(0), lambda total, x: total + x)
    return rows.select(
        "kept_columns", "host", "text_key", "n_words", "word_chars", "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("twice") > 0, covered + 3).otherwise(0).cast("long").alias("n_repeat_words"),
        "lines")


def frequent_lines(rows: DataFrame, least_docs: int, percent_docs: int) -> DataFrame:
    """(host, line, n_docs) of the lines over the limits, from ``measured`` rows."""
    texts = rows.select("host", "text_key").distinct()
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = (rows.select("host", "text_key", F.explode(F.array_distinct(
        F.transform("lines", lambda s: s["line"]))).alias("line")).distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least_docs))
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)))
    return (lines.join(_salted(totals), ["host", "salt"])
            .where(F.col("n_docs") * 100 > F.col("host_docs") * percent_docs).select("host", "line", "n_docs"))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def judged(docs: DataFrame, host: str | Column, keep: list[str], least_docs: int, percent_docs: int,
           least_words: int, percent_left: int, percent_repeat: int) -> DataFrame:
    """Measured rows with n_lines_removed, n_words_left, removed (line positions),
    base_failed and kept."""
    rows = scratch_table(measured(docs, host, keep).withColumn("row", F.monotonically_increasing_id()), "line-measures")
    over = frequent_lines(rows, least_docs, percent_docs)
    hits = (rows.select("row", "host", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"),
                        F.explode("lines").alias("l"))
            .select("row", "host", "salt", "l.at", "l.line", "l.words")
            .join(_salted(over), ["host", "line", "salt"])
            .groupBy("row").agg(F.sum("words").alias("gone"), F.collect_list("at").alias("removed")))
    words = F.col("n_words")
    left = words - F.coalesce("gone", F.lit(0))
    base = (words < least_words) | (F.col("n_repeat_words") * 100 > words * percent_repeat)
    return rows.join(hits, "row", "left").select(
        "row", "kept_columns", *MEASURES, base.alias("base_failed"),
        (~base & (left >= least_words) & (left * 100 >= words * percent_left)).alias("kept"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_lines_removed"),
        left.alias("n_words_left"), "removed")


def quality_rules(docs: DataFrame, host: str | Column = "source", least_docs: int = 20, percent_docs: int = 1,
                  least_words: int = 50, percent_left: int = 50, percent_repeat: int = 50) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept,
    n_lines_removed, n_words_left."""
    def make() -> DataFrame:
        out = judged(docs, host, ["doc_id"], least_docs, percent_docs, least_words, percent_left, percent_repeat)
        return out.select("kept_columns.doc_id", *MEASURES, "base_failed", "kept", "n_lines_removed", "n_words_left")

    return settled(docs.sparkSession, "quality-rules", make)


def apply_rules(docs: DataFrame, host: str | Column = "source", least_docs: int = 20, percent_docs: int = 1,
                least_words: int = 50, percent_left: int = 50, percent_repeat: int = 50) -> DataFrame:
    """The kept rows of ``docs``, all columns, with the lines over the limits cut out of ``text``."""
    def make() -> DataFrame:
        rows = judged(docs, host, docs.columns, least_docs, percent_docs, least_words, percent_left,
                      percent_repeat).where("kept")
        rows = rows.select("kept_columns", "removed", F.split("kept_columns.text", "\n").alias("lines"))
        stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
        cut = F.transform(F.array(F.struct("lines", stay.alias("stay"))), lambda s: F.array_join(
            F.transform(s["stay"], lambda at: F.get(s["lines"], at)), "\n"))[0]
        text = F.when(F.col("removed").isNull(), F.col("kept_columns.text")).otherwise(cut)
        return rows.select(*(text.alias("text") if c == "text" else F.col(f"kept_columns.`{c}`")
                             for c in docs.columns))

    return settled(docs.sparkSession, "rule-kept", make)


#: DuckDB SQL of ``quality_rules`` with its default limits, over ``documents``.
ORACLE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t
               FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS u FROM d),
    g AS (SELECT r, unnest(range(1, len(u) - 1)) AS p, unnest(list_transform(range(1, len(u) - 1),
                 lambda p: u[p] || ' ' || u[p + 1] || ' ' || u[p + 2])) AS x FROM w WHERE len(u) > 2),
    g2 AS (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS n FROM g),
    rep AS (SELECT r, count(DISTINCT q) AS n_repeat FROM
            (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g2 WHERE n > 1) GROUP BY r),
    l0 AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
    l AS (SELECT r, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                 translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                          '[\x20\x09-\x0D]+', ' ', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
          FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY r),
    hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
    often AS (SELECT host, norm, count(DISTINCT t) AS n_docs FROM l GROUP BY host, norm),
    over_limit AS (SELECT o.host, o.norm FROM often o JOIN hosts h ON o.host = h.host
                   WHERE n_docs >= 20 AND n_docs * 100 > docs),
    gone AS (SELECT r, sum(n) AS words, count(*) AS lines FROM l
             JOIN over_limit o ON l.host = o.host AND l.norm = o.norm GROUP BY r),
    m AS (SELECT w.doc_id, CAST(len(u) AS BIGINT) AS n_words, CAST(length(array_to_string(u, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
                 CAST(coalesce(lines, 0) AS BIGINT) AS n_lines_removed,
                 CAST(len(u) - coalesce(words, 0) AS BIGINT) AS n_words_left
          FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
           NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50)
               AND n_words_left >= 50 AND n_words_left * 100 >= n_words * 50 AS kept,
           n_lines_removed, n_words_left
    FROM m"""
