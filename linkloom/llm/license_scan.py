"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

Every line or sentence of a text is a header candidate.  Its terms, without stop
words, are weighted by their inverse frequency among the templates (a term of
no template weighs most) and its cosine to each template is taken; the best one
at ``threshold`` or more names its license.  A document's own license is that of
its best line.  The whole document and its header block (the comments it begins
with, or its first paragraph), lines joined, are scored in the same way against
full license texts and notices.  A document is a *license file* when its whole
text reaches ``threshold``, which then names its license, or when at least
``file_share`` of its terms lie in license lines; it governs its directory.  A document without a
license of its own inherits from its nearest ancestor directory that has a
license file.

Only DataFrame functions run: the scan is one pass over lines and one over blocks
without a shuffle until the few license lines, and the terms of blocks that hold
enough of a template's terms to reach ``threshold``, are left, and the inheritance joins distinct directories, one
row for each, to the license files' directories.

Defined cases: a null text has no lines and a null path no directory; of several
license files in a directory the one with the best score, then the smallest
doc_id and path counts; rows that repeat doc_id, path and text get the same
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table
from linkloom.llm.license_texts import TEXTS

# License headers and notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Words that say nothing about a license.
STOP = ("a", "and", "any", "are", "as", "by", "can", "either", "for", "in", "into", "is", "it", "may", "no", "not",
        "of", "or", "that", "the", "this", "to", "under", "with", "you")
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
BREAK = "\n|[.!?] "
#: The comments a text begins with.
COMMENTS = (r'^(?:\s*+(?:/\*(?s:.*?)\*/|<!--(?s:.*?)-->|"""(?s:.*?)"""|(?:#|//|--|;|%)[^\n]*+))++')
BLANK_LINE = r"\n[ \t\r]*\n"


def _terms(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP]


def _weights(templates: tuple[tuple[str, str], ...] = TEMPLATES
             ) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float], float]]]:
    """(idf of the template terms, idf of other terms, [(license, products, norm)])."""
    counts = [(name, Counter(_terms(text))) for name, text in templates]
    idf = {t: math.log(1 + len(counts) / sum(t in c for _, c in counts)) for t in {t for _, c in counts for t in c}}
    vectors = [(name, {t: n * idf[t] for t, n in c.items()}) for name, c in counts]
    return idf, math.log(1 + len(counts)), [
        (name, {t: w * idf[t] for t, w in v.items()}, math.sqrt(sum(w * w for w in v.values()))) for name, v in vectors]


def _look_up(values: dict[str, float], term: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, term), F.lit(0.0))


def _total(terms: Column, value) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + value(t))


def _terms_of(text: str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})")), lambda t: ~t.isin(*STOP))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, computed once: a generator lets no predicate below it, where
    the optimizer would copy the expressions into the predicate."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(*df.columns, *(f"_made.{n}" for n in columns))


def license_lines(docs: DataFrame, threshold: float) -> DataFrame:
    """The lines (key columns, terms in the line, score, license) with a license."""
    idf, other, templates = _weights()
    vocabulary = sorted(idf)
    lines = docs.select("doc_id", "path", "version", F.explode(F.split("text", BREAK)).alias("line"))
    lines = _held(lines, terms=_terms_of("line")).drop("line")
    lines = _held(lines, known=F.filter("terms", lambda t: t.isin(*vocabulary)))
    # The cosine is at most the known share of the norm: a line with fewer known terms cannot reach it.
    lines = (lines.withColumn("unknown", F.size("terms") - F.size("known"))
             .where((F.size("known") > 0) & (F.pow(F.size("known"), 2) >= threshold ** 2 * F.col("unknown"))))
    square = _total(F.array_distinct("known"), lambda t: F.pow(
        F.size(F.filter("known", lambda k: k == t)) * _look_up(idf, t), 2)) + F.col("unknown") * other ** 2
    cosine = [F.struct(F.round(_total(F.col("known"), lambda t, p=products: _look_up(p, t))
                               / (F.sqrt("square") * norm), 6).alias("score"), F.lit(name).alias("license"))
              for name, products, norm in templates]
    return (_held(_held(lines, square=square), best=F.array_max(F.array(*cosine)))
            .where(F.col("best.score") >= threshold)
            .select("doc_id", "path", "version", F.size("terms").alias("terms"), "best"))


def _fixed(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed values."""
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def license_blocks(docs: DataFrame, threshold: float) -> DataFrame:
    """The blocks (key columns, part: whole or header, score, license) with a license."""
    idf, other, templates = _weights(TEXTS)
    weight = [{t: p / idf[t] for t, p in products.items()} for _, products, _ in templates]

    def held(terms: str, among) -> Column:
        return F.expr(f"filter({terms}, t -> t IN ({', '.join(repr(t) for t in sorted(among))}))")

    def least(k: int) -> int:
        """By Cauchy's inequality a block that reaches the threshold holds at least so many of the terms."""
        total, n = 0.0, 0
        for w in sorted(weight[k].values(), reverse=True):
            if total >= (threshold * templates[k][2]) ** 2 * (1 - 1e-9):
                break
            total, n = total + w * w, n + 1
        return n

    def reaches(k: int) -> Column:
        """Exact: a block's cosine is at most the norm of the template's terms that it holds, over the template's."""
        squares = ", ".join(f"{t!r}, {w * w!r}D" for t, w in sorted(weight[k].items()))
        among = ", ".join(repr(t) for t in sorted(weight[k]))
        total = F.expr(f"aggregate(filter(known, t -> t IN ({among})), 0D, "
                       f"(a, t) -> a + coalesce(try_element_at(map({squares}), t), 0D))")
        return ((F.size(held("known", weight[k])) >= least(k))
                & (total >= (threshold * templates[k][2]) ** 2 * (1 - 1e-9)))

    enough = [reaches(k) for k in range(len(templates))]
    some = enough[0]
    for e in enough[1:]:
        some = some | e
    comments = F.regexp_extract("text", COMMENTS, 0)
    header = (F.when(comments != "", comments)
              .when(F.col("text").rlike(BLANK_LINE), F.split("text", BLANK_LINE, 2)[0]))
    key = ["doc_id", "path", "version", "part"]
    blocks = (docs.select("doc_id", "path", "version", F.explode(F.create_map(
        F.lit("whole"), F.col("text"), F.lit("header"), header)).alias("part", "block")).where("block IS NOT NULL"))
    blocks = _held(blocks, terms=_terms_of("block")).drop("block")
    blocks = _held(blocks, held=F.size(held("terms", idf)))
    # Exact, from counts alone: h held terms have at most the square norm (h * most)^2, u others have at least
    # u * other^2, and the cosine is at most the held part of the norm over the whole norm.
    most = max(idf.values())
    room = (1 - threshold ** 2) * most ** 2 / (threshold ** 2 * other ** 2) * (1 + 1e-9)
    blocks = blocks.where((F.col("held") >= min(map(least, range(len(templates)))))
                          & (F.pow("held", 2) * room >= F.size("terms") - F.col("held")))
    blocks = _held(blocks, known=held("array_distinct(terms)", idf))
    counts = scratch_table(
        blocks.where(some).select(*key, F.explode("terms").alias("term"))
        .groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n")), "license-terms")
    known = _fixed(docs, [{"term": t, "idf": w} for t, w in sorted(idf.items())], "term: string, idf: double")
    products = _fixed(docs, [{"template": k, "license": name, "term": t, "product": p / norm}
                             for k, (name, ps, norm) in enumerate(templates) for t, p in ps.items()],
                      "template: int, license: string, term: string, product: double")
    # Both tables are fixed values, so the broadcasts are bounded.
    norms = (counts.join(F.broadcast(known), "term", "left").groupBy(*key)
             .agg(F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("idf", F.lit(other)), 2))).alias("norm")).alias("a"))
    dots = (counts.join(F.broadcast(products), "term").groupBy(*key, "template", "license")
            .agg(F.sum(F.col("n") * F.col("product")).alias("dot")).alias("b"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    return (dots.join(norms, same).select(*(f"a.{k}" for k in key), F.struct(
                F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "license").alias("best"))
            .where(F.col("best.score") >= threshold))


def license_scan(docs: DataFrame, path: Column | str = "path", threshold: float = 0.7, file_share: float = 0.5
                 ) -> DataFrame:
    """One row per document: doc_id, path, license, basis (own, file,
    inherited or none), score, from_path (the license file inherited from)."""
    path = F.col(path) if isinstance(path, str) else path
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), "text",
                        F.xxhash64("text").alias("version"))
    key = ["doc_id", "path", "version"]
    lines = license_lines(texts, threshold)
    blocks = license_blocks(texts, threshold)
    # A license file is named by its whole text, else the best line or header names the license.
    own = (lines.select(*key, F.lit("line").alias("part"), "best", "terms")
           .union(blocks.select(*key, "part", "best", F.lit(0).alias("terms"))).groupBy(*key)
           .agg(F.max(F.when(F.col("part") == "whole", F.col("best"))).alias("as_file"),
                F.max("best").alias("best"), F.sum("terms").alias("in_lines"))
           .select(*key, F.coalesce("as_file", "best").alias("best"), F.col("as_file").isNotNull().alias("as_file"),
                   "in_lines"))
    words = F.coalesce(F.size(_terms_of("text")), F.lit(0))
    found = [F.col(f"k.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    known = scratch_table(
        texts.select(*key, words.alias("words"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).alias("k")
        .join(own.alias("o"), found, "left")
        .select("k.*", "o.best", (F.col("as_file") | (F.col("in_lines") >= file_share * F.col("words"))).alias("whole")),
        "licenses")
    files = (known.where("whole AND dir != ''").groupBy("dir")
             .agg(F.max_by(F.struct("best", "path"), F.struct(
                 F.col("best.score"), -F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("path"))).alias("file")))
    parts = F.split("dir", "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    ancestors = (known.where("best IS NULL AND dir != ''").select("dir").distinct()
                 .select(F.col("dir").alias("of"), depth.alias("depth"), parts.alias("parts"))
                 .select("of", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir")))
    inherited = scratch_table(ancestors.join(files, "dir").groupBy("of").agg(F.max_by("file", "depth").alias("file"))
                              .withColumnRenamed("of", "dir"), "inherited")
    return (known.join(inherited, "dir", "left")
            .select("doc_id", "path",
                    F.coalesce("best.license", "file.best.license").alias("license"),
                    F.when(F.col("whole"), "file").when(F.col("best").isNotNull(), "own")
                    .when(F.col("file").isNotNull(), "inherited").otherwise("none").alias("basis"),
                    F.coalesce("best.score", "file.best.score").alias("score"),
                    F.when(F.col("best").isNull(), F.col("file.path")).alias("from_path")))


def oracle_sql(path: str, threshold: float = 0.7, file_share: float = 0.5) -> str:
    """The scan of ``documents`` in DuckDB SQL, by joins of term tables.  It has
    the lines only: it equals the scan where no block reaches the threshold."""
    quoted = ", ".join("(%d, '%s', '%s')" % (i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    stop = ", ".join(f"'{s}'" for s in STOP)
    term = f"regexp_extract_all(lower({{}}), '{TERM}')"
    return f"""
    WITH template(id, license, txt) AS (VALUES {quoted}),
    tt AS (SELECT id, license, unnest({term.format('txt')}) AS term FROM template),
    tf AS (SELECT id, license, term, count(*) AS n FROM tt WHERE term NOT IN ({stop}) GROUP BY ALL),
    idf AS (SELECT term, ln(1 + {len(TEMPLATES)}.0 / count(*)) AS idf FROM tf GROUP BY term),
    norm AS (SELECT id, sqrt(sum((n * idf) ** 2)) AS norm FROM tf JOIN idf USING (term) GROUP BY id),
    d AS (SELECT row_number() OVER () AS r, doc_id, {path} AS path, text FROM documents),
    l AS (SELECT r, unnest(string_split_regex(text, '\\n|[.!?] ')) AS line FROM d),
    ln AS (SELECT row_number() OVER () AS k, r, line FROM l),
    lt AS (SELECT k, r, unnest({term.format('line')}) AS term FROM ln),
    lf AS (SELECT k, r, term, count(*) AS n FROM lt WHERE term NOT IN ({stop}) GROUP BY ALL),
    ll AS (SELECT k, r, sum(n) AS terms, sqrt(sum(CASE WHEN idf IS NULL THEN n * ln(1 + {len(TEMPLATES)}) ** 2
             ELSE (n * idf) ** 2 END)) AS norm FROM lf LEFT JOIN idf USING (term) GROUP BY ALL),
    c AS (SELECT lf.k, tf.id, tf.license, sum(lf.n * idf * tf.n * idf) AS dot
          FROM lf JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL),
    s AS (SELECT ll.r, ll.k, ll.terms, round(dot / (ll.norm * norm.norm), 6) AS score, license
          FROM c JOIN ll USING (k) JOIN norm USING (id)),
    b AS (SELECT r, k, any_value(terms) AS terms, max({{'score': score, 'license': license}}) AS best FROM s
          WHERE score >= {threshold} GROUP BY r, k),
    own AS (SELECT r, max(best) AS best, sum(terms) AS in_lines FROM b GROUP BY r),
    w AS (SELECT r, sum(CASE WHEN term NOT IN ({stop}) THEN 1 ELSE 0 END) AS words
          FROM (SELECT r, unnest({term.format("coalesce(text, '')")}) AS term FROM d) GROUP BY r),
    kn AS (SELECT d.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, best,
                  coalesce(in_lines >= {file_share} * coalesce(words, 0), false) AS whole
           FROM d LEFT JOIN own USING (r) LEFT JOIN w USING (r)),
    f AS (SELECT dir, arg_max({{'best': best, 'path': path}},
                              {{'a': best.score, 'b': -coalesce(doc_id, 9223372036854775807), 'c': path}}) AS file
          FROM kn WHERE whole AND dir != '' GROUP BY dir),
    i AS (SELECT kn.r, arg_max(f.file, length(f.dir)) AS file
          FROM kn JOIN f ON kn.dir = f.dir OR starts_with(kn.dir, f.dir || '/') GROUP BY kn.r)
    SELECT doc_id, path, coalesce(best.license, file.best.license) AS license,
           CASE WHEN whole THEN 'file' WHEN best IS NOT NULL THEN 'own' WHEN file IS NOT NULL THEN 'inherited'
                ELSE 'none' END AS basis,
           coalesce(best.score, file.best.score) AS score,
           CASE WHEN best IS NULL THEN file.path END AS from_path
    FROM kn LEFT JOIN i USING (r)"""
