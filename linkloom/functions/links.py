"""Link extraction from page text (L1-L3) as native Spark regex expressions.

The extraction is a left-to-right scan with two triggers:

* ``<a`` starts an *anchor run*: repeatedly, the letters ``h r e f =`` are
  found in order (a subsequence) before any ``>``; a quote must follow; the
  value runs to the next ``>``, ``"``, ``'`` or the end and that terminator is
  consumed.  The run ends when the letters are not found (the cursor goes back
  to the end of the last value) or when no quote follows ``=`` (the cursor
  stays after ``=``).  Matching is case sensitive and any tag whose name starts
  with ``a`` counts.
* ``h`` starts a *bare-link run*: repeatedly ``ttp``, then optionally ``s``,
  ``:``, ``//`` and then the longest run of RFC 3986 characters; the first
  character after them is consumed.  Whenever ``ttp`` follows again the run
  continues, so ``httpsttp://x`` yields ``http://x``.

Pass 1 cuts the page into runs with one regex (leftmost, non-overlapping
``regexp_extract_all``), pass 2 reads the link values out of each run.  Both
passes are plain Java regexes evaluated in the JVM, and the same two patterns
run unchanged in RE2 (DuckDB), which the oracle SQL uses.  A page's links are
a distinct set kept in order of first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a bare link may contain (RFC 3986 unreserved,
# reserved and '%'), as the body of a regex class.
LEGAL_CLASS = r"A-Za-z0-9\-._~:/?#\[\]@!$%&'()*+,;="

# 'h r e f =' as a subsequence that may not cross '>'.
_HREF_SUBSEQ = "[^>h]*h[^>r]*r[^>e]*e[^>f]*f[^>=]*="
_QUOTED_VALUE = "[\"']([^>\"']*)[>\"']?"
_QUOTED_VALUE_NC = "[\"'][^>\"']*[>\"']?"

ANCHOR_RUN = (
    f"<a(?:(?:{_HREF_SUBSEQ}{_QUOTED_VALUE_NC})+(?:{_HREF_SUBSEQ})?"
    f"|{_HREF_SUBSEQ})"
)
BARE_RUN = f"h(?:ttp(?:s?://[{LEGAL_CLASS}]*(?s:.)?|s:?|:)?)+"

# Pass 1: one pattern, group 1 is a whole run.
RUN_PATTERN = f"({ANCHOR_RUN}|{BARE_RUN})"
# The same for Java's engine.  Possessive quantifiers keep no way back, so a run
# of any length needs no stack; the runs are the same, since each class stops at
# the character that must follow and nothing follows a run.  A zero-width test of
# the trigger character lets the matcher skip every other position cheaply.
_HREF_JVM = _HREF_SUBSEQ.replace("*", "*+")
_QUOTED_JVM = "[\"'][^>\"']*+[>\"']?+"
RUN_PATTERN_JVM = (
    f"(?=[<h])(<a(?:(?:{_HREF_JVM}{_QUOTED_JVM})++(?:{_HREF_JVM})?+|{_HREF_JVM})"
    f"|h(?:ttp(?:s?://[{LEGAL_CLASS}]*+(?s:.)?+|s:?+|:)?+)++)"
)
# Pass 2 inside an anchor run: group 1 is one href value (may be empty).
ANCHOR_VALUE_PATTERN = f"{_HREF_SUBSEQ}{_QUOTED_VALUE}"
# Pass 2 inside a bare-link run: group 1 is 's://rest' or '://rest'.
BARE_VALUE_PATTERN = f"ttp(s?://[{LEGAL_CLASS}]+)"

# The single-pattern form without run re-entry (second href in a tag,
# 'httpsttp://').  Kept for comparison; it equals the two-pass form on
# documents without those constructs.
SIMPLE_PATTERN = (
    f"<a{_HREF_SUBSEQ}(?:{_QUOTED_VALUE})?"
    f"|(https?://[{LEGAL_CLASS}]*)(?s:.)?"
)


def link_runs(text: Column) -> Column:
    """Pass 1: array of runs (anchor runs start with '<', bare runs with 'h')."""
    return F.regexp_extract_all(text, F.lit(RUN_PATTERN_JVM), 1)


def links_in_run(run: Column) -> Column:
    """Pass 2 for one run: array of link strings (non-empty)."""
    anchor = F.filter(
        F.regexp_extract_all(run, F.lit(ANCHOR_VALUE_PATTERN), 1),
        lambda v: v != F.lit(""),
    )
    bare = F.transform(
        F.regexp_extract_all(run, F.lit(BARE_VALUE_PATTERN), 1),
        lambda v: F.concat(F.lit("http"), v),
    )
    return F.when(run.startswith("<"), anchor).otherwise(bare)


def extract_links(text: Column) -> Column:
    """L1: distinct links of a document, in order of first appearance."""
    runs = link_runs(text)
    return F.array_distinct(F.flatten(F.transform(runs, links_in_run)))


def extract_links_simple(text: Column) -> Column:
    """L1 without run re-entry (single regex, two groups)."""
    tags = F.filter(F.regexp_extract_all(text, F.lit(SIMPLE_PATTERN), 1),
                    lambda v: v != F.lit(""))
    bare = F.filter(F.regexp_extract_all(text, F.lit(SIMPLE_PATTERN), 2),
                    lambda v: ~v.isin("", "http://", "https://"))
    return F.array_distinct(F.concat(tags, bare))
