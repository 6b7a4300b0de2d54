"""Fetch results over stored responses (R1-R6), no network.

Sizes are bytes, so byte positions are taken on the body re-read as
ISO-8859-1 (one character per UTF-8 byte); ``locate``/``substring`` then count
bytes.  The reference reads a response line by line ('\\n'), so a cutoff
keeps the line that crossed the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import netloc

ERR_READ_CUTOFF = 11

# Size limits (bytes) of the reference's fetcher configuration.
MAX_RESPONSE_SIZE = 10485760
MAX_HEADER_SIZE = 524288


def as_bytes_text(s: Column) -> Column:
    """UTF-8 string -> string with one char per byte (ISO-8859-1 view)."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def body_md5(body: Column) -> Column:
    """MD5 hex of the body's UTF-8 bytes."""
    return F.md5(F.encode(body, "UTF-8"))


def body_cutoff(body: Column, max_bytes: int) -> Column:
    """struct(ok, kept_bytes).  Not ok when the bytes written reach
    ``max_bytes``; then the kept part ends at the first line end at or after
    the limit (or the end of the body)."""
    total = F.octet_length(body)
    # the byte view is built only for bodies over the limit
    nl = F.locate("\n", as_bytes_text(body), max(int(max_bytes), 1))
    kept = F.when(total < max_bytes, total) \
        .otherwise(F.coalesce(F.nullif(nl, F.lit(0)), total))
    return F.struct((total < max_bytes).alias("ok"), kept.cast("long").alias("kept_bytes"))


def split_response(raw: Column, method: Column | str = "GET") -> Column:
    """struct(header, body) of a raw response (ISO-8859-1 view).

    The header block ends at the first line that is exactly CRLF; a HEAD
    request has no body; no CRLF line means everything is header.
    """
    b = raw
    at0 = b.startswith("\r\n")
    pos = F.locate("\n\r\n", b)
    header = F.when(at0, F.lit("")).when(pos > 0, F.substring(b, F.lit(1), pos)) \
        .otherwise(b)
    body = F.when(at0, F.substring(b, F.lit(3), F.length(b))) \
        .when(pos > 0, F.substring(b, pos + 3, F.length(b))) \
        .otherwise(F.lit(""))
    m = F.lit(method) if isinstance(method, str) else method
    has_body = at0 | (pos > 0)
    return F.struct(header.alias("header"),
                    F.when(has_body & (m != F.lit("HEAD")), body).alias("body"))


# A status line: version, code 100-999, optional reason, set apart by blanks.
_STATUS = r"\A[ \t\x0B\f\r]*(HTTP/\S*)[ \t\x0B\f\r]+0*([1-9][0-9]{2})(?:[ \t\x0B\f\r][^\n]*)?\n?\z"
_VERSION = r"\AHTTP/(?:0\.9|1\..*)\z"
# Interim answers (100 and its headers, at most 100 lines) before the final one.
_INTERIM = (r"\A(?:[ \t\x0B\f\r]*HTTP/\S*[ \t\x0B\f\r]+0*100(?:[ \t\x0B\f\r][^\n]*+)?\n"
            r"(?:(?!\r?\n)[^\n]++\n){0,99}+(?:\r?\n|\z))++")
_LINE_ENDS = r"(?<=\n)|(?<=\r)(?!\n)"
_NAMED = r"\A[!-9;-~]*:|\A[ \t]|\AFrom "
MAX_HEADER_LINES = 100   # Fixed value: more header lines make a response invalid
MAX_LINE = 65536         # Fixed value: a longer line makes it invalid


def status_and_headers(header: Column) -> Column:
    """struct(headers_valid, http_code, headers map<string,string>).

    As Python's ``http.client`` reads a header block: interim 100 answers are
    passed over; the version must be ``HTTP/0.9`` or ``HTTP/1.x``; the headers
    end at the first blank line, or at a line that is neither a header nor a
    continuation; a line that starts with a blank continues the one before it;
    names are compared without case, and the first value of a name holds for
    every spelling of it.
    """
    final = F.regexp_replace(header, _INTERIM, "")
    lines = F.split(final, "\n")
    status_line = F.element_at(lines, 1)
    ended = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.concat(x, F.lit("\n")))
    blank = F.array_position(F.transform(ended, lambda x: x.isin("\n", "\r\n")), True)
    block = F.when(blank > 0, F.slice(ended, F.lit(1), F.greatest(blank.cast("int") - 1, F.lit(0)))).otherwise(ended)
    valid = (status_line.rlike(_STATUS) & F.regexp_extract(status_line, _STATUS, 1).rlike(_VERSION)
             & (F.length(status_line) < MAX_LINE) & (F.size(block) < MAX_HEADER_LINES)
             & ~F.exists(block, lambda x: F.length(x) > MAX_LINE))
    code = F.when(valid, F.regexp_extract(status_line, _STATUS, 2).cast("int"))
    pieces = F.filter(F.split(F.array_join(block, ""), _LINE_ENDS), lambda x: x != "")
    stop = F.array_position(F.transform(pieces, lambda x: x.rlike(_NAMED)), False)
    heads = F.filter(pieces, lambda x, i: (stop == 0) | (i + 1 < stop))

    def fold(acc, x):
        # '' stands for a line that is passed over, with its continuations.
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise("")
        goes_on = x.rlike(r"\A[ \t]")
        return (F.when(~goes_on, F.concat(acc, F.array(F.when(x.rlike(r"\A:|\AFrom "), "").otherwise(x))))
                .when(last == "", acc)
                .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))))

    folded = F.filter(F.aggregate(heads, F.array().cast("array<string>"), fold), lambda x: x != "")
    entries = F.transform(folded, lambda x: F.struct(
        F.regexp_extract(x, r"\A([^:]*):", 1).alias("key"),
        F.regexp_replace(F.regexp_replace(x, r"\A[^:]*:[ \t]*", ""), r"[\r\n]+\z", "").alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    firsts = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == F.lower(n)), 1)["value"].alias("value")))
    return F.struct(valid.alias("headers_valid"), code.alias("http_code"),
                    F.when(valid, F.map_from_entries(firsts)).alias("headers"))


def fetch_outcome(pages: DataFrame, max_response_size: int = MAX_RESPONSE_SIZE,
                  url_col: str = "url", body_col: str = "html",
                  keep: tuple[str, ...] = ("page_id",), path: Column | None = None,
                  code: Column | None = None) -> DataFrame:
    """R1-R3 over stored bodies (D3): success -> md5 and the status code; a body
    at or over the limit -> error 11 with the kept byte count.  ``path`` is where
    the body is stored (null if not given), ``code`` the stored status (null if
    not given: a body alone does not tell it)."""
    path = F.lit(None) if path is None else path
    code = F.lit(None) if code is None else code
    cut = body_cutoff(F.col(body_col), max_response_size)
    return pages.select(*keep, F.col(url_col).alias("url"),
                        netloc(F.col(url_col)).alias("domain"), cut.alias("_c"),
                        F.col(body_col).alias("_b"), path.cast("string").alias("path"),
                        code.cast("int").alias("_code")).select(
        *keep, "url", "domain", "path",
        F.col("_c.ok").alias("success"),
        F.when(~F.col("_c.ok"), F.lit(ERR_READ_CUTOFF)).cast("int").alias("error"),
        F.when(F.col("_c.ok"), body_md5(F.col("_b"))).alias("md5"),
        F.when(F.col("_c.ok"), F.col("_code")).alias("http_code"),
        F.col("_c.kept_bytes").alias("kept_bytes"))


def response_outcome(responses: DataFrame, max_response_size: int = MAX_RESPONSE_SIZE,
                     max_header_size: int = MAX_HEADER_SIZE, raw_col: str = "raw",
                     method_col: str | None = None,
                     keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """R2-R6 over raw responses (binary or ISO-8859-1 string): header split,
    header and body cutoffs, status and headers, md5 of the body bytes.
    A non-2xx status is still a success.  A response whose header block is
    invalid keeps its row: its body was read, so ``success`` holds, and
    ``headers_valid`` is false with a null code and null headers."""
    raw = F.col(raw_col)
    if dict(responses.dtypes)[raw_col] == "binary":
        raw = F.decode(raw, "ISO-8859-1")
    method = F.col(method_col) if method_col else F.lit("GET")
    parts = split_response(raw, method)
    df = responses.select(*keep, parts.alias("_p"))
    hdr_fail = F.length("_p.header") >= max_header_size
    body = F.coalesce(F.col("_p.body"), F.lit(""))
    body_fail = F.length(body) >= max_response_size
    sh = status_and_headers(F.col("_p.header"))
    ok = ~hdr_fail & ~body_fail
    return df.select(
        *keep, ok.alias("success"),
        F.when(~ok, F.lit(ERR_READ_CUTOFF)).cast("int").alias("error"),
        F.when(ok, F.md5(F.encode(body, "ISO-8859-1"))).alias("md5"),
        F.when(ok, sh["http_code"]).alias("http_code"),
        sh["headers_valid"].alias("headers_valid"),
        F.when(ok, sh["headers"]).alias("headers"),
        F.length("_p.header").cast("long").alias("header_bytes"),
        F.length(body).cast("long").alias("body_bytes"))


def stored_response(pages: DataFrame, body_col: str = "html", status: Column | None = None,
                    headers: Column | None = None) -> Column:
    """Raw HTTP/1.0 response text (ISO-8859-1 view) of a stored page body: the status line
    (``status`` is what follows the version), content type and length headers, further
    ``headers`` (each with its CRLF), CRLF, body."""
    b = as_bytes_text(F.col(body_col))
    status = F.lit("200 OK") if status is None else status
    headers = F.lit("") if headers is None else headers
    return F.concat(F.lit("HTTP/1.0 "), status, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n"
                    "Content-Length: "), F.length(b).cast("string"), F.lit("\r\n"), headers, F.lit("\r\n"), b)
