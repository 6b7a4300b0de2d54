"""Page analysis: text -> resolved links per page.

``analyze_pages`` is the analyser stage as one projection per page: links are
extracted, resolved against the page URL and normalised inside the page's own
row (array + higher-order functions), so page-level outcomes -- a page whose
link fails IDNA encoding is rejected whole -- need no shuffle.  ``explode_links``
then gives one row per (page, link).

Resolution rules (applied in order to each extracted link):

1. Split the link; ``match`` = link netloc equals the page netloc.
2. With no link netloc: a path holding ':' becomes the netloc as well (the
   path is kept); else a path holding both '/' and '.' is re-read as
   ``http://<path>`` (query and fragment are lost, so '/a.html' has an empty
   host); else the path is joined to the page path, the page netloc is taken
   and ``match`` is true.
3. Without ``match`` the netloc is IDNA-encoded; failure rejects the page.
4. Scheme: the link's; else the page's when ``match``; else ``http``.
5. Path and fragment are percent-encoded, the query likewise with '+' for
   spaces; the fragment is dropped by default, the query optionally.

Split and join follow Python's ``urllib.parse`` (which the reference calls)
down to its corners, checked by random tests against the stdlib: the join
re-reads the relative path (leading blanks dropped, a leading '//x' is a
netloc, ``;params`` of the last segment set aside), and a netloc with
unbalanced brackets or a bracketed host that is not an IPv6 literal is
refused, which rejects the page like an IDNA failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import rfc3986 as R
from linkloom.functions import urls as U
from linkloom.functions.idna import jvm_idna
from linkloom.functions.links import extract_links, extract_links_simple
from linkloom.sources.io import text_mode

# Error codes carried in the ``error`` column.
ERR_FILE_NOT_FOUND = 12
ERR_PARSE = 13


def _fields(p: Column, names) -> list[Column]:
    return [p[n].alias(n) for n in names]


def _stage(arr: Column, keep, fn) -> Column:
    """One per-link stage: keep some fields of each element, add new ones.
    Every lambda only reads fields of its lambda variable (cheap), so no
    expression is copied into another."""
    return F.transform(arr, lambda p: F.struct(*_fields(p, keep), *fn(p)))


def _after_empty_netloc(j: Column) -> Column:
    # '//' + '' netloc: urljoin continues with the path after it
    return F.when(j.startswith("//"), F.regexp_extract(j, r"^//(.*)$", 1)).otherwise(j)


def resolve_links(links: Column, o_scheme: Column, o_netloc: Column,
                  o_path: Column) -> Column:
    """U4 rules 1-2 and U5 over an array of links: struct(scheme, netloc,
    path, query, fragment, match, needs_idna) per link, before IDNA and
    encoding.  ``o_*`` are the page URL's parts (column references)."""
    split = F.transform(F.transform(links, U.clean), U.split_clean)
    base = ["scheme", "netloc", "path", "query", "fragment"]
    flags = _stage(split, base, lambda s: [
        ((s["netloc"] == "") & s["path"].contains(":")).alias("a"),
        ((s["netloc"] == "") & ~s["path"].contains(":") & s["path"].contains("/")
         & s["path"].contains(".")).alias("b"),
        ((s["netloc"] == "") & ~(s["path"].contains(":")
                                 | (s["path"].contains("/") & s["path"].contains("."))))
        .alias("c"),
        # urljoin re-reads the relative path, dropping leading blanks (only
        # joined paths need it)
        F.when((s["netloc"] == "") & ~s["path"].contains(":"), U.lstrip_c0(s["path"]))
        .alias("jpath")])
    parts = _stage(flags, ["c"], lambda s: [
        F.when(s["b"], F.lit("http")).when(s["scheme"] != "", s["scheme"])
        .when(s["c"] | (s["netloc"] == o_netloc), o_scheme).otherwise(F.lit("http"))
        .alias("scheme"),
        F.when(s["a"], s["path"]).when(s["b"], F.regexp_extract(s["path"], r"^([^/?#]*)", 1))
        .when(s["c"], o_netloc).otherwise(s["netloc"]).alias("netloc"),
        F.when(s["b"], F.regexp_extract(s["path"], r"^[^/?#]*(.*)$", 1))
        .otherwise(s["path"]).alias("rel"),
        F.when(s["c"], U.rel_path(_after_empty_netloc(s["jpath"]))).alias("rpath"),
        # a joined path starting '//x' is read by urljoin as netloc + path
        F.when(s["c"] & s["jpath"].startswith("//")
               & (F.regexp_extract(s["jpath"], r"^//([^/]*)", 1) != ""),
               U.netloc_relative(s["jpath"])).alias("nrel"),
        F.when(s["c"], U.rel_params(_after_empty_netloc(s["jpath"]))).alias("rparams"),
        F.when(s["b"], F.lit("")).otherwise(s["query"]).alias("query"),
        F.when(s["b"], F.lit("")).otherwise(s["fragment"]).alias("fragment"),
        (s["c"] | (s["netloc"] == o_netloc)).alias("match"),
        # the link's own split, or the re-split of case b, must accept its netloc
        (U.netloc_invalid(s["netloc"])
         | (s["b"] & U.netloc_invalid(F.regexp_extract(s["path"], r"^([^/?#]*)", 1))))
        .alias("split_bad")])
    parts = _stage(parts, ["scheme", "netloc", "rel", "rpath", "rparams", "nrel", "query",
                           "fragment", "match", "c", "split_bad"], lambda p: [
        F.when(p["c"] & ~p["rpath"].startswith("/"), U.join_segments(o_path, p["rpath"]))
        .alias("segs")])
    return _stage(parts, ["scheme", "netloc", "query", "fragment", "match", "split_bad"],
                  lambda p: [
        F.when(p["c"] & p["nrel"].isNotNull() & (o_path != ""), p["nrel"])
        .when(p["c"], U.join_path_from(o_path, p["rel"], p["rpath"], p["rparams"], p["segs"]))
        .otherwise(p["rel"]).alias("path"),
        (~p["match"] & ~U.is_ascii(p["netloc"])).alias("needs_idna")])


def finish_links(parts: Column, drop_fragments: bool, drop_query: bool) -> Column:
    """struct(url, domain, bad) per link."""
    hosted = F.transform(parts, lambda p: F.struct(
        p["scheme"].alias("scheme"),
        # null when IDNA fails
        F.when(p["match"], p["netloc"]).when(p["needs_idna"], jvm_idna(p["netloc"]))
        .otherwise(p["netloc"]).alias("host"),
        p["needs_idna"].alias("needs_idna"),
        (p["split_bad"] | (~p["match"] & ~p["needs_idna"] & U.host_label_error(p["netloc"])))
        .alias("label_bad"),
        U.percent_encode(p["path"]).alias("path"),
        (F.lit("") if drop_query else U.percent_encode(p["query"], plus_spaces=True))
        .alias("query"),
        (F.lit("") if drop_fragments else U.percent_encode(p["fragment"])).alias("fragment")))

    def one(h):
        host = F.coalesce(h["host"], F.lit(""))
        return F.struct(U.unsplit(h["scheme"], host, h["path"], h["query"], h["fragment"])
                        .alias("url"), host.alias("domain"),
                        (h["label_bad"] | (h["needs_idna"] & h["host"].isNull())).alias("bad"))
    return F.transform(hosted, one)


_COLUMN_MEMO: dict = {}


def _memo(key, build):
    """Build a large column expression once per process and parameters.

    Column objects are immutable, unresolved expression trees; building the
    resolution chain costs hundreds of JVM calls, which would otherwise be
    paid again for every query that analyses pages.
    """
    from pyspark import SparkContext
    gateway = SparkContext._gateway
    held, column = _COLUMN_MEMO.get(key, (None, None))
    if column is None or held is not gateway:
        column = build()
        _COLUMN_MEMO[key] = (gateway, column)
    return column


def analyze_pages(pages: DataFrame, url_col: str = "url", text_col: str = "html",
                  drop_fragments: bool = True, drop_query: bool = False,
                  exact: bool = True, keep: tuple[str, ...] = ("page_id",),
                  mode: str = "crawler") -> DataFrame:
    """Analyser stage (D5): one row per page.  ``mode`` is ``"crawler"`` (the rules
    above) or ``"rfc3986"`` (see ``_analyze_rfc3986``).

    Columns: ``keep`` columns, ``url``, ``domain`` (page netloc),
    ``urls: array<struct<url, domain>>``, ``n_links`` (L5) and ``error``
    (null when accepted; 12 no body or URL; 13 a host failed IDNA or a
    netloc of the page or a link is refused by the URL split).
    """
    extract = extract_links if exact else extract_links_simple
    keep = list(keep)
    if mode == "rfc3986":
        return _analyze_rfc3986(pages, url_col, text_col, drop_fragments, drop_query, extract, keep)
    if mode != "crawler":
        raise ValueError(f"unknown mode {mode!r}")
    df = pages.select(*keep, F.col(url_col).alias("url"),
                      text_mode(F.col(text_col)).alias("_text"),
                      U.clean(F.col(url_col)).alias("_cu"))
    links = _memo(("extract", exact), lambda: F.coalesce(
        extract(F.col("_text")), F.array().cast("array<string>")))
    df = df.select(*keep, "url", U.netloc(F.col("url")).alias("domain"),
                   links.alias("_links"),
                   (F.col("url").isNull() | F.col("_text").isNull()).alias("_missing"),
                   F.lower(F.regexp_extract("_cu", U._SPLIT, 1)).alias("_os"),
                   F.regexp_extract("_cu", U._SPLIT, 2).alias("_on"),
                   F.regexp_extract("_cu", U._SPLIT, 3).alias("_op"))
    df = df.withColumn("_origin_bad", F.coalesce(U.netloc_invalid(F.col("_on")), F.lit(False)))
    cols = [*keep, "url", "domain", "_missing", "_origin_bad", "_os", "_on", "_op"]
    df = df.select(*cols, _memo(("tag",), _tag_links).alias("_tagged"))
    df = df.select(*cols, _memo(("plain",), _plain_links).alias("_plain"),
                   F.filter("_tagged", lambda t: t["kind"] == 0).alias("_others"))
    done = _memo(("staged", drop_fragments, drop_query), lambda: finish_links(
        resolve_links(F.transform("_others", lambda t: t["l"]), F.col("_os"), F.col("_on"),
                      F.col("_op")), drop_fragments, drop_query))
    df = df.select(*cols, "_plain", "_others", done.alias("_done"))
    df = df.select(*cols[:5], _memo(("merge",), _merge_links).alias("_res"))
    return df.select(
        *keep, "url", "domain",
        F.transform("_res", lambda r: F.struct(r["url"].alias("url"),
                                               r["domain"].alias("domain"))).alias("urls"),
        F.size("_res").alias("n_links"),
        F.when(F.col("_missing"), F.lit(ERR_FILE_NOT_FOUND))
        .when(F.col("_origin_bad"), F.lit(ERR_PARSE))
        .when(F.exists("_res", lambda r: r["bad"]), F.lit(ERR_PARSE)).cast("int")
        .alias("error"))


def _analyze_rfc3986(pages: DataFrame, url_col: str, text_col: str, drop_fragments: bool, drop_query: bool,
                     extract, keep: list[str]) -> DataFrame:
    """Links resolved as RFC 3986 says (section 5.2, strict).  Links whose target is not http or
    https, has no host, or has a host that IDNA refuses are skipped, the page stays.  Path,
    query and fragment are percent-encoded (a space is %20 everywhere).  The columns are those of
    ``analyze_pages``; ``error`` is 12 (no body or URL) or null."""
    df = pages.select(*keep, F.col(url_col).alias("url"), text_mode(F.col(text_col)).alias("_text"),
                      U.clean(F.coalesce(F.col(url_col), F.lit(""))).alias("_cu"))
    df = df.select(*keep, "url", U.netloc(F.col("url")).alias("domain"), R.components(F.col("_cu")).alias("_base"),
                   (F.col("url").isNull() | F.col("_text").isNull()).alias("_missing"),
                   F.transform(F.coalesce(extract(F.col("_text")), F.array().cast("array<string>")), U.clean).alias("_links"))
    df = df.withColumn("_targets", R.resolve(F.col("_links"), F.col("_base")))
    hosted = F.transform(F.filter("_targets", lambda t: t["scheme"].isin("http", "https")
                                  & (F.coalesce(t["authority"], F.lit("")) != "")), lambda t: F.struct(
        t["scheme"].alias("scheme"),
        F.when(U.is_ascii(t["authority"]), F.when(~U.host_label_error(t["authority"]), t["authority"]))
        .otherwise(jvm_idna(t["authority"])).alias("authority"),
        U.percent_encode(t["path"]).alias("path"),
        F.when(F.lit(not drop_query), U.percent_encode(t["query"])).alias("query"),
        F.when(F.lit(not drop_fragments), U.percent_encode(t["fragment"])).alias("fragment")))
    df = df.withColumn("_hosted", F.filter(hosted, lambda t: t["authority"].isNotNull()))
    urls = F.transform("_hosted", lambda t: F.struct(R.recompose(t).alias("url"), t["authority"].alias("domain")))
    return df.select(*keep, "url", "domain", urls.alias("urls"), F.size("_hosted").alias("n_links"),
                     F.when(F.col("_missing"), F.lit(ERR_FILE_NOT_FOUND)).cast("int").alias("error"))


# Links that need no staged resolution (checked against urllib by the
# random tests):
# * a plain rooted path -- legal characters only, and none of '.', ':', ';',
#   '?', '#', '[', ']' -- becomes <page scheme>://<page netloc><path> on an
#   http(s) page with a host;
# * a plain absolute http(s) URL -- host of ASCII labels (1-63 letters,
#   digits, '-'), no port or user, path without '?', '#', '[', ']' -- stays
#   as it is with the scheme lower-cased, and its host is the domain.
_PLAIN_ROOTED = r"^/(?!/)[A-Za-z0-9\-_~/!$&'()*+,=@%]*$"
_PLAIN_ABSOLUTE = (r"^([Hh][Tt][Tt][Pp][Ss]?)://([A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.?)"
                   r"(/[A-Za-z0-9\-._~:/@!$&'()*+,;=%]*)?$")


def _tag_links() -> Column:
    plain_page = F.col("_os").isin("http", "https") & (F.col("_on") != "")
    return F.transform("_links", lambda l, i: F.struct(
        i.alias("i"), l.alias("l"),
        F.when(plain_page & l.rlike(_PLAIN_ROOTED), F.lit(1))
        .when(l.rlike(_PLAIN_ABSOLUTE), F.lit(2)).otherwise(F.lit(0)).alias("kind")))


def _plain_links() -> Column:
    return F.transform(F.filter("_tagged", lambda t: t["kind"] > 0), lambda t: F.struct(
        t["i"].alias("i"),
        F.when(t["kind"] == 1, F.concat(F.col("_os"), F.lit("://"), F.col("_on"), t["l"]))
        .otherwise(F.concat(F.lower(F.regexp_extract(t["l"], "^([A-Za-z]+)", 1)),
                            F.regexp_extract(t["l"], "^[A-Za-z]+(://.*)$", 1))).alias("url"),
        F.when(t["kind"] == 1, F.col("_on"))
        .otherwise(F.regexp_extract(t["l"], _PLAIN_ABSOLUTE, 2)).alias("domain"),
        F.lit(False).alias("bad")))


def _merge_links() -> Column:
    """Both parts back in link order (by position)."""
    rest = F.zip_with("_others", "_done", lambda t, r: F.struct(
        t["i"].alias("i"), r["url"].alias("url"), r["domain"].alias("domain"),
        r["bad"].alias("bad")))
    return F.transform(F.array_sort(F.concat(F.col("_plain"), rest)), lambda x: F.struct(
        x["url"].alias("url"), x["domain"].alias("domain"), x["bad"].alias("bad")))


def _keep_where(analyzed: DataFrame, cond: Column, cols) -> DataFrame:
    # A filter on ``error`` would be pushed below the projections that compute
    # it, and the optimizer would then derive every page's links twice (once
    # for the predicate).  Emitting the row from a generator keeps the
    # predicate where it is.
    return analyzed.select(F.inline(F.when(cond, F.array(F.struct(*cols)))))


def accepted(analyzed: DataFrame) -> DataFrame:
    """Pages without error (the ``error`` column dropped)."""
    return _keep_where(analyzed, F.col("error").isNull(),
                       [c for c in analyzed.columns if c != "error"])


def rejected(analyzed: DataFrame) -> DataFrame:
    return _keep_where(analyzed, F.col("error").isNotNull(), analyzed.columns)


def explode_links(analyzed: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """L4: one row per (page, resolved link): ``page_url``, ``pos`` (0-based
    position among the page's links), ``url``, ``domain``."""
    return analyzed.select(*keep, F.col("url").alias("page_url"),
                           F.posexplode("urls").alias("pos", "_u")) \
        .select(*keep, "page_url", "pos", F.col("_u.url").alias("url"),
                F.col("_u.domain").alias("domain"))


def observe_links(analyzed: DataFrame, name: str = "links"):
    """L5 as job metrics: returns (DataFrame, Observation).  After the
    DataFrame's first action, ``observation.get`` holds pages, accepted
    pages, rejected pages and links -- gathered by the same job, no extra
    pass over the data."""
    from pyspark.sql import Observation
    obs = Observation(name)
    df = analyzed.observe(
        obs, F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("error").isNull(), 1)).alias("accepted"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("rejected"),
        F.sum(F.when(F.col("error").isNull(), F.col("n_links")).otherwise(0)).alias("links"))
    return df, obs
