"""URL split, resolve and normalise (U1-U10) as Spark column expressions.

Everything here is a built-in expression (regex, string, array and
higher-order functions) except the IDNA encoding of non-ASCII host names,
which is an Arrow-batched pandas UDF over only those hosts.

Split follows Python's ``urllib.parse.urlsplit``: leading C0 controls and
spaces are dropped, tab/CR/LF removed anywhere, the scheme is the text before
the first ':' when it starts with an ASCII letter and holds only letters,
digits, '+', '-' and '.', and is lower-cased; the netloc follows '//' up to
the first '/', '?' or '#'; the fragment follows the first '#', the query the
first '?' before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.links import LEGAL_CLASS

# Schemes that take a '//' netloc when a URL is put back
# together (Python's urllib.parse.uses_netloc).
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]

_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#(.*))?$"
)
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_ALL_LEGAL = f"^[{LEGAL_CLASS}]*$"
_PIECES = f"([{LEGAL_CLASS}]+|[^{LEGAL_CLASS}])"
_HOST_LABEL_ERROR = r"^\.|\.\.|[^.]{64}"


def lit(v) -> Column:
    return F.lit(v)


def clean(url: Column) -> Column:
    """Drop tab/CR/LF anywhere and C0 controls or spaces at the start."""
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""),
                            r"^[\x00-\x20]+", "")


def split_url(url: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment) of a URL."""
    return split_clean(clean(url))


def split_clean(u: Column) -> Column:
    """U2 on an already cleaned URL (``u`` should be a cheap reference)."""
    g = lambda i: F.regexp_extract(u, _SPLIT, i)
    return F.struct(
        F.lower(g(1)).alias("scheme"), g(2).alias("netloc"), g(3).alias("path"),
        g(4).alias("query"), g(5).alias("fragment"))


def netloc(url: Column) -> Column:
    """Netloc of a URL (keeps user info and port; no case change)."""
    return F.regexp_extract(clean(url), _NETLOC, 1)


def percent_encode(s: Column, plus_spaces: bool = False) -> Column:
    """Escape every character outside the legal set as UTF-8 %XX.

    ``%`` is in the legal set, so existing escapes stay.  With
    ``plus_spaces`` a space becomes '+' (query strings).  Strings that are
    already legal take the fast path without splitting.
    """
    def piece(p):
        esc = F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
        if plus_spaces:
            esc = F.when(p == lit(" "), lit("+")).otherwise(esc)
        return F.when(p.rlike(_ALL_LEGAL), p).otherwise(esc)

    slow = F.array_join(F.transform(F.regexp_extract_all(s, lit(_PIECES), 1), piece), "")
    return F.when(s.rlike(_ALL_LEGAL), s).otherwise(slow)


def _dot_segments(segs: Column) -> Column:
    """Resolve '.' and '..' over an array of path segments (urljoin rules):
    '..' pops (even the root), '.' is skipped, a trailing dot segment leaves
    a trailing '/', an empty result is '/'.  ``segs`` is referenced once."""
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(acc, x):
        out = acc["out"]
        return F.struct(
            F.when(x == lit(".."), F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1))
                   .otherwise(out))
            .when(x == lit("."), out).otherwise(F.concat(out, F.array(x))).alias("out"),
            x.alias("last"))

    def finish(acc):
        out = F.when(acc["last"].isin(".", ".."), F.concat(acc["out"], F.array(lit(""))))\
            .otherwise(acc["out"])
        return F.regexp_replace(F.array_join(out, "/"), "^$", "/")

    return F.aggregate(segs, init, step, finish)


def join_segments(base: Column, rel: Column) -> Column:
    """Segments for ``urljoin`` of a relative path (no leading '/'): the base
    path without its last segment, then the relative segments.  ``base`` and
    ``rel`` should be cheap references (they are used more than once)."""
    parts = F.split(base, "/")
    parts = F.when(F.element_at(parts, -1) != lit(""), F.slice(parts, 1, F.size(parts) - 1))\
        .otherwise(parts)
    return F.concat(parts, F.split(rel, "/"))


_REL_PATH = r"^((?:.*/)?[^/;]*)"
_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"
_REL_PARAMS = r"^(?:.*/)?[^/;]*;([^/]*)$"


def lstrip_c0(s: Column) -> Column:
    """Drop leading C0 controls and spaces (how ``urljoin`` re-reads a path)."""
    return F.regexp_replace(s, r"^[\x00-\x20]+", "")


def netloc_relative(rel: Column) -> Column:
    """``urljoin`` of a path starting '//': the text up to the next '/' is
    a netloc and the rest a path whose last segment loses an empty
    ``;params`` (so '//x/a;' gives '//x/a')."""
    net = F.regexp_extract(rel, r"^//([^/]*)", 1)
    path = F.regexp_extract(rel, r"^//[^/]*(.*)$", 1)
    params = rel_params(path)
    return F.concat(lit("//"), net, rel_path(path),
                    F.when(params != lit(""), F.concat(lit(";"), params)).otherwise(lit("")))


def rel_path(rel: Column) -> Column:
    """The relative path without the ``;params`` of its last segment."""
    return F.when(rel.contains(";"), F.regexp_extract(rel, _REL_PATH, 1)).otherwise(rel)


def rel_params(rel: Column) -> Column:
    """The ``;params`` text of the last segment ('' when none)."""
    return F.when(rel.contains(";"), F.regexp_extract(rel, _REL_PARAMS, 1)).otherwise(lit(""))


def join_path_from(base: Column, rel: Column, rpath: Column, rparams: Column,
                   segs: Column) -> Column:
    """``urljoin(base_path, rel)`` given ``rpath``/``rparams`` (the rel
    path split at the last segment's ';') and ``segs =
    join_segments(base, rpath)``; all arguments are cheap references.  Like
    ``urljoin`` the params are set aside while segments resolve and put back
    only when non-empty."""
    n = F.size(segs)
    middle_kept = F.filter(segs, lambda x, i: (i == 0) | (i == n - 1) | (x != lit("")))
    rooted = rpath.startswith("/")
    resolved = F.when(rooted & ~rpath.rlike(_DOT_SEGMENT), rpath) \
        .when(rooted, _dot_segments(F.split(rpath, "/"))) \
        .otherwise(_dot_segments(middle_kept))
    with_params = F.when(rparams != lit(""), F.concat(resolved, lit(";"), rparams)) \
        .otherwise(resolved)
    return (F.when(base == lit(""), rel)
            .when(rel == lit(""), base)
            .when((rpath == lit("")) & (rparams == lit("")), base)
            .otherwise(with_params))


def unsplit(scheme: Column, net: Column, path: Column, query: Column,
            fragment: Column) -> Column:
    """``urlunsplit`` of five string columns (cheap references), built
    as one concatenation of four parts."""
    body = (F.when(net != lit(""), F.concat(
                lit("//"), net, F.when((path != lit("")) & ~path.startswith("/"), lit("/"))
                .otherwise(lit("")), path))
            .when(path.startswith("//") | ((scheme != lit("")) & scheme.isin(*USES_NETLOC)
                                           & ((path == lit("")) | path.startswith("/"))),
                  F.concat(lit("//"), path))
            .otherwise(path))
    return F.concat(F.when(scheme != lit(""), F.concat(scheme, lit(":"))).otherwise(lit("")),
                    body,
                    F.when(query != lit(""), F.concat(lit("?"), query)).otherwise(lit("")),
                    F.when(fragment != lit(""), F.concat(lit("#"), fragment)).otherwise(lit("")))


def endpoint(url: Column) -> Column:
    """struct(netloc, hostname, port, path, ssl, error) of a fetch URL.

    Port defaults to 80/443 by scheme; the path drops query and fragment and
    is '/' when empty; no host name gives error 13 (parse error).
    """
    s = split_url(url)
    hostport = F.regexp_extract(s["netloc"], r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$", 1)
    port_txt = F.regexp_extract(s["netloc"], r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*)(?::(.*))?$", 1)
    host = F.lower(F.regexp_replace(hostport, r"^\[|\]$", ""))
    digits = port_txt.rlike("^[0-9]{1,5}$")
    port_ok = (port_txt == lit("")) | (digits & (F.when(digits, port_txt.cast("int")) <= 65535))
    port = F.when(digits, port_txt.cast("int")) \
        .when(s["scheme"] == lit("http"), lit(80)).when(s["scheme"] == lit("https"), lit(443))
    bad = (host == lit("")) | ~port_ok
    return F.struct(
        s["netloc"].alias("netloc"),
        F.when(host != lit(""), host).alias("hostname"),
        F.when(port_ok, port).alias("port"),
        F.when(s["path"] == lit(""), lit("/")).otherwise(s["path"]).alias("path"),
        (s["scheme"] == lit("https")).alias("ssl"),
        F.when(bad, lit(13)).cast("int").alias("error"))


_HEX4 = "[0-9a-fA-F]{1,4}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_TAIL = f"(^|:)({_OCTET}\\.){{3}}{_OCTET}$"
_IPV6_FULL = f"^({_HEX4}:){{7}}{_HEX4}$"
_IPV6_GAP = f"^(({_HEX4}:)*{_HEX4})?::(({_HEX4}:)*{_HEX4})?$"
_IPV_FUTURE = r"^v[a-fA-F0-9]+\..+$"


def _ipv6_ok(addr: Column) -> Column:
    """IPv6 literal as Python's ``ipaddress`` reads it: eight hextets, or
    fewer around one '::'; an IPv4 dotted quad may stand for the last two;
    an optional non-empty ``%scope``."""
    scope = F.regexp_extract(addr, "%(.*)$", 1)
    has_scope = addr.contains("%")
    core = F.regexp_replace(addr, "%.*$", "")
    scope_ok = ~has_scope | ((scope != lit("")) & ~scope.contains("%"))
    tail_ok = ~core.contains(".") | core.rlike(_IPV4_TAIL)
    a = F.regexp_replace(core, _IPV4_TAIL, "$10:0")
    hextets = F.size(F.filter(F.split(a, ":"), lambda x: x != lit("")))
    shape = a.rlike(_IPV6_FULL) | (a.rlike(_IPV6_GAP) & (hextets <= 7))
    return scope_ok & tail_ok & shape


def netloc_invalid(net: Column) -> Column:
    """``urlsplit`` refuses a netloc with an unbalanced '[' or ']', or whose
    bracketed host is neither an IPv6 literal nor ``v<hex>.<text>``."""
    opened, closed = net.contains("["), net.contains("]")
    inner = F.regexp_extract(net, r"^[^\[]*\[([^\]]*)", 1)
    ok = F.when(inner.startswith("v"), inner.rlike(_IPV_FUTURE)).otherwise(_ipv6_ok(inner))
    return (opened != closed) | (opened & ~ok)


def host_label_error(host: Column) -> Column:
    """IDNA check for an ASCII host: an empty label (other than a trailing
    one) or a label of 64+ characters is an error."""
    return (host != lit("")) & host.rlike(_HOST_LABEL_ERROR)


def is_ascii(s: Column) -> Column:
    return ~s.rlike(r"[^\x00-\x7F]")
