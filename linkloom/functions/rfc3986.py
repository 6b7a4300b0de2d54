"""Reference resolution by RFC 3986, section 5 (U4 ``mode="rfc3986"``).

``resolve`` is the transform of section 5.2.2 (strict) over an array of references, in stages of
array functions within the page's row; a component that is there but empty ('g?') is told from
one that is not.  ``remove_dots`` is section 5.2.4, ``merge`` section 5.2.3.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.urls import split_clean

_HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_HAS_QUERY = r"^[^?#]*\?"
_DOTTED = r"(^|/)\.\.?(/|$)"


def components(u: Column) -> Column:
    """struct(scheme, authority, path, query, fragment) of a cleaned reference; scheme is '' and
    authority, query and fragment are null where they are undefined."""
    s = split_clean(u)
    return F.struct(s["scheme"].alias("scheme"), F.when(u.rlike(_HAS_AUTHORITY), s["netloc"]).alias("authority"),
                    s["path"].alias("path"), F.when(u.rlike(_HAS_QUERY), s["query"]).alias("query"),
                    F.when(u.contains("#"), s["fragment"]).alias("fragment"))


def remove_dots(path: Column) -> Column:
    """Section 5.2.4.  The segments are kept on a stack: '..' takes one off, down to an empty
    first segment (the root); a dot segment at the end leaves a '/'."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("last"))

    def step(held, x):
        kept = held["kept"]
        popped = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)) \
            .when(F.size(kept) == 1, F.array(F.lit(""))).otherwise(kept)
        return F.struct(F.when(x == "..", popped).when(x == ".", kept)
                        .otherwise(F.concat(kept, F.array(x))).alias("kept"), x.alias("last"))

    def finish(held):
        return F.array_join(F.when(held["last"].isin(".", ".."), F.concat(held["kept"], F.array(F.lit(""))))
                            .otherwise(held["kept"]), "/")

    return F.when(path.rlike(_DOTTED), F.aggregate(F.split(path, "/"), start, step, finish)).otherwise(path)


def resolve(references: Column, base: Column) -> Column:
    """Array of struct(scheme, authority, path, query, fragment): each cleaned reference resolved
    against ``base`` (a column reference to ``components`` of an absolute URL)."""
    parts = F.transform(references, components)

    def target(r):
        own, named, empty = r["scheme"] != "", r["authority"].isNotNull(), r["path"] == ""
        merged = F.when(base["authority"].isNotNull() & (base["path"] == ""), F.concat(F.lit("/"), r["path"])) \
            .otherwise(F.concat(F.regexp_extract(base["path"], "^(.*/)?", 0), r["path"]))
        path = F.when(own | named | r["path"].startswith("/"), r["path"]).when(empty, base["path"]).otherwise(merged)
        return F.struct(F.when(own, r["scheme"]).otherwise(base["scheme"]).alias("scheme"),
                        F.when(own | named, r["authority"]).otherwise(base["authority"]).alias("authority"),
                        path.alias("path"), (~empty | own | named).alias("dotted"),
                        F.when(own | named | ~empty | r["query"].isNotNull(), r["query"]).otherwise(base["query"])
                        .alias("query"), r["fragment"].alias("fragment"))

    return F.transform(F.transform(parts, target), lambda t: F.struct(
        t["scheme"].alias("scheme"), t["authority"].alias("authority"),
        F.when(t["dotted"], remove_dots(t["path"])).otherwise(t["path"]).alias("path"),
        t["query"].alias("query"), t["fragment"].alias("fragment")))


def recompose(t: Column) -> Column:
    """Section 5.3."""
    def part(before: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(before), value), F.lit(""))

    return F.concat(F.when(t["scheme"] != "", F.concat(t["scheme"], F.lit(":"))).otherwise(F.lit("")),
                    part("//", t["authority"]), t["path"], part("?", t["query"]), part("#", t["fragment"]))
