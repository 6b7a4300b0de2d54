"""IDNA host encoding (U6) for the hosts that need it.

ASCII hosts are checked natively (``urls.host_label_error``).  Non-ASCII
hosts go through the JVM's own IDNA 2003 implementation (``java.net.IDN``,
with unassigned code points allowed, as Python's codec allows them) via
``try_reflect`` -- no Python round trip.  Label separators are the four IDNA
dots; an empty label other than a trailing one is an error, checked
natively because the JVM accepts a lone separator.  The pandas UDF below
(the standard Python codec, memoised per Arrow batch) states the same
mapping and is used by the tests to check the JVM path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# IDNA label separators (full stop, ideographic full stop,
# full-width full stop, half-width ideographic full stop).
IDNA_DOTS = ".\u3002\uff0e\uff61"
_ALLOW_UNASSIGNED = 1


def jvm_idna(host: Column) -> Column:
    """IDNA ToASCII of a non-ASCII host in the JVM; null when it fails."""
    empty_label = F.regexp_replace(host, f"[{IDNA_DOTS}]", ".").rlike(r"^\.|\.\.")
    enc = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host,
                        F.lit(_ALLOW_UNASSIGNED))
    return F.when(~empty_label, enc)


def _encode_host(host: str, memo: dict) -> str | None:
    if host in memo:
        return memo[host]
    try:
        out = host.encode("idna").decode("ascii")
    except UnicodeError:
        out = None
    memo[host] = out
    return out


@pandas_udf(StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """The standard Python codec over a column of hosts (null on failure)."""
    memo: dict = {}
    return hosts.map(lambda h: None if h is None else _encode_host(h, memo))
