"""Oracle SQL (DuckDB) for the named queries.

Each statement re-derives its answer from the raw tables in plain SQL, and
imports nothing from the engine: patterns, limits and lists are stated here
a second time, so an error in the engine's does not hide.  The URL rules are CASE
expressions over cut strings, encoding goes character by character, and the
frontier is in its *sequential* form (window ranks: first row of a pair / of a
domain in page order) rather than the aggregate form the Spark plan uses.
Non-ASCII IDNA and urlsplit's bracketed-host checks are not restated here (no
such hosts occur in the test tables); the unit tests check them against
Python's ``urllib``.
"""

from __future__ import annotations

# The queries' parameters and the rules' character sets and lists.
OBSERVED = 1_700_000_000
BODY_LIMIT = 16 * 1024
HEADER_LIMIT = 1024
TOP = 100
DENIED = ("ththre.example.com", "m.ththth.example.net")
URL_CHARS = "A-Za-z0-9._~:/?#@!$&()*+,;=%'" + r"\[\]\-"
HOSTED_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
                  "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
                  "git+ssh", "ws", "wss", "itms-services")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
BLANKS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}"
          r"\x{2029}\x{202F}\x{205F}\x{3000}")


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {s('[\\t\\r\\n]')}, '', 'g'), "
            f"{s('^[\\x00-\\x20]+')}, '')")


def part(x: str, i: int) -> str:
    """1 scheme, 2 netloc, 3 path, 4 query, 5 fragment of a URL, cut one after the other."""
    u = clean(x)
    if i == 1:
        return f"regexp_extract({u}, {s('^([A-Za-z][A-Za-z0-9+.-]*):')}, 1)"
    rest = f"regexp_replace({u}, {s(SCHEME)}, '')"
    if i == 2:
        return f"regexp_extract({rest}, '^//([^/?#]*)', 1)"
    tail = f"regexp_replace({rest}, '^//[^/?#]*', '')"
    return f"regexp_extract({tail}, " + {3: "'^[^?#]*', 0)", 4: "'^[^?#]*[?]([^#]*)', 1)",
                                         5: "'^[^#]*#(.*)$', 1)"}[i]


def netloc(x: str) -> str:
    return part(x, 2)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {s(f'^[{BLANKS}]+|[{BLANKS}]+$')}, '', 'g')"


def enc(x: str, plus: bool = False) -> str:
    blank = "WHEN c = ' ' THEN '+' " if plus else ""
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN "
            f"regexp_full_match(c, {s(f'[{URL_CHARS}]')}) THEN c {blank}"
            f"ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '')")


def path_of(x: str) -> str:
    """A path without the ';params' of its last segment."""
    return f"(regexp_extract({x}, '^(.*/)?', 0) || regexp_extract(regexp_extract({x}, '[^/]*$', 0), '^[^;]*', 0))"


def params_of(x: str) -> str:
    return f"regexp_extract(regexp_extract({x}, '[^/]*$', 0), '^[^;]*;(.*)$', 1)"


def dots(segs: str) -> str:
    folded = (f"list_reduce({segs}, lambda acc, x: CASE WHEN x = '..' THEN "
              f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc)-1] ELSE acc END) "
              f"WHEN x = '.' THEN acc ELSE list_append(acc, x) END, []::VARCHAR[])")
    fixed = (f"(CASE WHEN {segs}[len({segs})] IN ('.', '..') THEN list_append({folded}, '') "
             f"ELSE {folded} END)")
    return f"(CASE WHEN array_to_string({fixed}, '/') = '' THEN '/' ELSE array_to_string({fixed}, '/') END)"


def join_path(base: str, rel_raw: str) -> str:
    """urljoin(base, rel): the relative path is re-read (leading blanks
    dropped; '//x...' is a netloc; an empty '//' netloc is skipped)."""
    j0 = f"regexp_replace({rel_raw}, {s('^[\x00-\x20]+')}, '')"
    jnet = f"regexp_extract({j0}, {s('^//([^/]*)')}, 1)"
    rel = f"(CASE WHEN starts_with({j0}, '//') THEN regexp_extract({j0}, {s('^//(.*)$')}, 1) ELSE {j0} END)"
    rpath = path_of(rel)
    rparams = params_of(rel)
    npath = f"regexp_extract({j0}, {s('^//[^/]*(.*)$')}, 1)"
    nparams = params_of(npath)
    nrel = (f"('//' || {jnet} || {path_of(npath)} || "
            f"(CASE WHEN {nparams} <> '' THEN ';' || {nparams} ELSE '' END))")
    bs = f"string_split({base}, '/')"
    bparts = f"(CASE WHEN {bs}[len({bs})] <> '' THEN list_slice({bs}, 1, len({bs})-1) ELSE {bs} END)"
    segs0 = f"list_concat({bparts}, string_split({rpath}, '/'))"
    segs = f"list_filter({segs0}, lambda x, i: i = 1 OR i = len({segs0}) OR x <> '')"
    resolved = (f"(CASE WHEN starts_with({rpath}, '/') THEN {dots(f'string_split({rpath}, {s(chr(47))})')} "
                f"ELSE {dots(segs)} END)")
    return (f"(CASE WHEN {base} = '' THEN {rel_raw} WHEN {rel_raw} = '' THEN {base} "
            f"WHEN starts_with({j0}, '//') AND {jnet} <> '' THEN {nrel} "
            f"WHEN {rpath} = '' AND {rparams} = '' THEN {base} "
            f"WHEN {rparams} <> '' THEN {resolved} || ';' || {rparams} ELSE {resolved} END)")


def unsplit(sc: str, net: str, path: str, query: str, frag: str) -> str:
    schemes = ", ".join(map(s, HOSTED_SCHEMES))
    body = (f"(CASE WHEN {net} <> '' THEN '//' || {net} || (CASE WHEN {path} <> '' AND NOT "
            f"starts_with({path}, '/') THEN '/' || {path} ELSE {path} END) "
            f"WHEN starts_with({path}, '//') THEN '//' || {path} "
            f"WHEN {sc} <> '' AND {sc} IN ({schemes}) AND ({path} = '' OR starts_with({path}, '/')) "
            f"THEN '//' || {path} ELSE {path} END)")
    return (f"((CASE WHEN {sc} <> '' THEN {sc} || ':' || {body} ELSE {body} END) || "
            f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) || "
            f"(CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END))")


def extract(html: str) -> str:
    """All links of a text: runs that begin with '<a' or 'h', then the links of each run."""
    href = "[^>h]*h[^>r]*r[^>e]*e[^>f]*f[^>=]*="          # h r e f = in this order, before any '>'
    quoted = "[\"'][^>\"']*[>\"']?"
    anchors = f"<a(?:(?:{href}{quoted})+(?:{href})?|{href})"
    bare = f"h(?:ttp(?:s?://[{URL_CHARS}]*(?s:.)?|s:?|:)?)+"
    value = f"{href}[\"']([^>\"']*)[>\"']?"
    runs = f"regexp_extract_all({html}, {s(f'(?:{anchors}|{bare})')})"
    per = (f"list_transform({runs}, lambda r: CASE WHEN starts_with(r, '<') THEN "
           f"list_filter(regexp_extract_all(r, {s(value)}, 1), lambda v: v <> '') "
           f"ELSE list_transform(regexp_extract_all(r, {s(f'ttp(s?://[{URL_CHARS}]+)')}, 1), "
           f"lambda v: 'http' || v) END)")
    return f"flatten({per})"


# Pages -> links -> resolved links, as CTEs.
BASE_CTES = f"""
pl0 AS (
  SELECT page_id, url, html,
    {extract("replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS l0
  FROM pages
),
pl AS (
  SELECT page_id, url, html, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS links
  FROM pl0
),
lk AS (
  SELECT page_id, url AS page_url, unnest(links) AS link, generate_subscripts(links, 1) AS pos
  FROM pl
),
r1 AS (
  SELECT page_id, page_url, pos,
    lower({part('page_url', 1)}) AS os, {part('page_url', 2)} AS onet, {part('page_url', 3)} AS opath,
    lower({part('link', 1)}) AS ls, {part('link', 2)} AS ln, {part('link', 3)} AS lp,
    {part('link', 4)} AS lq
  FROM lk
),
r2 AS (
  SELECT *,
    (ln = '' AND contains(lp, ':')) AS case_a,
    (ln = '' AND NOT contains(lp, ':') AND contains(lp, '/') AND contains(lp, '.')) AS case_b,
    (ln = '' AND NOT contains(lp, ':') AND NOT (contains(lp, '/') AND contains(lp, '.'))) AS case_c
  FROM r1
),
r3 AS (
  SELECT page_id, page_url, pos,
    CASE WHEN (CASE WHEN case_b THEN 'http' ELSE ls END) <> '' THEN (CASE WHEN case_b THEN 'http' ELSE ls END)
         WHEN (case_c OR ln = onet) THEN os ELSE 'http' END AS sc,
    CASE WHEN case_a THEN lp WHEN case_b THEN regexp_extract(lp, '^([^/?#]*)', 1)
         WHEN case_c THEN onet ELSE ln END AS net,
    CASE WHEN case_b THEN regexp_extract(lp, '^[^/?#]*(.*)$', 1)
         WHEN case_c THEN {join_path('opath', 'lp')} ELSE lp END AS path,
    CASE WHEN case_b THEN '' ELSE lq END AS query,
    (case_c OR ln = onet) AS match
  FROM r2
),
res AS (
  SELECT page_id, page_url, pos,
    {unsplit('sc', 'net', enc('path'), enc('query', True), "''")} AS url,
    net AS domain,
    (NOT match AND net <> '' AND regexp_matches(net, '^[.]|[.][.]|[^.]{{64}}')) AS bad
  FROM r3
),
page_err AS (
  SELECT p.page_id,
    CASE WHEN p.url IS NULL OR p.html IS NULL THEN 12
         WHEN EXISTS (SELECT 1 FROM res WHERE res.page_id = p.page_id AND res.bad) THEN 13
    END AS error
  FROM pages p
),
acc AS (
  SELECT res.page_id, res.page_url, res.pos, res.url, res.domain FROM res
  JOIN page_err USING (page_id) WHERE page_err.error IS NULL
),
acc_pages AS (
  SELECT p.page_id, p.url FROM pages p JOIN page_err USING (page_id) WHERE page_err.error IS NULL
),
seen AS (
  SELECT {strip('url')} AS url, {netloc(strip('url'))} AS domain
  FROM pages WHERE starts_with(url, 'https:')
  UNION
  SELECT url, domain FROM acc WHERE domain <> '' GROUP BY url, domain HAVING count(*) > 1
)
"""


def with_base(body: str) -> str:
    return f"WITH {BASE_CTES.strip()},\n{body}"


def frontier_ctes(deny: list[str] | None = None) -> str:
    where = ""
    if deny:
        where = f"WHERE domain NOT IN ({', '.join(s(d) for d in deny)})"
    return f"""
cand AS (SELECT DISTINCT page_id, url, domain FROM acc {where}),
ranked AS (
  SELECT c.*,
    row_number() OVER (PARTITION BY domain, url ORDER BY page_id, url, domain) AS pr,
    row_number() OVER (PARTITION BY domain ORDER BY page_id, url, domain) AS dr,
    EXISTS (SELECT 1 FROM seen WHERE seen.domain = c.domain) AS dom_seen,
    EXISTS (SELECT 1 FROM seen WHERE seen.domain = c.domain AND seen.url = c.url) AS pair_seen
  FROM cand c
),
published AS (
  SELECT page_id, url, domain,
    CAST(CASE WHEN NOT dom_seen AND dr = 1 THEN 2 ELSE 3 END AS INTEGER) AS fetch_priority
  FROM ranked WHERE pr = 1 AND NOT pair_seen
)"""


def flagged_ctes(known: str) -> str:
    """The frontier's loop stated row by row: each candidate sees the stored
    pairs (``known``) and every candidate before it in the total order."""
    return f"""
fc AS (
  SELECT acc.page_id, acc.url, acc.domain, contains(page_url, '?') AS ov, contains(page_url, '#') AS rc
  FROM acc
),
fr AS (
  SELECT *,
    row_number() OVER (PARTITION BY domain, url ORDER BY page_id, ov, rc) > 1
      OR EXISTS (SELECT 1 FROM {known} k WHERE k.domain = fc.domain AND k.url = fc.url) AS uk,
    row_number() OVER (PARTITION BY domain ORDER BY page_id, url, ov, rc) > 1
      OR EXISTS (SELECT 1 FROM {known} k WHERE k.domain = fc.domain) AS dk
  FROM fc
)
SELECT page_id, url, domain,
  CAST(CASE WHEN ov THEN 1 WHEN NOT dk THEN 2 WHEN rc THEN 4 ELSE 3 END AS INTEGER) AS fetch_priority
FROM fr WHERE NOT uk OR ov OR rc"""


def fnv_hash(x: str) -> str:
    hx = f"hex(encode({x}))"
    return (f"list_reduce(list_transform(range(0, length({hx}), 2), "
            f"lambda i: ('0x' || substr({hx}, i + 1, 2))::INTEGER), "
            f"lambda h, b: xor((h * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, "
            f"b::HUGEINT), 14695981039346656037::HUGEINT)")


def bloom_params(name: str, src: str) -> str:
    """Size for the rows of ``src``: items, m, k at error rate 0.01."""
    ln2 = "ln(CAST(2 AS DOUBLE))"
    return f"""
{name}_n AS (SELECT greatest(1000, 2 * count(*)) AS items FROM {src}),
{name}_m AS (SELECT items, CAST(floor(-(items * ln(CAST(0.01 AS DOUBLE))) / pow({ln2}, 2)) AS BIGINT) AS m,
  -(items * ln(CAST(0.01 AS DOUBLE))) / pow({ln2}, 2) AS mx FROM {name}_n),
{name} AS (SELECT items, m, mx, m / CAST(items AS DOUBLE) * {ln2} AS kx,
  CAST(floor(m / CAST(items AS DOUBLE) * {ln2}) AS INTEGER) AS k FROM {name}_m)"""


def bloom_bits_cte(name: str, src: str, params: str) -> str:
    """(key, idx) rows: the k bit indexes of each key of ``src(key)``."""
    return f"""
{name}_h AS (SELECT key, {fnv_hash('key')} AS h FROM {src} WHERE key IS NOT NULL),
{name}_i AS (SELECT key, h, m, unnest(range(0, k)) AS i FROM {name}_h, {params}),
{name} AS (
  SELECT key, CAST(((h // 4294967296) + i * (h % 4294967296) + i * i) % 4294967296 % m AS BIGINT) AS idx
  FROM {name}_i
)"""


def bloom_bits(n: str, p: str) -> str:
    return f"(-({n} * ln({p})) / pow(ln(CAST(2 AS DOUBLE)), 2))"


def bloom_decimals(p: str) -> str:
    return f"list_filter(range(0, 30), lambda d: round({p}, CAST(d AS INTEGER)) = {p})[1]"


def bloom_capacity() -> str:
    """Adds that fit, from max_n, p, mx, kx and digits: one more than the largest n at which an
    add still fits, found by halving (the rate rises with n)."""
    at = "(a + (CAST(1 AS BIGINT) << CAST(39 - s AS INTEGER)))"
    rate = f"pow(1 - exp(-kx * ({at} + 0.5) / (mx - 1)), kx)"
    return (f"(list_reduce(range(0, 40), lambda a, s: CASE WHEN {at} < max_n AND "
            f"round({rate}, CAST(digits AS INTEGER)) <= p THEN {at} ELSE a END, CAST(-1 AS BIGINT)) + 1)")


def rfc3986_ctes() -> str:
    """Section 5.2 of RFC 3986 over the extracted links, a link a row."""
    scheme = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
    rest = "(//([^/?#]*))?([^?#]*)([?]([^#]*))?"

    def parts(text: str, to: str) -> str:
        rx = s(scheme + rest)
        return (f"lower(regexp_extract({text}, {rx}, 1)) AS {to}s, regexp_extract({text}, {rx}, 2) <> '' AS {to}ha, "
                f"regexp_extract({text}, {rx}, 3) AS {to}a, regexp_extract({text}, {rx}, 4) AS {to}p, "
                f"regexp_extract({text}, {rx}, 5) AS {to}q")
    return f"""
ref AS (
  SELECT page_id, {parts(clean('page_url'), 'b')}, {parts(clean('link'), 'r')} FROM lk
),
tgt AS (
  SELECT page_id, CASE WHEN rs <> '' THEN rs ELSE bs END AS sc,
    CASE WHEN rs <> '' OR rha THEN ra ELSE ba END AS au,
    CASE WHEN rs <> '' OR rha OR rp <> '' OR rq <> '' THEN rq ELSE bq END AS qu,
    rs <> '' OR rha OR rp <> '' AS dotted,
    CASE WHEN rs <> '' OR rha OR starts_with(rp, '/') THEN rp WHEN rp = '' THEN bp
         WHEN bha AND bp = '' THEN '/' || rp ELSE regexp_extract(bp, '^(.*/)?', 0) || rp END AS pa
  FROM ref
),
seg AS (
  SELECT *, string_split(pa, '/') AS sg FROM tgt WHERE sc IN ('http', 'https') AND au <> ''
    AND NOT regexp_matches(au, '^[.]|[.][.]|[^.]{{64}}')
),
flat AS (
  SELECT *, CASE WHEN NOT dotted THEN sg ELSE list_reduce(sg, lambda a, x: CASE
      WHEN x = '..' THEN (CASE WHEN len(a) > 1 THEN a[:len(a) - 1] WHEN len(a) = 1 THEN [''] ELSE a END)
      WHEN x = '.' THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])) END
    || CASE WHEN dotted AND sg[len(sg)] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END AS kept
  FROM seg
)
SELECT page_id, sc || '://' || au || {enc("array_to_string(kept, '/')")} || {enc('qu')} AS url,
  au AS domain FROM flat"""


def _sql() -> dict[str, str]:
    out = {}
    out["links_extract"] = with_base("x AS (SELECT 1)\nSELECT page_id, unnest(links) AS link FROM pl")
    out["links_per_page"] = with_base(
        "x AS (SELECT 1)\nSELECT page_id, CAST(len(links) AS BIGINT) AS n_links FROM pl")
    out["links_resolved"] = with_base("x AS (SELECT 1)\nSELECT page_id, url, domain FROM acc")
    out["analyze_rejects"] = with_base(
        "x AS (SELECT 1)\nSELECT page_id, CAST(error AS INTEGER) AS error FROM page_err "
        "WHERE error IS NOT NULL")
    # The non-ASCII label is stated in its ASCII form.
    foreign = BASE_CTES.replace("FROM pages", "FROM foreign_pages").strip()
    foreign = f"""WITH foreign_pages AS (
  SELECT page_id, url, html || chr(10) || '<a href="http://' || CASE WHEN contains(url, '#')
    THEN 'no..' || {netloc('url')} || '/' ELSE 'xn--bcher-kva.' || {netloc('url')} || '/x' END || '">' AS html
  FROM pages),
{foreign}
"""
    out["foreign_links"] = foreign + "SELECT page_id, url, domain FROM acc"
    out["foreign_rejects"] = foreign + ("SELECT page_id, CAST(error AS INTEGER) AS error FROM page_err "
                                        "WHERE error IS NOT NULL")
    ep_host = (f"lower(regexp_replace(regexp_extract({part('url', 2)}, "
               f"{s(r'^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$')}, 1), {s(r'^\[|\]$')}, '', 'g'))")
    ep_port = f"regexp_extract({part('url', 2)}, {s(r'^(?:.*@)?(?:\[[^\]]*\]|[^:]*)(?::(.*))?$')}, 1)"
    out["url_parts"] = f"""
SELECT page_id, lower({part('url', 1)}) AS scheme, {part('url', 2)} AS netloc,
  {part('url', 3)} AS path, {part('url', 4)} AS query, {part('url', 5)} AS fragment,
  CASE WHEN {ep_host} <> '' THEN {ep_host} END AS hostname,
  CAST(CASE WHEN regexp_full_match({ep_port}, '[0-9]{{1,5}}') AND CAST({ep_port} AS INTEGER) <= 65535
            THEN CAST({ep_port} AS INTEGER)
            WHEN {ep_port} <> '' THEN NULL
            WHEN lower({part('url', 1)}) = 'http' THEN 80
            WHEN lower({part('url', 1)}) = 'https' THEN 443 END AS INTEGER) AS port,
  CASE WHEN {part('url', 3)} = '' THEN '/' ELSE {part('url', 3)} END AS request_path,
  lower({part('url', 1)}) = 'https' AS ssl
FROM pages"""
    out["seeds"] = f"SELECT {strip('url')} AS url, {netloc(strip('url'))} AS domain FROM pages"
    fr = frontier_ctes()
    out["frontier_step"] = with_base(fr.strip() + "\nSELECT * FROM published")
    out["frontier_deny"] = with_base(frontier_ctes(
        list(DENIED)).strip() + "\nSELECT * FROM published")
    out["frontier_additions"] = with_base(fr.strip() + "\nSELECT domain, url FROM published")
    out["seen_add_single"] = out["frontier_additions"]
    out["frontier_counts"] = with_base(
        fr.strip() + "\nSELECT page_id, count(*) AS published FROM published GROUP BY page_id")
    out["frontier_top"] = with_base(
        fr.strip() + f"\nSELECT * FROM published ORDER BY fetch_priority, page_id, url, domain "
        f"LIMIT {TOP}")
    probes = "probes AS (SELECT DISTINCT domain, url FROM acc)"
    out["seen_exists"] = with_base(probes + """
SELECT domain, url,
  EXISTS (SELECT 1 FROM seen WHERE seen.domain = probes.domain) AS domain_known,
  EXISTS (SELECT 1 FROM seen WHERE seen.url = probes.url) AS url_known,
  EXISTS (SELECT 1 FROM seen WHERE seen.domain = probes.domain AND seen.url = probes.url) AS pair_known
FROM probes""")
    out["seen_bulk_exists"] = with_base(probes + """
SELECT domain, url FROM seen WHERE EXISTS (
  SELECT 1 FROM probes WHERE probes.domain = seen.domain AND probes.url = seen.url
  AND probes.domain <> '')""")
    out["seen_add_status"] = with_base("""ranked AS (
  SELECT acc.*, row_number() OVER (PARTITION BY domain, url ORDER BY page_id, pos) AS rn,
    EXISTS (SELECT 1 FROM seen WHERE seen.domain = acc.domain AND seen.url = acc.url) AS stored
  FROM acc)
SELECT page_id, domain, url, (rn = 1 AND NOT stored) AS inserted FROM ranked""")
    out["domain_edges"] = with_base(f"""e AS (
  SELECT DISTINCT page_id, {netloc('page_url')} AS source, {netloc('url')} AS target FROM acc)
SELECT source, target, CAST({OBSERVED} AS BIGINT) AS observed FROM e""")
    lim = BODY_LIMIT
    cums = ("list_reduce(string_split(html, chr(10)), lambda acc, x: "
            "list_append(acc, acc[len(acc)] + strlen(x) + 1), [0::BIGINT])")
    code = ("CAST(CASE WHEN contains(url, '?') THEN 404 WHEN contains(url, '#') THEN 301 ELSE 200 END AS INTEGER)")
    out["fetch_outcome"] = f"""
SELECT page_id, url, {netloc('url')} AS domain, 'bodies/' || page_id AS path, strlen(html) < {lim} AS success,
  CAST(CASE WHEN strlen(html) >= {lim} THEN 11 END AS INTEGER) AS error,
  CASE WHEN strlen(html) < {lim} THEN md5(html) END AS md5,
  CASE WHEN strlen(html) < {lim} THEN {code} END AS http_code,
  CAST(CASE WHEN strlen(html) < {lim} THEN strlen(html)
       ELSE least(list_filter({cums}, lambda c: c >= {lim})[1], strlen(html)) END AS BIGINT)
    AS kept_bytes
FROM pages"""
    # Lengths of the header block: status line, two headers, and the long one.
    out["response_outcome"] = f"""WITH r AS (
  SELECT page_id, url, html, page_id % 10 = 7 AS odd, CAST(strlen('HTTP/1.0 ') + 2
    + CASE WHEN page_id % 10 = 7 THEN 3 WHEN contains(url, '?') THEN strlen('404 Not Found')
           WHEN contains(url, '#') THEN strlen('301 Moved Permanently') ELSE strlen('200 OK') END
    + strlen('Content-Type: text/html; charset=utf-8') + 2
    + strlen('Content-Length: ') + strlen(CAST(strlen(html) AS VARCHAR)) + 2
    + CASE WHEN page_id % 10 = 3 THEN strlen('X-Note: ') + 2000 + 2 ELSE 0 END AS BIGINT) AS header_bytes
  FROM pages),
t AS (SELECT *, header_bytes < {HEADER_LIMIT} AND strlen(html) < {lim} AS ok FROM r)
SELECT page_id, ok AS success, CAST(CASE WHEN NOT ok THEN 11 END AS INTEGER) AS error,
  CASE WHEN ok THEN md5(html) END AS md5,
  CASE WHEN ok AND NOT odd THEN {code} END AS http_code, NOT odd AS headers_valid,
  CASE WHEN ok AND NOT odd THEN 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN ok AND NOT odd THEN CAST(strlen(html) AS VARCHAR) END AS content_length,
  header_bytes, CAST(strlen(html) AS BIGINT) AS body_bytes
FROM t"""
    out["bloom_build"] = with_base(
        "items AS (SELECT DISTINCT url AS key FROM acc)," + bloom_params("par", "items") + ","
        + bloom_bits_cte("bits", "items", "par")
        + """,
wb AS (SELECT DISTINCT idx // 64 AS word, idx % 64 AS bit FROM bits),
ws AS (SELECT word, sum(CAST(1 AS HUGEINT) << CAST(bit AS INTEGER)) AS v FROM wb GROUP BY word)
SELECT CAST(word AS BIGINT) AS word,
  CAST(CASE WHEN v >= CAST(9223372036854775808 AS HUGEINT)
            THEN v - CAST(18446744073709551616 AS HUGEINT) ELSE v END AS BIGINT) AS bits
FROM ws""")
    out["bloom_probe"] = with_base(
        "items AS (SELECT DISTINCT url AS key FROM seen), probe_keys AS (SELECT DISTINCT url AS key FROM acc),"
        + bloom_params("par", "items") + "," + bloom_bits_cte("sbits", "items", "par") + ","
        + bloom_bits_cte("pbits", "probe_keys", "par")
        + """,
setbits AS (SELECT DISTINCT idx FROM sbits),
hits AS (
  SELECT pbits.key, bool_and(setbits.idx IS NOT NULL) AS in_bloom
  FROM pbits LEFT JOIN setbits ON pbits.idx = setbits.idx GROUP BY pbits.key)
SELECT key AS url, in_bloom, EXISTS (SELECT 1 FROM seen WHERE seen.url = hits.key) AS known
FROM hits""")
    # The rate rounded to two digits passes 0.01 up to 0.015, so the size is the
    # bound that is met first (overflow, code 4).
    rate = "pow(1 - exp(-kx * (n + 0.5) / (mx - 1)), kx)"
    out["bloom_stats"] = with_base("items AS (SELECT DISTINCT url AS key FROM acc),"
                                   + bloom_params("par", "items") + f""",
cnt AS (SELECT par.*, (SELECT count(*) FROM items) AS n FROM par)
SELECT m, k, n, round({rate}, 12) AS current_p_float, round({rate}, 2) AS current_p,
  CAST(items AS BIGINT) AS capacity, CAST(CASE WHEN n <= items THEN 0 ELSE 4 END AS INTEGER) AS status
FROM cnt""")
    out["bloom_pairs"] = with_base("""probes AS (SELECT DISTINCT domain, url FROM acc)
SELECT domain, url,
  EXISTS (SELECT 1 FROM seen WHERE seen.domain = probes.domain) AS domain_known,
  EXISTS (SELECT 1 FROM seen WHERE seen.domain = probes.domain AND seen.url = probes.url) AS pair_known
FROM probes""")
    out["bloom_bounds"] = with_base(f"""items AS (SELECT count(DISTINCT url) AS n FROM acc),
grid AS (SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(0.87 AS DOUBLE)), (1000, 0.01), (10000000, 0.001)) t(max_n, p)),
sized AS (SELECT *, {bloom_bits('max_n', 'p')} AS mx FROM grid),
hashed AS (SELECT *, floor(mx) / CAST(max_n AS DOUBLE) * ln(CAST(2 AS DOUBLE)) AS kx,
  {bloom_decimals('p')} AS digits FROM sized),
capped AS (SELECT *, {bloom_capacity()} AS capacity FROM hashed)
SELECT max_n, p, CAST(floor(mx) AS BIGINT) AS m, CAST(floor(kx) AS INTEGER) AS k, n, capacity,
  CAST(CASE WHEN n <= capacity THEN 0 WHEN capacity >= max_n THEN 4 ELSE 5 END AS INTEGER) AS status
FROM capped, items""")
    known = """SELECT DISTINCT url, EXISTS (SELECT 1 FROM seen WHERE seen.url = acc.url) AS known FROM acc"""
    out["bloom_blocked"] = out["bloom_layers_known"] = with_base("x AS (SELECT 1)\n" + known)
    # The layers fill one after the other, each up to its capacity.
    out["bloom_layers"] = with_base(f"""items AS (SELECT count(DISTINCT url) AS n FROM acc),
layers AS (SELECT CAST(i AS INTEGER) AS layer, CAST((n // 10 + 1) * pow(2, i) AS BIGINT) AS max_n,
  CAST(0.01 AS DOUBLE) * 0.5 * pow(CAST(0.5 AS DOUBLE), i) AS p, n AS items FROM items, range(0, 6) t(i)),
sized AS (SELECT *, {bloom_bits('max_n', 'p')} AS mx FROM layers),
hashed AS (SELECT *, floor(mx) / CAST(max_n AS DOUBLE) * ln(CAST(2 AS DOUBLE)) AS kx,
  {bloom_decimals('p')} AS digits FROM sized),
capped AS (SELECT *, {bloom_capacity()} AS capacity FROM hashed),
filled AS (SELECT *, coalesce(sum(capacity) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM capped)
SELECT layer, max_n, capacity, p, CAST(floor(mx) AS BIGINT) AS m, CAST(floor(kx) AS INTEGER) AS k,
  CAST(least(capacity, items - before) AS BIGINT) AS n,
  CAST(CASE WHEN items <= before + capacity THEN 0 WHEN capacity >= max_n THEN 4 ELSE 5 END AS INTEGER) AS status
FROM filled WHERE items > before""")
    out["seen_levelled"] = with_base("""met AS (
  SELECT domain, url, 0 AS batch_id FROM seen UNION ALL SELECT domain, url, 1 + page_id % 6 FROM acc)
SELECT domain, url, CAST(min(batch_id) AS BIGINT) AS batch_id FROM met GROUP BY domain, url""")
    out["frontier_queue"] = with_base(fr.strip() + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY fetch_priority, page_id, url, domain) AS rn FROM published)
SELECT CAST(1 + (rn - 1) // 100 AS INTEGER) AS take, page_id, url, domain, fetch_priority
FROM ordered WHERE rn <= 500""")
    out["links_rfc3986"] = with_base(rfc3986_ctes().strip())
    out["stream_frontier_stored"] = out["stream_priority_keyed"] = out["frontier_step"]
    out["stream_dedupe_keyed"] = out["frontier_additions"]
    out["frontier_flagged"] = with_base(flagged_ctes("seen").strip())
    out["stream_frontier_flagged"] = with_base(
        "nothing AS (SELECT * FROM seen WHERE false),\n" + flagged_ctes("nothing").strip())
    out["stream_domain_priority"] = with_base("""firsts AS (
  SELECT domain, url, min(page_id) AS page_id FROM acc GROUP BY domain, url)
SELECT page_id, url, domain, CAST(CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY page_id, url) = 1
  THEN 2 ELSE 3 END AS INTEGER) AS fetch_priority FROM firsts""")
    out["edges_log"] = out["domain_edges"]
    out["seen_log"] = with_base(fr.strip() + """
SELECT domain, url FROM seen UNION ALL SELECT domain, url FROM published""")
    out["messages_read"] = with_base(f"""per AS (
  SELECT p.page_id, {netloc('p.url')} AS source,
    (SELECT count(*) FROM acc WHERE acc.page_id = p.page_id) AS n_urls,
    (SELECT count(DISTINCT {netloc('acc.url')}) FROM acc WHERE acc.page_id = p.page_id) AS n_edges
  FROM acc_pages p)
SELECT source, count(*) AS n_messages, CAST(sum(n_urls) AS BIGINT) AS n_urls,
  CAST(sum(n_edges) AS BIGINT) AS n_edges FROM per GROUP BY source""")
    out["crawl_chain"] = """WITH RECURSIVE walk AS (
  SELECT CAST(1 AS INTEGER) AS round, page_id, url FROM pages WHERE page_id % 4 = 0 OR contains(url, '#')
  UNION ALL
  SELECT CAST(w.round + 1 AS INTEGER), p.page_id, p.url FROM walk w JOIN pages p ON p.page_id = w.page_id + 1
  WHERE p.page_id % 4 <> 0 AND NOT contains(p.url, '#'))
SELECT round, page_id, url FROM walk"""
    out["messages_rejected"] = with_base("""per AS (
  SELECT p.page_id, (SELECT count(*) FROM acc WHERE acc.page_id = p.page_id) AS n_urls FROM acc_pages p)
SELECT CAST(CASE WHEN page_id % 5 = 0 THEN 13 END AS INTEGER) AS error, count(*) AS n_lines,
  CAST(sum(n_urls) FILTER (page_id % 5 <> 0) AS BIGINT) AS n_urls
FROM per GROUP BY 1""")
    out["stream_fan_out"] = out["messages_read"]
    out["stream_crawl"] = out["crawl_chain"]
    out["stream_metrics"] = with_base("""x AS (SELECT 1)
SELECT count(*) AS pages, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS rejected,
  CAST((SELECT count(*) FROM acc) AS BIGINT) AS links FROM page_err""")
    out["messages_json"] = with_base("""m AS (
  SELECT page_id, list(struct_pack(url := url, domain := domain) ORDER BY pos) AS urls
  FROM acc GROUP BY page_id)
SELECT p.page_id, to_json(struct_pack(url := p.url, domain := """ + netloc("p.url") + """,
  urls := coalesce(m.urls, []))) AS message
FROM acc_pages p LEFT JOIN m USING (page_id)""")
    # Rounds 1 and 2: round 1 fetches every seeded page; with an empty seen
    # set its frontier publishes every distinct resolved link, and round 2
    # fetches the stored pages among them (none in the test tables, so the
    # crawl stops there; a later round would show up as a mismatch).
    out["crawl_rounds"] = with_base("""second AS (
  SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM acc))
SELECT CAST(1 AS INTEGER) AS round, page_id, url FROM pages
UNION ALL
SELECT CAST(2 AS INTEGER) AS round, page_id, url FROM second""")
    out["stream_links_resolved"] = out["links_resolved"]
    out["stream_frontier"] = out["frontier_step"]
    out["stream_dedupe"] = with_base("x AS (SELECT 1)\nSELECT DISTINCT domain, url FROM acc")
    out["stream_domain_first"] = with_base("""cand AS (SELECT DISTINCT page_id, url, domain FROM acc),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id, url) AS rn FROM cand)
SELECT page_id, url, domain, CAST(2 AS INTEGER) AS fetch_priority FROM r WHERE rn = 1""")
    out["stream_domain_edges"] = out["domain_edges"]
    out["hook_messages"] = with_base("""m AS (SELECT page_id, count(*) AS n FROM acc GROUP BY page_id)
SELECT p.page_id, p.url, CAST(m.n AS BIGINT) AS n_urls FROM acc_pages p JOIN m USING (page_id)""")
    return out


ORACLE_SQL = _sql()
