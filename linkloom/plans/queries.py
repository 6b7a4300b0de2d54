"""Named query plans over the test tables (feeds ``__spark_entry__`` and bench).

Every plan reads ``pages`` (or data Spark derives from it) whole; nothing is
sampled or capped except the top-k report, whose limit is the feature.

Derived inputs, stated once:

* ``seen`` -- a crawl that has fetched the https pages (S1 applied to their
  URLs) and has met every hosted link that occurs more than once.  So links
  are known by pair, by host only, or not at all.  Like any seen set it is a
  stored table, written once per session and table folder.
* ``override``/``recrawl`` -- links of a page whose URL has a query are
  override candidates, links of a page whose URL has a fragment recrawl ones.
* chain -- the pages with a link to the next page added, in chains of four.
* ``observed`` -- one fixed batch timestamp for edges, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.links import extract_links
from linkloom.functions.urls import endpoint, netloc, split_url
from linkloom.operators import analyze as A
from linkloom.operators import bloom as B
from linkloom.operators import bloom_layers as BL
from linkloom.operators import fetchlog as R
from linkloom.operators import frontier as FR
from linkloom.operators import graph as G
from linkloom.operators import seen as S
from linkloom.operators.levelled import LevelledStore
from linkloom.operators.priority_queue import PriorityQueue
from linkloom.session import reliable_checkpoint, scratch_path
from linkloom.sources import io
from linkloom.streaming.jobs import MessageHook

# Fixed query parameters.
OBSERVED = 1_700_000_000               # edge batch timestamp (epoch seconds)
FETCH_LIMIT_BYTES = 16384              # body cutoff for the fetch-outcome report
HEADER_LIMIT_BYTES = 1024              # header cutoff, passed by every tenth response
BLOOM_RATE = 0.01                      # designed error rate of the Bloom queries
TOP_K = 100
DENY_LIST = "ththre.example.com,m.ththth.example.net"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_pages(spark, f"{sf_dir}/pages.parquet")


_SEEN_TABLES: dict[tuple, str] = {}


def seen_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, sf_dir, files.getFileStatus(place).getModificationTime())
    if key not in _SEEN_TABLES:
        fetched = io.seeds_from_lines(pages(spark, sf_dir).filter(F.col("url").startswith("https:")), "url")
        links = A.explode_links(accepted_pages(spark, sf_dir)).filter(F.col("domain") != "")
        met = links.groupBy("url", "domain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        path = scratch_path(spark, "seen")
        fetched.unionByName(met).distinct().write.parquet(path)
        _SEEN_TABLES[key] = path
    return spark.read.parquet(_SEEN_TABLES[key])


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyze_pages(pages(spark, sf_dir))


def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accepted(analyzed(spark, sf_dir))


# --------------------------------------------------------------- queries --

def q_links_extract(spark, sf_dir):
    """L1 + L4: distinct raw links per page, one row each."""
    p = pages(spark, sf_dir)
    return p.select("page_id", F.explode(extract_links(io.text_mode(F.col("html")))).alias("link"))


def q_links_per_page(spark, sf_dir):
    """Number of distinct links per page."""
    p = pages(spark, sf_dir)
    return p.select("page_id", F.size(extract_links(io.text_mode(F.col("html")))).cast("long")
                    .alias("n_links"))


def q_links_resolved(spark, sf_dir):
    """Each extracted link resolved against its page."""
    return A.explode_links(accepted_pages(spark, sf_dir)).select(
        "page_id", "url", "domain")


def q_analyze_rejects(spark, sf_dir):
    """Pages the analyser rejects (missing body/URL, or a host failing IDNA)."""
    return A.rejected(analyzed(spark, sf_dir)).select("page_id", "error")


def _foreign_pages(spark, sf_dir):
    """The pages with one more link each: to a host with a non-ASCII label, or,
    where the page's URL has a fragment, to a host with an empty label."""
    host = netloc(F.col("url"))
    link = F.when(F.col("url").contains("#"), F.concat(F.lit("http://no.."), host, F.lit("/"))) \
        .otherwise(F.concat(F.lit("http://b\u00fccher."), host, F.lit("/x")))
    return pages(spark, sf_dir).select("page_id", "url", F.concat(
        "html", F.lit('\n<a href="'), link, F.lit('">')).alias("html"))


def q_foreign_links(spark, sf_dir):
    """U4-U10 with non-ASCII hosts (U6): the resolved links of ``_foreign_pages``."""
    a = A.accepted(A.analyze_pages(_foreign_pages(spark, sf_dir)))
    return A.explode_links(a).select("page_id", "url", "domain")


def q_foreign_rejects(spark, sf_dir):
    """U6 failures: the pages of ``_foreign_pages`` that the analyser rejects."""
    return A.rejected(A.analyze_pages(_foreign_pages(spark, sf_dir))).select("page_id", "error")


def q_url_parts(spark, sf_dir):
    """U2 + U3: split and fetch endpoint of every page URL."""
    p = pages(spark, sf_dir)
    s = split_url(F.col("url"))
    e = endpoint(F.col("url"))
    return p.select("page_id", s["scheme"].alias("scheme"), s["netloc"].alias("netloc"),
                    s["path"].alias("path"), s["query"].alias("query"),
                    s["fragment"].alias("fragment"), e["hostname"].alias("hostname"),
                    e["port"].alias("port"), e["path"].alias("request_path"),
                    e["ssl"].alias("ssl"))


def q_seeds(spark, sf_dir):
    """S1 over the page URLs."""
    return io.seeds_from_lines(pages(spark, sf_dir), "url")


def _frontier(spark, sf_dir, deny=None):
    cand = FR.page_candidates(accepted_pages(spark, sf_dir))
    return FR.frontier_step(cand, seen_from_pages(spark, sf_dir), deny=deny, flagged=False)


def _published_cols(published: DataFrame) -> DataFrame:
    return published.select(F.col("seq").alias("page_id"), "url", "domain",
                            "fetch_priority")


def q_frontier_step(spark, sf_dir):
    """URLs published by one frontier step, with fetch priority."""
    return _published_cols(_frontier(spark, sf_dir).published)


def q_frontier_deny(spark, sf_dir):
    """J6 + F4: the same step with two hosts on the deny list."""
    return _published_cols(_frontier(spark, sf_dir, S.parse_deny_list(DENY_LIST)).published)


def _flags():
    return F.col("url").contains("?"), F.col("url").contains("#")


def q_frontier_flagged(spark, sf_dir):
    """F1-F4 with override and recrawl candidates: all four priorities."""
    cand = FR.page_candidates(accepted_pages(spark, sf_dir), *_flags())
    return _published_cols(FR.frontier_step(cand, seen_from_pages(spark, sf_dir)).published)


def q_frontier_additions(spark, sf_dir):
    """Pairs the step adds to the seen set."""
    return _frontier(spark, sf_dir).additions


def q_frontier_counts(spark, sf_dir):
    """published URLs per page."""
    return FR.published_per_message(_frontier(spark, sf_dir).published)


def q_frontier_top(spark, sf_dir):
    """the next URLs to fetch, priority order, top 100."""
    top = FR.next_to_fetch(_frontier(spark, sf_dir).published, TOP_K)
    return _published_cols(top)


def _link_pairs(spark, sf_dir):
    return A.explode_links(accepted_pages(spark, sf_dir)).select("domain", "url").distinct()


def q_seen_exists(spark, sf_dir):
    """For each distinct linked (domain, url): domain / url / pair known."""
    probes = _link_pairs(spark, sf_dir)
    seen = seen_from_pages(spark, sf_dir)
    df = S.exists_flag(probes, seen, "domain", "domain_known")
    df = S.exists_flag(df, seen, "url", "url_known")
    return S.exists_flag(df, seen, "both", "pair_known")


def q_seen_bulk_exists(spark, sf_dir):
    """Stored pairs that the pages link to (probes need both parts, so
    links without a host are not asked)."""
    probes = _link_pairs(spark, sf_dir).filter(F.col("domain") != "")
    return S.exists_bulk(seen_from_pages(spark, sf_dir), probes)


def q_seen_add_status(spark, sf_dir):
    """Bulk add of every (page, link) pair in page order: inserted or not.

    The rows are consumed twice (first occurrence per pair, then each row's
    status), so the exploded links are written once to the checkpoint folder
    instead of analysing the pages twice."""
    links = reliable_checkpoint(A.explode_links(accepted_pages(spark, sf_dir)))
    pairs = links.select(F.struct("page_id", "pos").alias("seq"), "page_id", "domain", "url")
    st = S.add_bulk_status(seen_from_pages(spark, sf_dir), pairs)
    return st.select("page_id", "domain", "url", "inserted")


def q_seen_add_single(spark, sf_dir):
    """Insert the frontier step's new pairs with the key check (a pair
    already stored or repeated would fail the query)."""
    return S.add_single(seen_from_pages(spark, sf_dir), _frontier(spark, sf_dir).additions)


def q_domain_edges(spark, sf_dir):
    """G1 + G2: page host -> distinct linked hosts, one batch timestamp."""
    return G.domain_edges(accepted_pages(spark, sf_dir), OBSERVED)


def _status():
    """The status that a page's stored response has: pages whose URL has a query were
    not found, those whose URL has a fragment have moved."""
    return F.when(F.col("url").contains("?"), F.lit("404 Not Found")) \
        .when(F.col("url").contains("#"), F.lit("301 Moved Permanently")).otherwise(F.lit("200 OK"))


def q_fetch_outcome(spark, sf_dir):
    """Fetch record of each stored body under a 16 KiB cutoff."""
    return R.fetch_outcome(pages(spark, sf_dir), FETCH_LIMIT_BYTES, code=F.substring(_status(), 1, 3),
                           path=F.concat(F.lit("bodies/"), F.col("page_id").cast("string")))


def q_response_outcome(spark, sf_dir):
    """Header split, status, headers and cutoffs of stored responses.  Every
    tenth has a header beyond the 1 KiB header limit, every tenth a status line
    without a code, which makes its headers invalid."""
    p = pages(spark, sf_dir)
    status = F.when(F.col("page_id") % 10 == 7, F.lit("odd")).otherwise(_status())
    long_header = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("X-Note: "), F.repeat(F.lit("n"), 2000),
                                                              F.lit("\r\n"))).otherwise(F.lit(""))
    resp = p.select("page_id", R.stored_response(p, status=status, headers=long_header).alias("raw"))
    out = R.response_outcome(resp, FETCH_LIMIT_BYTES, HEADER_LIMIT_BYTES, keep=("page_id",))
    return out.select("page_id", "success", "error", "md5", "http_code", "headers_valid",
                      F.col("headers")["Content-Type"].alias("content_type"),
                      F.col("headers")["Content-Length"].alias("content_length"),
                      "header_bytes", "body_bytes")


def _link_urls(spark, sf_dir):
    return A.explode_links(accepted_pages(spark, sf_dir)).select("url")


def _sized(df):
    """A stored copy of the items (read by the count and by the build) and
    parameters for their number."""
    items = reliable_checkpoint(df)
    return items, B.BloomParams.for_items(items.count(), BLOOM_RATE)


def q_bloom_build(spark, sf_dir):
    """B2 + B3: bit array of the distinct linked URLs."""
    urls, params = _sized(_link_urls(spark, sf_dir).distinct())
    return B.bloom_build(urls, "url", params)


def q_bloom_probe(spark, sf_dir):
    """B4 + J7 + B8: Bloom of the seen set, probed with every linked URL, then
    confirmed against the seen set; ``known`` must equal the plain lookup."""
    seen, params = _sized(seen_from_pages(spark, sf_dir).select("url").distinct())
    bloom = B.bloom_build(seen, "url", params)
    return B.two_tier_known(_link_urls(spark, sf_dir), "url", bloom, seen, params)


def q_bloom_pairs(spark, sf_dir):
    """J7 by pair: a Bloom tier of domains, one of URLs, both confirmed."""
    seen = seen_from_pages(spark, sf_dir)
    domains, by_domain = _sized(seen.select("domain").distinct())
    urls, by_url = _sized(seen.select("url").distinct())
    return B.two_tier_pairs(_link_pairs(spark, sf_dir), B.bloom_build(domains, "domain", by_domain),
                            B.bloom_build(urls, "url", by_url), seen, by_domain, by_url)


def q_bloom_stats(spark, sf_dir):
    """B1 + B5-B7: size, count, error rate and bounds of the URL Bloom."""
    urls, params = _sized(_link_urls(spark, sf_dir).distinct())
    st = B.bloom_stats(urls, "url", params)
    return st.withColumn("current_p_float", F.round("current_p_float", 12))


BOUNDS = ((10, 0.87), (1_000, 0.01), (10_000_000, 0.001))     # (max_n, p): filters of several sizes
LAYER_SHARE = 10                       # the first layer holds a tenth of the items


def q_bloom_bounds(spark, sf_dir):
    """The linked URLs against filters of several sizes: which fit, and
    with which code the others would stop."""
    urls = reliable_checkpoint(_link_urls(spark, sf_dir).distinct())
    out = None
    for max_n, p in BOUNDS:
        row = B.bloom_stats(urls, "url", B.BloomParams(max_n, p)).select(
            F.lit(max_n).cast("long").alias("max_n"), F.lit(p).alias("p"), "m", "k", "n", "capacity", "status")
        out = row if out is None else out.unionAll(row)
    return out


def q_bloom_blocked(spark, sf_dir):
    """B4 + J7, blocked: the linked URLs asked of a blocked filter of the seen
    set (one join row a URL), those it may hold looked up in the seen set."""
    seen = reliable_checkpoint(seen_from_pages(spark, sf_dir).select("url").distinct())
    params = BL.BlockParams(max(1000, seen.count()), 10 * BLOOM_RATE)
    flags = BL.blocked_contains(BL.blocked_build(seen, "url", params), _link_urls(spark, sf_dir), "url", params)
    return BL.confirmed(flags, "url", seen).select("url", "known")


def _layered(spark, items):
    """A stored filter, filled with ``items`` in four batches and reopened for each."""
    plan = BL.LayerPlan(items.count() // LAYER_SHARE + 1, BLOOM_RATE)
    path = scratch_path(spark, "bloom-layers")
    batch = F.pmod(F.xxhash64("url"), F.lit(4))
    for i in range(4):
        BL.LayeredBloom(spark, path, plan).add(i, items.where(batch == i), "url")
    return BL.LayeredBloom(spark, path)


def q_bloom_layers(spark, sf_dir):
    """B1 + B5-B8, layered: the layers that a stored filter has after it took
    ten times the items that its first layer is sized for."""
    return _layered(spark, reliable_checkpoint(_link_urls(spark, sf_dir).distinct())).stats()


def q_bloom_layers_known(spark, sf_dir):
    """B8 + J7, layered: the seen set's stored filter, reopened, asked for every
    linked URL; what it may hold is looked up."""
    seen = reliable_checkpoint(seen_from_pages(spark, sf_dir).select("url").distinct())
    return _layered(spark, seen).known(_link_urls(spark, sf_dir), "url", seen).select("url", "known")


SEEN_BATCHES = 6


def q_seen_levelled(spark, sf_dir):
    """S6 + J4: the seen set as a levelled store: the stored pairs, then the
    pages' links in six batches, each adding what the store lacks; compacted
    at the end.  Rows: pair and the batch that added it."""
    store = LevelledStore(spark, scratch_path(spark, "seen-levels"))
    store.add(0, seen_from_pages(spark, sf_dir))
    links = reliable_checkpoint(A.explode_links(accepted_pages(spark, sf_dir)).select("page_id", "domain", "url"))
    for i in range(SEEN_BATCHES):
        store.add(i + 1, links.where(F.pmod("page_id", F.lit(SEEN_BATCHES)) == i))
    store.compact()
    return store.read()


def q_frontier_queue(spark, sf_dir):
    """F6, durable: the frontier put into a queue by pages with an even, then an
    odd id; the first five takes of 100, numbered."""
    published = reliable_checkpoint(_frontier(spark, sf_dir).published)
    queue = PriorityQueue(spark, scratch_path(spark, "queue"), segment_rows=max(100, published.count() // 8))
    for i in range(2):
        queue.put(i, published.where(F.col("seq") % 2 == i))
    out = None
    for i in range(1, 6):
        taken = queue.take(TOP_K, i).select(F.lit(i).alias("take"), "*")
        out = taken if out is None else out.unionAll(taken)
    return out.select("take", F.col("seq").alias("page_id"), "url", "domain", "fetch_priority")


def q_links_rfc3986(spark, sf_dir):
    """U4 ``mode="rfc3986"``: each extracted link resolved by RFC 3986."""
    a = A.accepted(A.analyze_pages(pages(spark, sf_dir), mode="rfc3986"))
    return A.explode_links(a).select("page_id", "url", "domain")


def q_crawl_rounds(spark, sf_dir):
    """crawl rounds over the stored snapshot, seeded with every stored
    page URL, until a round fetches nothing; each round fetches the frontier
    URLs that are stored pages."""
    from linkloom.operators.rounds import crawl_rounds
    p = pages(spark, sf_dir)
    return crawl_rounds(p, p.select("url"))


CHAIN = 4


def q_crawl_chain(spark, sf_dir):
    """F7 over several rounds: every page links to the next one by page_id
    within its chain of four; the crawl starts at the chains' first pages and
    at URLs with a fragment, which no resolved link can name."""
    from linkloom.operators.rounds import crawl_rounds
    return crawl_rounds(*_chain(spark, sf_dir))


def _chain(spark, sf_dir):
    """The chained pages, stored, and the seeds."""
    p = pages(spark, sf_dir).select("page_id", "url", "html")
    follower = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("_next")) \
        .filter((F.col("page_id") + 1) % CHAIN != 0)
    linked = p.join(follower, "page_id", "left").select(
        "page_id", "url", F.concat("html", F.coalesce(F.concat(F.lit('\n<a href="'), "_next", F.lit('">')),
                                                      F.lit(""))).alias("html"))
    seeds = p.filter((F.col("page_id") % CHAIN == 0) | F.col("url").contains("#")).select("url")
    path = scratch_path(spark, "chain")
    linked.write.parquet(path)
    return spark.read.parquet(path), seeds


def q_messages_json(spark, sf_dir):
    """S3: analysed pages as JSON messages."""
    a = accepted_pages(spark, sf_dir)
    return a.select("page_id", F.to_json(F.struct("url", "domain", "urls")).alias("message"))


def q_messages_read(spark, sf_dir):
    """S3 written and read back, through S7's fan-out beside the edge log."""
    path = scratch_path(spark, "messages")
    log = scratch_path(spark, "message-edges")
    io.fan_out(accepted_pages(spark, sf_dir), [
        lambda a: io.write_messages(a, path),
        lambda a: G.append_edges(G.domain_edges(a, OBSERVED), log)])
    edges = G.read_edges(spark, log).groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"))
    sent = io.read_messages(spark, path).groupBy(F.col("domain").alias("source")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.size("urls")).alias("n_urls"))
    return sent.join(edges, "source", "left").select(
        "source", "n_messages", "n_urls", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def q_messages_rejected(spark, sf_dir):
    """S3: written messages, those of every fifth page cut off before their last
    character: the malformed lines, with error 13, and how many were read."""
    path = scratch_path(spark, "messages-cut")
    text = q_messages_json(spark, sf_dir)
    cut = F.when(F.col("page_id") % 5 == 0, F.expr("left(message, length(message) - 1)")).otherwise(F.col("message"))
    text.select(cut.alias("value")).write.text(path)
    return io.parse_messages(spark.read.option("lineSep", "\n").text(path)).groupBy("error").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("message.urls").cast("long")).alias("n_urls"))


def q_edges_log(spark, sf_dir):
    """S4 + S5: the edges appended to a log as a batch, written again as a replay
    would, and scanned."""
    path = scratch_path(spark, "edges")
    edges = reliable_checkpoint(q_domain_edges(spark, sf_dir))
    for _ in range(2):
        G.append_edges(edges, path, 0)
    return G.read_edges(spark, path)


def q_seen_log(spark, sf_dir):
    """The frontier's additions appended as a batch, written again as a
    replay would, beside the stored pairs; the seen set read back."""
    path = scratch_path(spark, "seen-log")
    S.append_seen(seen_from_pages(spark, sf_dir), path, 0)
    new = reliable_checkpoint(_frontier(spark, sf_dir).additions)
    for _ in range(2):
        S.append_seen(new, path, 1)
    return spark.read.parquet(path).select("domain", "url")


QUERIES = {
    "links_extract": q_links_extract,
    "links_per_page": q_links_per_page,
    "links_resolved": q_links_resolved,
    "analyze_rejects": q_analyze_rejects,
    "foreign_links": q_foreign_links,
    "foreign_rejects": q_foreign_rejects,
    "url_parts": q_url_parts,
    "seeds": q_seeds,
    "frontier_step": q_frontier_step,
    "frontier_deny": q_frontier_deny,
    "frontier_flagged": q_frontier_flagged,
    "frontier_additions": q_frontier_additions,
    "frontier_counts": q_frontier_counts,
    "frontier_top": q_frontier_top,
    "seen_exists": q_seen_exists,
    "seen_bulk_exists": q_seen_bulk_exists,
    "seen_add_status": q_seen_add_status,
    "seen_add_single": q_seen_add_single,
    "domain_edges": q_domain_edges,
    "fetch_outcome": q_fetch_outcome,
    "response_outcome": q_response_outcome,
    "bloom_build": q_bloom_build,
    "bloom_probe": q_bloom_probe,
    "bloom_pairs": q_bloom_pairs,
    "bloom_stats": q_bloom_stats,
    "bloom_bounds": q_bloom_bounds,
    "bloom_blocked": q_bloom_blocked,
    "bloom_layers": q_bloom_layers,
    "bloom_layers_known": q_bloom_layers_known,
    "seen_levelled": q_seen_levelled,
    "frontier_queue": q_frontier_queue,
    "links_rfc3986": q_links_rfc3986,
    "messages_json": q_messages_json,
    "messages_read": q_messages_read,
    "messages_rejected": q_messages_rejected,
    "edges_log": q_edges_log,
    "seen_log": q_seen_log,
    "crawl_rounds": q_crawl_rounds,
    "crawl_chain": q_crawl_chain,
}


# ------------------------------------------------------------- streaming --
# Each runs its stream over the stored pages until the input is consumed
# (availableNow) and returns the sink table; the result must equal the batch
# query of the same name without the ``stream_`` prefix.

def _page_files(spark, sf_dir):
    """(folder, file pattern) of the pages table, one file or a folder of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return f"{sf_dir}/pages.parquet", "*.parquet"
    return sf_dir, "pages.parquet"


def q_stream_links_resolved(spark, sf_dir):
    """Continuous extraction + resolution."""
    from linkloom.streaming import jobs as T
    links = A.explode_links(A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir))))
    out = T.run_to_table(links.select("page_id", "url", "domain"), "stream-links")
    return spark.read.parquet(out)


def q_stream_frontier(spark, sf_dir):
    """Frontier per micro-batch against a table-backed seen set."""
    from linkloom.streaming import jobs as T
    seen_path = scratch_path(spark, "stream-seen")
    T.write_seen_batch(seen_from_pages(spark, sf_dir), seen_path, -1)
    out_path = scratch_path(spark, "stream-frontier")
    stream = T.analyzed_stream(spark, *_page_files(spark, sf_dir))
    T.run_to_table(stream, "stream-frontier-q", foreach_batch=T.frontier_batches(seen_path, out_path))
    return _published_cols(spark.read.parquet(out_path).drop("batch_id"))


def _frontier_stream(spark, sf_dir, name, make, **flags):
    from linkloom.streaming import jobs as T
    state, out = scratch_path(spark, name + "-state"), scratch_path(spark, name)
    stream = T.analyzed_stream(spark, *_page_files(spark, sf_dir))
    T.run_to_table(stream, name + "-q", foreach_batch=make(state, out, **flags))
    return _published_cols(spark.read.parquet(out))


def q_stream_frontier_flagged(spark, sf_dir):
    """T2 with override and recrawl candidates, from an empty seen set."""
    from linkloom.streaming import jobs as T
    override, recrawl = _flags()
    return _frontier_stream(spark, sf_dir, "stream-flagged", T.frontier_batches,
                            override=override, recrawl=recrawl)


def q_stream_domain_priority(spark, sf_dir):
    """T4: every new URL, priority 2 where its domain is new, else 3."""
    from linkloom.streaming import jobs as T
    return _frontier_stream(spark, sf_dir, "stream-priority", T.domain_priority_batches)


def q_stream_dedupe(spark, sf_dir):
    """Each linked (domain, url) once across the stream."""
    from linkloom.streaming import jobs as T
    links = A.explode_links(A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir))))
    out = T.run_to_table(T.dedupe_stream(links.select("domain", "url")), "stream-dedupe")
    return spark.read.parquet(out)


def q_stream_domain_first(spark, sf_dir):
    """T4, priority-2 rows from keyed state: first URL of each domain."""
    from linkloom.streaming import jobs as T
    cand = FR.page_candidates(A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir))))
    out = T.run_to_table(T.domain_first_stream(cand), "stream-domain-first")
    return spark.read.parquet(out).select(F.col("seq").alias("page_id"), "url", "domain",
                                          "fetch_priority")


def q_stream_frontier_stored(spark, sf_dir):
    """T2 against levelled stores of the pairs and domains met, which start with the seen set."""
    from linkloom.streaming import jobs as T
    seen = seen_from_pages(spark, sf_dir)
    paths = [scratch_path(spark, f"stored-{k}") for k in ("pairs", "domains", "frontier")]
    LevelledStore(spark, paths[0]).add(-1, seen)
    LevelledStore(spark, paths[1], keys=("domain",)).add(-1, seen)
    stream = T.analyzed_stream(spark, *_page_files(spark, sf_dir))
    T.run_to_table(stream, "stored-frontier-q", foreach_batch=T.stored_frontier_batches(*paths))
    return _published_cols(spark.read.parquet(paths[2]))


def q_stream_priority_keyed(spark, sf_dir):
    """T4 from keyed state that starts with the seen set: every new URL, priority 2 or 3."""
    from linkloom.streaming import jobs as T
    from linkloom.streaming.keyed import priority_keyed
    cand = FR.page_candidates(A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir))))
    out = T.run_to_table(priority_keyed(cand, seen_from_pages(spark, sf_dir)), "priority-keyed")
    return spark.read.parquet(out).select(F.col("seq").alias("page_id"), "url", "domain", "fetch_priority")


def q_stream_dedupe_keyed(spark, sf_dir):
    """T3 from keyed state that starts with the seen set: each new (domain, url) once."""
    from linkloom.streaming import jobs as T
    from linkloom.streaming.keyed import dedupe_keyed
    links = A.explode_links(A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir))))
    return spark.read.parquet(T.run_to_table(dedupe_keyed(links, seen_from_pages(spark, sf_dir)), "dedupe-keyed"))


def q_stream_fan_out(spark, sf_dir):
    """S7 + S3 + S4 in a stream: messages and edges, each batch once per sink."""
    from linkloom.streaming import jobs as T
    from linkloom.streaming.fanout import fan_out_batches, to_folder
    path = scratch_path(spark, "fan-out")
    sinks = {"messages": to_folder(f"{path}/messages", lambda a: a.select("url", "domain", "urls"), "json"),
             "edges": to_folder(f"{path}/edges", lambda a: G.domain_edges(a, OBSERVED))}
    stream = A.accepted(T.analyzed_stream(spark, *_page_files(spark, sf_dir)))
    T.run_to_table(stream, "fan-out-q", foreach_batch=fan_out_batches(f"{path}/log", sinks))
    edges = spark.read.parquet(f"{path}/edges").groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"))
    sent = io.read_messages(spark, f"{path}/messages").groupBy(F.col("domain").alias("source")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.size("urls")).alias("n_urls"))
    return sent.join(edges, "source", "left").select(
        "source", "n_messages", "n_urls", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def q_stream_crawl(spark, sf_dir):
    """F7 as a stream with feedback, over the chained pages."""
    from linkloom.streaming.loop import crawl_stream
    return crawl_stream(*_chain(spark, sf_dir), scratch_path(spark, "crawl-stream"))


def q_stream_metrics(spark, sf_dir):
    """L5 + T1: the counters that each micro-batch observed, summed."""
    from linkloom.streaming import jobs as T
    from linkloom.streaming import metrics as M
    stream = M.observed(T.analyzed_stream(spark, *_page_files(spark, sf_dir)))
    out = scratch_path(spark, "metrics")
    name = out.rsplit("/", 1)[-1].replace("-", "_")

    def run():
        q = stream.select("page_id", "n_links").writeStream.queryName(name).format("parquet") \
            .option("checkpointLocation", f"{out}/ckpt").option("path", f"{out}/links").trigger(availableNow=True).start()
        q.awaitTermination()

    counters = M.run_with_metrics(spark, f"{out}/records", name, run).where("input_rows > 0")
    return counters.agg(*(F.sum(F.col("counters")[c]).alias(c) for c in ("pages", "accepted", "rejected", "links")))


def q_stream_domain_edges(spark, sf_dir):
    """T5: continuous graph log."""
    from linkloom.streaming import jobs as T
    edges = T.edges_stream(T.analyzed_stream(spark, *_page_files(spark, sf_dir)), OBSERVED)
    return spark.read.parquet(T.run_to_table(edges, "stream-edges"))


class _LinkCounter(MessageHook):
    """T6 sample hook: the logger's guard (url present, links present) and
    the analyser's per-message link count."""

    def on_batch(self, messages):
        n = messages["urls"].str.len()
        kept = messages["url"].notna() & (n > 0)
        return messages[["page_id", "url"]].assign(n_urls=n)[kept].astype({"n_urls": "int64"})


def q_hook_messages(spark, sf_dir):
    """A user hook over analysed pages through mapInPandas."""
    from linkloom.streaming import jobs as T
    return T.map_messages(accepted_pages(spark, sf_dir).select("page_id", "url", "urls"),
                          _LinkCounter, "page_id long, url string, n_urls long")


QUERIES.update({
    "stream_links_resolved": q_stream_links_resolved,
    "stream_frontier": q_stream_frontier,
    "stream_frontier_flagged": q_stream_frontier_flagged,
    "stream_domain_priority": q_stream_domain_priority,
    "stream_dedupe": q_stream_dedupe,
    "stream_domain_first": q_stream_domain_first,
    "stream_domain_edges": q_stream_domain_edges,
    "stream_frontier_stored": q_stream_frontier_stored,
    "stream_priority_keyed": q_stream_priority_keyed,
    "stream_dedupe_keyed": q_stream_dedupe_keyed,
    "stream_fan_out": q_stream_fan_out,
    "stream_crawl": q_stream_crawl,
    "stream_metrics": q_stream_metrics,
    "hook_messages": q_hook_messages,
})
