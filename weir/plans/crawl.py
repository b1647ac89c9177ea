"""Queries on the crawl: statistics of domains, admission, seeds, frontier, robots rules and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import pages as html
from weir.operators import frontier, keyed
from weir.plans.registry import literal, query
from weir.session import spread
from weir.sources.tables import table


@query("""WITH latest AS (SELECT * FROM crawled_documents WHERE normalized_url IS NOT NULL AND host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1),
    f AS (SELECT host, count(*) FILTER (WHERE error IS NULL AND coalesce(status_code, 0) < 400) AS scraped, count(*) FILTER (WHERE error IS NOT NULL OR status_code >= 400) AS failed, max(fetched_at) AS last_fetched FROM latest GROUP BY host),
    l AS (SELECT host, count(DISTINCT link) AS links FROM (SELECT host, unnest(CASE WHEN len(internal_links) > 0 THEN internal_links ELSE list_filter(links, lambda x: lower(regexp_extract(x, '://([^/:?#]+)', 1)) = host) END) AS link FROM latest) GROUP BY host)
    SELECT d.domain, coalesce(f.scraped, 0) AS scraped, coalesce(f.failed, 0) AS failed, f.last_fetched, coalesce(l.links, 0) AS links FROM domains d LEFT JOIN f ON f.host = d.domain LEFT JOIN l ON l.host = d.domain""")
def domain_stats(spark: SparkSession, root: str) -> DataFrame:
    """Every domain with what became of its pages' newest fetches and how many links they hold."""
    newest = keyed.latest(table(spark, root, "crawled_documents").filter("host IS NOT NULL"), ["normalized_url"], [F.desc_nulls_last("fetched_at"), F.desc("id")])
    good = F.col("error").isNull() & (F.coalesce("status_code", F.lit(0)) < 400)
    bad = F.col("error").isNotNull() | (F.col("status_code") >= 400)
    fetched = newest.groupBy("host").agg(F.count_if(good).alias("scraped"), F.count_if(bad).alias("failed"), F.max("fetched_at").alias("last_fetched"))
    own = F.filter("links", lambda x: F.lower(F.regexp_extract(x, "://([^/:?#]+)", 1)) == F.col("host"))
    links = newest.select("host", F.explode(F.when(F.size("internal_links") > 0, F.col("internal_links")).otherwise(own)).alias("link")).distinct().groupBy("host").agg(F.count("link").alias("links"))
    joined = table(spark, root, "domains").select("domain", F.col("domain").alias("host")).join(fetched, "host", "left").join(links, "host", "left")
    return joined.select("domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scraped", "failed", "links")], "last_fetched")


@query("""SELECT id, coalesce(nullif(normalized_url, ''), nullif(url, '')) AS address FROM crawled_documents WHERE coalesce(nullif(normalized_url, ''), nullif(url, '')) IS NOT NULL AND coalesce(error, '') = '' AND coalesce(nullif(status_code, 0), 200) BETWEEN 200 AND 299""")
def page_admission(spark: SparkSession, root: str) -> DataFrame:
    """Pages with an address and without an error; a status of 0 or null is taken for 200."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    address = F.coalesce(blank("normalized_url"), blank("url"))
    status = F.coalesce(F.nullif("status_code", F.lit(0)), F.lit(200))
    return table(spark, root, "crawled_documents").filter(address.isNotNull() & blank("error").isNull() & status.between(200, 299)).select("id", address.alias("address"))


@query("""SELECT c.id, d.id AS domain_id FROM crawled_documents c LEFT JOIN domains d ON d.domain = regexp_replace(lower(c.host), '^www\\.', '') WHERE c.host IS NOT NULL""")
def host_link(spark: SparkSession, root: str) -> DataFrame:
    """Pages with the id of their domain, if it is known."""
    known = table(spark, root, "domains").select(F.col("domain").alias("h"), F.col("id").alias("domain_id"))
    pages = table(spark, root, "crawled_documents").filter("host IS NOT NULL").select("id", F.regexp_replace(F.lower("host"), r"^www\.", "").alias("h"))
    return pages.join(known, "h", "left").select("id", "domain_id")


@query("""SELECT 'https://' || domain || '/' AS url, CASE priority WHEN 'HIGH' THEN 10 WHEN 'NORMAL' THEN 5 ELSE 1 END AS priority FROM domains WHERE status <> 'PAUSED'""")
def crawl_seeds(spark: SparkSession, root: str) -> DataFrame:
    weight = F.when(F.col("priority") == "HIGH", 10).when(F.col("priority") == "NORMAL", 5).otherwise(1)
    return table(spark, root, "domains").filter("status <> 'PAUSED'").select(F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), weight.alias("priority"))


LINES = "(1, '[gov 10]'), (2, 'https://a.np'), (3, '# no'), (4, 'https://b.np 50'), (5, ''), (6, '[news 5] # x'), (7, 'https://c.np # y')"


@query("SELECT * FROM (VALUES (2, 'https://a.np', 'gov', 10), (4, 'https://b.np', 'gov', 50), (7, 'https://c.np', 'news', 5)) v(n, url, category, priority)")
def seed_forward_fill(spark: SparkSession, root: str) -> DataFrame:
    """A seed list whose sections hold for the lines below them."""
    return frontier.forward_filled(literal(spark, LINES, "t(n, line)"))


@query("""WITH h AS (SELECT id, host, category, suffix FROM (SELECT id, host, category, unnest(list_transform(range(len(string_split(host, '.'))), lambda k: array_to_string(string_split(host, '.')[k + 1:], '.'))) AS suffix FROM crawled_documents WHERE host IS NOT NULL)),
    f AS (SELECT host, min(id) AS id FROM h GROUP BY host) SELECT f.host, f.id, max(d.id) AS site FROM f JOIN h ON h.id = f.id LEFT JOIN domains d ON d.domain = h.suffix GROUP BY 1, 2""")
def seed_build(spark: SparkSession, root: str) -> DataFrame:
    """The first row of each host, and the site it is or is below of: suffixes of the host are joined by equality."""
    first = keyed.latest(table(spark, root, "crawled_documents").select("id", "host"), ["host"], [F.asc("id")])
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    sites = table(spark, root, "domains").select(F.col("domain").alias("suffix"), F.col("id").alias("site"))
    return first.select("host", "id", F.explode(suffixes).alias("suffix")).join(sites, "suffix", "left").groupBy("host", "id").agg(F.max("site").alias("site"))


@query("""WITH w AS (SELECT id, host, depth, row_number() OVER (PARTITION BY host ORDER BY -depth DESC, id) AS place FROM crawled_documents WHERE host IS NOT NULL) SELECT id, host FROM w WHERE place <= 3 ORDER BY -depth DESC, id LIMIT 50""")
def frontier_select(spark: SparkSession, root: str) -> DataFrame:
    waiting = table(spark, root, "crawled_documents").filter("host IS NOT NULL").select("id", "host", (-F.col("depth")).alias("priority"), F.col("id").alias("seq"))
    return frontier.select_frontier(waiting, 3, 50).select("id", "host")


@query("""WITH h AS (SELECT host, max(-depth) AS priority, min(id) AS first FROM crawled_documents WHERE host IS NOT NULL GROUP BY host) SELECT host, ceil(row_number() OVER (ORDER BY priority DESC, first) / 10.0)::BIGINT AS batch FROM h""")
def domain_batches(spark: SparkSession, root: str) -> DataFrame:
    """Hosts by priority and first appearance, in batches of ten; the order is over hosts, not pages."""
    hosts = table(spark, root, "crawled_documents").filter("host IS NOT NULL").groupBy("host").agg(F.max(-F.col("depth")).alias("priority"), F.min("id").alias("first"))
    return keyed.numbered(hosts, [F.desc("priority"), F.asc("first")], "place").select("host", F.ceil(F.col("place") / 10).cast("long").alias("batch"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, 1 + l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem),
    r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def crawl_bfs(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "supplier").agg(F.count("*").alias("n")).scalar()
    links = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("src"), (1 + F.col("l_partkey") % n).alias("dst")).distinct()
    return frontier.reached(spark.sql("SELECT 1L AS node"), links, 4)


@query("""SELECT c.id, CASE WHEN c.error = 'timeout' THEN 'failed' WHEN c.content_type NOT LIKE '%html%' THEN 'skipped' WHEN c.error IS NOT NULL THEN 'fetch_error' WHEN r.noindex THEN 'noindex' WHEN c.id > f.first THEN 'near_duplicate' ELSE 'written' END AS outcome
    FROM crawled_documents c LEFT JOIN (SELECT crawled_document_id AS id, bool_or(noindex) AS noindex FROM page_records GROUP BY 1) r USING (id) LEFT JOIN (SELECT content_hash, min(id) AS first FROM crawled_documents GROUP BY 1) f USING (content_hash)""")
def crawl_outcome(spark: SparkSession, root: str) -> DataFrame:
    """What became of each fetch."""
    records = table(spark, root, "page_records").groupBy(F.col("crawled_document_id").alias("id")).agg(F.bool_or("noindex").alias("noindex"))
    pages = keyed.exact_duplicates(table(spark, root, "crawled_documents").select("id", "content_hash", "error", "content_type"), "content_hash", "id").join(records, "id", "left")
    what = frontier.outcome(F.col("error") == "timeout", ~F.col("content_type").contains("html"), F.col("error").isNotNull(), F.col("noindex"), F.col("duplicate_of").isNotNull(), F.lit(False))
    return pages.select("id", what.alias("outcome"))


RULES = "('a.np', '/', false), ('a.np', '/open/', true), ('a.np', '/open/*.pdf$', false), ('b.np', '/x', false), ('b.np', '/x', true)"
TARGETS = "(1, 'a.np', '/t'), (2, 'a.np', '/open/t'), (3, 'a.np', '/open/t.pdf'), (4, 'a.np', '/open/t.pdf?x'), (5, 'b.np', '/xy'), (6, 'c.np', '/')"


@query("SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, true), (5, true), (6, true)) v(id, allowed)")
def robots_longest_match(spark: SparkSession, root: str) -> DataFrame:
    return frontier.allowed(literal(spark, TARGETS, "t(id, host, path)"), literal(spark, RULES, "t(host, rule, allow)"))


ROBOTS_TAGS = "(1, 'noindex, follow'), (2, 'NONE'), (3, 'googlebot: nofollow'), (4, NULL), (5, 'all'), (6, 'noindex nofollow'), (7, 'noindex;q, nofollow\tnoarchive'), (8, '')"


@query(f"""WITH d AS (SELECT id, string_split_regex(lower(regexp_replace(coalesce(content, ''), '^[A-Za-z]+:', '')), '[, \t]+') AS d FROM (VALUES {ROBOTS_TAGS}) v(id, content))
    SELECT id, list_has_any(d, ['noindex', 'none']) AS noindex, list_has_any(d, ['nofollow', 'none']) AS nofollow FROM d""")
def robots_meta(spark: SparkSession, root: str) -> DataFrame:
    """Directives stand between commas, blanks or tabs; `none` is both."""
    said = F.split(F.lower(F.regexp_replace(F.coalesce("content", F.lit("")), "^[A-Za-z]+:", "")), "[, \t]+")
    has = lambda *words: F.arrays_overlap(said, F.array(*map(F.lit, words)))
    return literal(spark, ROBOTS_TAGS, "t(id, content)").select("id", has("noindex", "none").alias("noindex"), has("nofollow", "none").alias("nofollow"))


WAITS = "(1, '120'), (2, '9999'), (3, NULL), (4, 'x'), (5, 'Thu, 01 Jan 2026 00:02:00 GMT')"


@query(f"""SELECT id, least(300, coalesce(try_cast(header AS INTEGER), CASE WHEN header LIKE '%GMT' THEN greatest(0, epoch(strptime(header, '%a, %d %b %Y %H:%M:%S GMT') - TIMESTAMP '2026-01-01 00:00:00'))::INTEGER END, 30)) AS seconds FROM (VALUES {WAITS}) v(id, header)""")
def retry_after(spark: SparkSession, root: str) -> DataFrame:
    """How long to wait: seconds or a date (here from a fixed now), thirty seconds without either, five minutes at most."""
    at = F.try_to_timestamp(F.substring("header", 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(F.col("header").endswith("GMT"), F.greatest(F.lit(0), F.unix_seconds(at) - F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp"))).cast("int"))
    return literal(spark, WAITS, "t(id, header)").select("id", F.least(F.lit(300), F.coalesce(F.col("header").try_cast("int"), until, F.lit(30))).alias("seconds"))


@query("SELECT * FROM (VALUES ('page', 'https://x.np/a?b=1&c=2'), ('page', 'https://x.np/b'), ('sitemap', 'https://x.np/s1.xml')) v(kind, url)")
def xml_sitemap(spark: SparkSession, root: str) -> DataFrame:
    """Addresses out of sitemaps, of pages or of further sitemaps: a table function."""
    bodies = literal(spark, "('<urlset><url><loc>https://x.np/a?b=1&amp;c=2</loc></url><url><loc> https://x.np/b </loc></url></urlset>'), ('<sitemapindex><sitemap><loc>https://x.np/s1.xml</loc></sitemap></sitemapindex>'), (CAST(NULL AS STRING))", "t(body)")
    rows = F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")
    kind = F.when(F.col("body").contains("<sitemapindex"), "sitemap").otherwise("page").alias("kind")
    return bodies.select(kind, rows).select("kind", F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


@query("""SELECT count(DISTINCT host) AS hosts, 0::BIGINT AS split, true AS within FROM crawled_documents WHERE host IS NOT NULL""")
def shard_assign(spark: SparkSession, root: str) -> DataFrame:
    """Every host in one of eight shards, whatever its spelling."""
    shard = F.pmod(F.hash(F.lower("host")), F.lit(8))
    given = table(spark, root, "crawled_documents").filter("host IS NOT NULL").select("host", shard.alias("shard"))
    each = given.groupBy("host").agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    return each.agg(F.count("*").alias("hosts"), F.count_if(F.col("n") > 1).alias("split"), F.bool_and(F.col("low").between(0, 7) & F.col("high").between(0, 7)).alias("within"))


EVENTS = "(1, 'site_crawled', 1, 5, 'a.np', 'b', 'k/', 'd/'), (2, 'other', 1, 5, 'a.np', 'b', 'k/', 'd/'), (3, 'site_crawled', 2, 5, 'a.np', 'b', 'k/', 'd/'), (4, 'site_crawled', NULL, 5, '', 'b', 'k/', 'd/'), (5, 'site_crawled', NULL, 0, 'a.np', 'b', 'k/', 'd/'), (6, 'site_crawled', 1, 5, 'a.np', 'b', 'k/', 'd'), (7, 'site_crawled', 1, 5, 'a.np', 'b', '../k/', 'd/'), (8, 'site_crawled', 1, 5, 'a.np/x', 'b', 'k/', 'd/'), (9, 'site_crawled', 1, 5, 'a.np', 'b', 'k/', '/d/')"


@query("SELECT * FROM (VALUES (1, NULL), (2, 'type'), (3, 'version'), (4, 'missing'), (5, 'run'), (6, 'prefix'), (7, 'escape'), (8, 'host'), (9, 'escape')) v(id, fault)")
def event_validate(spark: SparkSession, root: str) -> DataFrame:
    return literal(spark, EVENTS, "t(id, type, version, run, host, bucket, key_prefix, documents_prefix)").select("id", frontier.event_fault().alias("fault"))


#: Endings that name no kind of file the gate knows make a file's first verdict unknown.
FILES = "(1, 'a.html', 10L, 'CLEAN'), (2, 'a.exe', 10L, 'CLEAN'), (3, 'a.pdf.exe', 0L, NULL), (4, 'a.bin', 10L, 'INFECTED'), (5, 'a.txt', 99999999L, NULL), (6, 'a.csv', 5L, 'ERROR'), (7, '.htaccess', 5L, 'CLEAN')"


@query("""SELECT * FROM (VALUES (1, '', 'SAFE', 'SAFE', true), (2, 'suspicious_extension', 'SUSPICIOUS', 'SUSPICIOUS', false), (3, 'suspicious_extension,empty_file,multiple_extensions', 'SUSPICIOUS', 'SUSPICIOUS', false), (4, 'unexpected_extension', 'UNKNOWN', 'INFECTED', false), (5, 'file_too_large', 'SUSPICIOUS', 'SUSPICIOUS', false),
    (6, '', 'SAFE', 'UNKNOWN', false), (7, 'unexpected_extension', 'UNKNOWN', 'SUSPICIOUS', false)) v(id, findings, first, verdict, accepted)""")
def security_rules(spark: SparkSession, root: str) -> DataFrame:
    """Findings about files and the verdict with the scanner's; nothing passes that wasn't scanned clean."""
    rows = literal(spark, FILES, "t(id, name, size, scan)").withColumn("f", frontier.file_findings(F.col("name"), F.col("size")))
    verdict = F.when(F.col("scan") == "INFECTED", "INFECTED").when(F.col("scan") == "ERROR", "UNKNOWN").when(F.size("f") > 0, "SUSPICIOUS").otherwise("SAFE")
    return rows.select("id", F.array_join("f", ",").alias("findings"), frontier.first_verdict(F.col("f")).alias("first"), verdict.alias("verdict"), (F.coalesce(F.col("scan") == "CLEAN", F.lit(False)) & (F.size("f") == 0)).alias("accepted"))


@query("""SELECT e.id, CASE WHEN m.name IS NULL THEN 'model' WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> m.dimensions THEN 'dimensions' WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' END AS fault FROM page_embeddings e LEFT JOIN embedding_models m ON m.name = e.model_name""")
def payload_validate(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with a vector, if anything."""
    models = table(spark, root, "embedding_models").select(F.col("name").alias("model_name"), F.col("dimensions").alias("size"))
    fault = F.when(F.col("size").isNull(), "model").when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != F.col("size"), "dimensions").when(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    return table(spark, root, "page_embeddings").join(models, "model_name", "left").select("id", fault.alias("fault"))


TAGS = "(1, 'NLP', 0.5D, 3, 9), (2, NULL, 0.5D, NULL, 9), (3, 'NLP', 1.5D, NULL, 9), (4, 'NLP', NULL, NULL, 9), (5, 'NLP', 1D, 10, 9), (6, 'NLP', 1D, 3, NULL)"


@query("SELECT * FROM (VALUES (1, NULL), (2, 'method'), (3, 'confidence'), (4, 'confidence'), (5, 'ward'), (6, 'ward')) v(id, fault)")
def geo_tag_validate(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    fault = F.when(c("method").isNull(), "method").when(c("confidence").isNull() | ~c("confidence").between(0, 1), "confidence").when(c("ward").isNotNull() & (c("wards").isNull() | ~c("ward").between(1, c("wards"))), "ward")
    return literal(spark, TAGS, "t(id, method, confidence, ward, wards)").select("id", fault.alias("fault"))


@query("""SELECT host, count(*) AS pages, count(*) FILTER (WHERE error IS NOT NULL) AS bad, CASE WHEN count(*) = count(error) THEN 'broken' WHEN count(error) > 0 THEN 'dead_letters' ELSE 'done' END AS outcome FROM crawled_documents WHERE host IS NOT NULL GROUP BY host""")
def batch_outcome(spark: SparkSession, root: str) -> DataFrame:
    """A batch of which all failed is broken; of which some failed has dead letters."""
    bad = F.count("error")
    what = F.when(bad == F.count("*"), "broken").when(bad > 0, "dead_letters").otherwise("done")
    return table(spark, root, "crawled_documents").filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages"), bad.alias("bad"), what.alias("outcome"))


@query()
def html_structure(spark: SparkSession, root: str) -> DataFrame:
    """Pages written as markup and read again: what the parser finds in each."""
    wrap = F.concat(F.lit("<html><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return spread(table(spark, root, "crawled_documents").filter("text IS NOT NULL").select("id", "title", "text")).select("id", html.structure(wrap).alias("s")).select("id", "s.nodes", "s.depth", F.size("s.headings").alias("headings"), F.char_length("s.text").alias("chars"))
