"""Queries on versions, merges, duplicates, queues and their bookkeeping, over the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import keyed, near
from weir.plans.registry import query
from weir.sources.tables import table

def newest() -> list:
    return [F.desc_nulls_last("fetched_at"), F.desc("id")]


@query("""SELECT id, normalized_url, content_hash, fetched_at FROM crawled_documents WHERE normalized_url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1""")
def latest_per_key(spark: SparkSession, root: str) -> DataFrame:
    return keyed.latest(table(spark, root, "crawled_documents"), ["normalized_url"], newest()).select("id", "normalized_url", "content_hash", "fetched_at")


@query("""WITH o AS (SELECT id, normalized_url, content_hash, fetched_at, lag(content_hash) OVER w AS before, row_number() OVER w AS n FROM crawled_documents
        WINDOW w AS (PARTITION BY normalized_url ORDER BY fetched_at, id)),
    c AS (SELECT *, n = 1 OR before IS DISTINCT FROM content_hash AS content_changed FROM o)
    SELECT id, content_changed, 1 + CAST(sum(CASE WHEN content_changed AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY normalized_url ORDER BY fetched_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM c""")
def version_counter(spark: SparkSession, root: str) -> DataFrame:
    done = keyed.versions(table(spark, root, "crawled_documents"), "normalized_url", "content_hash", [F.asc_nulls_last("fetched_at"), F.asc("id")])
    return done.select("id", "content_changed", F.col("version").cast("long").alias("version"))


@query("""WITH t AS (SELECT * FROM crawled_documents WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY normalized_url, content_hash ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1),
    s AS (SELECT * FROM crawled_documents WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY normalized_url, content_hash ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)
    SELECT coalesce(s.id, t.id) AS id, coalesce(s.normalized_url, t.normalized_url) AS normalized_url, coalesce(s.content_hash, t.content_hash) AS content_hash,
        CASE WHEN s.id IS NOT NULL THEN s.title ELSE t.title END AS title, t.id IS NULL AS inserted, t.id IS NOT NULL AND s.id IS NOT NULL AS updated
    FROM t FULL JOIN s ON t.normalized_url = s.normalized_url AND t.content_hash = s.content_hash""")
def merge_bronze(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "crawled_documents").select("id", "normalized_url", "content_hash", "title", "fetched_at")
    keys = ["normalized_url", "content_hash"]
    target = keyed.latest(pages.filter("id % 2 = 0"), keys, newest())
    return keyed.upsert(target, pages.filter("id % 2 = 1"), keys, newest()).drop("fetched_at")


@query("""WITH p AS (SELECT *, id % 3 = 0 AS first_batch FROM crawled_documents),
    t AS (SELECT * FROM p WHERE first_batch QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY id DESC) = 1),
    s AS (SELECT * FROM p WHERE NOT first_batch QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY id DESC) = 1)
    SELECT CASE WHEN t.id IS NULL OR t.id <= s.id THEN s.id ELSE t.id END AS id, coalesce(t.normalized_url, s.normalized_url) AS normalized_url,
        CASE WHEN t.id IS NULL OR t.id <= s.id THEN s.content_hash ELSE t.content_hash END AS content_hash, t.id IS NULL AS inserted, t.id IS NOT NULL AND s.id IS NOT NULL AND t.id <= s.id AS updated
    FROM t FULL JOIN s ON t.normalized_url = s.normalized_url""")
def merge_silver(spark: SparkSession, root: str) -> DataFrame:
    """A later batch with rows older than what is there: an older id never overwrites a newer one."""
    pages = table(spark, root, "crawled_documents").select("id", "normalized_url", "content_hash")
    target = keyed.latest(pages.filter("id % 3 = 0"), ["normalized_url"], [F.desc("id")])
    return keyed.upsert(target, pages.filter("id % 3 <> 0"), ["normalized_url"], [F.desc("id")], guard="t.id <= s.id")


@query("""SELECT r.id, coalesce(CASE WHEN f.n IS NOT NULL AND r.status IS NULL THEN 'RUNNING' ELSE r.status END, 'RUNNING') AS status, coalesce(f.n, 0) AS documents, f.newest, r.started_at
    FROM crawl_runs r LEFT JOIN (SELECT crawl_run_id, count(*) AS n, max(fetched_at) AS newest FROM crawled_documents GROUP BY 1) f ON f.crawl_run_id = r.id""")
def merge_run(spark: SparkSession, root: str) -> DataFrame:
    """Runs with what their documents say; a placeholder status never overwrites a known one."""
    seen = table(spark, root, "crawled_documents").filter("crawl_run_id IS NOT NULL").groupBy(F.col("crawl_run_id").alias("id")).agg(F.count("*").alias("documents"), F.max("fetched_at").alias("newest"))
    runs = table(spark, root, "crawl_runs").join(seen, "id", "left")
    return runs.select("id", F.coalesce("status", F.lit("RUNNING")).alias("status"), F.coalesce("documents", F.lit(0)).alias("documents"), "newest", "started_at")


@query("""WITH c AS (SELECT id AS page_id, unnest(links) AS link FROM crawled_documents),
    i AS (SELECT DISTINCT page_id, link FROM (SELECT id AS page_id, unnest(internal_links) AS link FROM crawled_documents WHERE status_code = 200))
    SELECT DISTINCT page_id, link FROM c WHERE page_id NOT IN (SELECT page_id FROM i) UNION ALL SELECT page_id, link FROM i""")
def replace_children(spark: SparkSession, root: str) -> DataFrame:
    """The links of all pages, those of pages fetched well replaced by their internal ones."""
    pages = table(spark, root, "crawled_documents")
    children = pages.select(F.col("id").alias("page_id"), F.explode("links").alias("link")).distinct()
    incoming = pages.filter("status_code = 200").select(F.col("id").alias("page_id"), F.explode("internal_links").alias("link"))
    return keyed.replace_children(children, incoming, "page_id")


@query("""SELECT id, CASE WHEN min(id) OVER (PARTITION BY content_hash) < id AND content_hash IS NOT NULL THEN min(id) OVER (PARTITION BY content_hash) END AS duplicate_of FROM crawled_documents""")
def exact_dups(spark: SparkSession, root: str) -> DataFrame:
    return keyed.exact_duplicates(table(spark, root, "crawled_documents").select("id", "content_hash"), "content_hash", "id").select("id", "duplicate_of")


SIMHASH_SQL = """tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+')) AS token FROM documents WHERE text IS NOT NULL),
    votes AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM (
        SELECT doc_id, count(*) AS n, CAST(concat('0x', right(sha256(token), 16)) AS UBIGINT) AS h FROM tokens GROUP BY doc_id, token) CROSS JOIN range(64) AS r(b) GROUP BY doc_id, b),
    hashes AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END) AS h FROM votes GROUP BY doc_id)"""


@query(f"WITH {SIMHASH_SQL} SELECT d.doc_id, lpad(lower(to_hex(coalesce(h, 0::UBIGINT))), 16, '0') AS simhash FROM documents d LEFT JOIN hashes USING (doc_id) WHERE d.text IS NOT NULL")
def simhash(spark: SparkSession, root: str) -> DataFrame:
    hashed = near.simhash(table(spark, root, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    return hashed.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


@query(f"""WITH {SIMHASH_SQL}, heads AS (SELECT h, min(d.doc_id) AS head, count(*) AS copies FROM documents d JOIN hashes USING (doc_id) WHERE h <> 0 GROUP BY h)
    SELECT a.head AS a, b.head AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance, a.copies AS copies_a, b.copies AS copies_b FROM heads a JOIN heads b ON a.head < b.head WHERE bit_count(xor(a.h, b.h)) <= 3""")
def simhash_near_dups(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different fingerprints at most three bits apart, between the lowest ids of each, and how many documents each stands for."""
    hashed = near.simhash(table(spark, root, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    return near.near_pairs(hashed.filter("simhash <> 0"), "doc_id", "simhash")


@query()
def dedup_fold(spark: SparkSession, root: str) -> DataFrame:
    """Each document with the older one it folds into: the first of the same text, else the nearest within three bits; null if it stands."""
    docs = table(spark, root, "documents").filter("text IS NOT NULL")
    hashed = near.simhash(docs, "doc_id", "text").join(docs.select("doc_id", F.sha2("text", 256).alias("content")), "doc_id")
    return near.folded(hashed, "doc_id", "simhash", "content")


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderdate AS queued_at, CASE WHEN o_orderstatus = 'O' THEN 'UNPROCESSED' WHEN o_orderstatus = 'P' THEN 'PROCESSING' ELSE 'PROCESSED' END AS status FROM orders),
    t AS (SELECT id FROM q WHERE status = 'UNPROCESSED' ORDER BY queued_at, id LIMIT 100)
    SELECT id, queued_at, CASE WHEN id IN (SELECT id FROM t) THEN 'PROCESSING' ELSE status END AS status FROM q""")
def queue_claim(spark: SparkSession, root: str) -> DataFrame:
    return keyed.claim(queue(spark, root), 100, [F.asc("queued_at"), F.asc("id")])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY THEN 'UNPROCESSED'
        WHEN o_orderstatus = 'O' THEN 'UNPROCESSED' WHEN o_orderstatus = 'P' THEN 'PROCESSING' ELSE 'PROCESSED' END AS status FROM orders""")
def release_stale(spark: SparkSession, root: str) -> DataFrame:
    """Claims older than thirty days before the newest row are given back."""
    rows = queue(spark, root)
    newest = rows.agg(F.max("queued_at").alias("m")).scalar()
    stale = (F.col("status") == "PROCESSING") & (F.col("queued_at") < newest - F.expr("INTERVAL 30 DAYS"))
    return rows.select("id", F.when(stale, "UNPROCESSED").otherwise(F.col("status")).alias("status"))


def queue(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "UNPROCESSED").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("PROCESSED")
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("queued_at"), status.alias("status"))


@query("""SELECT count(*) AS pages, coalesce(sum(length(text)), 0)::BIGINT AS chars, arg_max(id, (fetched_at, id)) AS latest_id, max(fetched_at) AS latest_at FROM crawled_documents WHERE error IS NOT NULL AND fetched_at IS NOT NULL""")
def quarantine_summary(spark: SparkSession, root: str) -> DataFrame:
    failed = table(spark, root, "crawled_documents").filter("error IS NOT NULL AND fetched_at IS NOT NULL")
    return failed.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"), F.max_by("id", F.struct("fetched_at", "id")).alias("latest_id"), F.max("fetched_at").alias("latest_at"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def purge(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    newest = events.agg(F.max("ts").alias("m")).scalar()
    return events.filter(F.col("ts") >= newest - F.expr("INTERVAL 7 DAYS")).select("event_id", "ts")


@query("""SELECT DISTINCT normalized_url FROM crawled_documents WHERE fetched_at >= (SELECT max(fetched_at) FROM crawled_documents) - INTERVAL 30 DAY AND normalized_url IN (SELECT normalized_url FROM page_records)""")
def freshness_semi(spark: SparkSession, root: str) -> DataFrame:
    """Addresses with a record of which any version was fetched in the last thirty days."""
    pages = table(spark, root, "crawled_documents").select("normalized_url", "fetched_at")
    newest = pages.agg(F.max("fetched_at").alias("m")).scalar()
    fresh = pages.filter(F.col("fetched_at") >= newest - F.expr("INTERVAL 30 DAYS"))
    return fresh.join(table(spark, root, "page_records").select("normalized_url"), "normalized_url", "left_semi").select("normalized_url").distinct()


@query("""SELECT DISTINCT crawl_run_id, host FROM crawled_documents WHERE crawl_run_id IS NOT NULL AND host IS NOT NULL AND (crawl_run_id, host) NOT IN
    (SELECT crawl_run_id, host FROM crawled_documents WHERE id % 5 = 0 AND crawl_run_id IS NOT NULL AND host IS NOT NULL)""")
def marker_skip(spark: SparkSession, root: str) -> DataFrame:
    """Sites of runs that no marker says are done."""
    pages = table(spark, root, "crawled_documents").filter("crawl_run_id IS NOT NULL AND host IS NOT NULL")
    done = pages.filter("id % 5 = 0").select("crawl_run_id", "host")
    return pages.select("crawl_run_id", "host").distinct().join(done, ["crawl_run_id", "host"], "left_anti")


@query("""WITH c AS (SELECT host, category, count(DISTINCT normalized_url) AS uses FROM crawled_documents WHERE host IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT host, category, uses FROM c QUALIFY row_number() OVER (PARTITION BY host ORDER BY uses DESC, category) = 1)
    SELECT d.domain, coalesce(d.category, m.category) AS category, m.uses FROM domains d LEFT JOIN m ON m.host = d.domain""")
def mode_per_group(spark: SparkSession, root: str) -> DataFrame:
    """Each domain's category, filled where it is null from what most of its pages have."""
    common = keyed.mode(table(spark, root, "crawled_documents"), "host", "category", "normalized_url").select(F.col("host").alias("domain"), F.col("category").alias("common"), "uses")
    return table(spark, root, "domains").select("domain", "category").join(common, "domain", "left").select("domain", F.coalesce("category", "common").alias("category"), "uses")
