"""Queries on what is kept between runs: queues, domains, quarantine, manifests, labels, the registry of models, and roll-ups as maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import keyed
from weir.plans.geo import LEVELS_SQL, TAGS_SQL, levels, regions
from weir.plans.merge import queue
from weir.plans.registry import query
from weir.sources.tables import table

#: How long after a query a click counts as one of its.
CLICK_SECONDS = 1800


@query("""WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'UNPROCESSED' WHEN o_orderstatus = 'P' THEN 'PROCESSING' ELSE 'PROCESSED' END AS status FROM orders),
    r AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
    SELECT q.id, CASE WHEN status <> 'PROCESSING' OR r.id IS NULL THEN status WHEN bad > 0 THEN 'FAILED' ELSE 'PROCESSED' END AS status, CASE WHEN status = 'PROCESSING' AND bad > 0 THEN bad || ' items returned' END AS error FROM q LEFT JOIN r USING (id)""")
def queue_state(spark: SparkSession, root: str) -> DataFrame:
    """Claimed rows marked as processed or failed with the reason, by what came of them; rows that weren't claimed stay."""
    bad = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    results = bad.select("id", F.when(F.col("bad") > 0, F.concat("bad", F.lit(" items returned"))).alias("error"))
    return keyed.finished(queue(spark, root), results).select("id", "status", "error")


@query("""WITH f AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL OR status_code >= 400) AS bad FROM crawled_documents WHERE host IS NOT NULL GROUP BY host)
    SELECT id, CASE WHEN status IN ('FAILED', 'CRAWLING') AND 20 * bad >= n THEN 'PAUSED' WHEN status = 'PAUSED' AND coalesce(bad, 0) = 0 THEN 'PENDING' ELSE status END AS status FROM domains LEFT JOIN f ON host = domain""")
def domain_status(spark: SparkSession, root: str) -> DataFrame:
    """Domains paused where a twentieth of the fetches fail, and resumed where none does."""
    fetches = table(spark, root, "crawled_documents").filter("host IS NOT NULL").groupBy(F.col("host").alias("domain")).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull() | (F.col("status_code") >= 400)).alias("bad"))
    status = F.when(F.col("status").isin("FAILED", "CRAWLING") & (20 * F.col("bad") >= F.col("n")), "PAUSED").when((F.col("status") == "PAUSED") & (F.coalesce("bad", F.lit(0)) == 0), "PENDING").otherwise(F.col("status"))
    return table(spark, root, "domains").join(fetches, "domain", "left").select("id", status.alias("status"))


@query("""WITH bad AS (SELECT id, content_hash, fetched_at FROM crawled_documents WHERE error IS NOT NULL OR status_code >= 500),
    rec AS (SELECT content_hash AS signature, max(id) AS latest, count(*) AS times FROM bad WHERE content_hash IS NOT NULL GROUP BY 1)
    SELECT 'record' AS what, latest AS id, times FROM rec UNION ALL SELECT 'parked', id, 1 FROM bad UNION ALL SELECT 'kept', crawled_document_id, count(*) FROM page_records WHERE crawled_document_id NOT IN (SELECT id FROM bad) GROUP BY 2""")
def quarantine_state(spark: SparkSession, root: str) -> DataFrame:
    """Quarantine of bad fetches: a record a signature, the source rows parked, and the page records that stay."""
    pages = table(spark, root, "crawled_documents").filter("error IS NOT NULL OR status_code >= 500").select("id", "content_hash")
    records, parked, kept = keyed.quarantined(pages, "content_hash", table(spark, root, "page_records").select(F.col("crawled_document_id").alias("id")), "id")
    named = lambda what, df: df.select(F.lit(what).alias("what"), "id", "times")
    return named("record", records).unionByName(named("parked", parked.withColumn("times", F.lit(1).cast("long")))).unionByName(named("kept", kept.groupBy("id").agg(F.count("*").alias("times"))))


@query(f"""WITH {TAGS_SQL}, {LEVELS_SQL}, e AS (SELECT l.level, l.code, coalesce(d.lang, 'UNCATEGORIZED') AS lang, coalesce(d.source, 'UNCATEGORIZED') AS source FROM levels l JOIN documents d ON d.doc_id = l.page),
    a AS (SELECT level, code, string_agg(lang || ':' || n, ',' ORDER BY lang) AS langs FROM (SELECT level, code, lang, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1, 2), b AS (SELECT level, code, string_agg(source || ':' || n, ',' ORDER BY source) AS sources FROM (SELECT level, code, source, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1, 2)
    SELECT r.level, r.code, coalesce(a.langs, '') AS langs, coalesce(b.sources, '') AS sources FROM regions r LEFT JOIN a USING (level, code) LEFT JOIN b USING (level, code)""")
def geo_count_maps(spark: SparkSession, root: str) -> DataFrame:
    """For every region of every level the documents by language and by source as maps, written in the order of their keys."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("page"), F.coalesce("lang", F.lit("UNCATEGORIZED")).alias("langs"), F.coalesce("source", F.lit("UNCATEGORIZED")).alias("sources"))
    rows = levels(spark, root).join(docs, "page")
    out = regions(spark, root).select("level", "code")
    for name in ("langs", "sources"):
        out = out.join(keyed.count_maps(rows, ["level", "code"], name), ["level", "code"], "left")
    return out.select("level", "code", *[F.coalesce(F.array_join(F.transform(F.sort_array(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","), F.lit("")).alias(name) for name in ("langs", "sources")])


@query(f"""WITH w AS (SELECT max(ts) - INTERVAL 7 DAY AS since, max(ts) AS until FROM events), q AS (SELECT event_id, user_id, ts FROM events, w WHERE event_type = 'view' AND ts >= since AND ts < until), c AS (SELECT user_id, ts FROM events WHERE event_type = 'click')
    SELECT q.event_id, count(c.ts) AS clicks FROM q LEFT JOIN c ON c.user_id = q.user_id AND c.ts >= q.ts AND c.ts < q.ts + INTERVAL {CLICK_SECONDS} SECOND GROUP BY q.event_id""")
def clicks_window(spark: SparkSession, root: str) -> DataFrame:
    """Queries of a window of time and the clicks of the same user soon after each; the clicks may lie beyond the window."""
    events = table(spark, root, "events")
    until = events.agg(F.max("ts").alias("t")).scalar()
    asked = events.filter((F.col("event_type") == "view") & (F.col("ts") < until) & (F.col("ts") >= until - F.expr("INTERVAL 7 DAYS"))).select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"))
    return keyed.followed(asked, clicks, "event_id", "user_id", "ts", "at", CLICK_SECONDS).select("event_id", F.col("n").alias("clicks"))


@query("""SELECT id, domain, count(*) OVER () AS total FROM domains WHERE domain ILIKE '%a%' OR website_name ILIKE '%a%' ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'NORMAL' THEN 1 ELSE 2 END, domain LIMIT 10 OFFSET 5""")
def domain_list(spark: SparkSession, root: str) -> DataFrame:
    """A page of the domains that were looked for, the important ones first, with how many there are."""
    found = table(spark, root, "domains").filter(F.col("domain").ilike("%a%") | F.col("website_name").ilike("%a%"))
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "NORMAL", 1).otherwise(2)
    return found.orderBy(rank, "domain").offset(5).limit(10).select("id", "domain").join(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


@query("""WITH seen AS (SELECT crawl_run_id AS id, count(*) AS documents FROM crawled_documents WHERE crawl_run_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(r.id, s.id) AS id, r.status, r.started_at, coalesce(s.documents, 0) AS documents, row_number() OVER (ORDER BY r.started_at DESC NULLS LAST, coalesce(r.id, s.id) DESC) AS place FROM crawl_runs r FULL JOIN seen s USING (id)""")
def run_list(spark: SparkSession, root: str) -> DataFrame:
    """All runs, the latest first; runs without a manifest come last."""
    seen = table(spark, root, "crawled_documents").filter("crawl_run_id IS NOT NULL").groupBy(F.col("crawl_run_id").alias("id")).agg(F.count("*").alias("documents"))
    every = table(spark, root, "crawl_runs").select("id", "status", "started_at").join(seen, "id", "full_outer").withColumn("documents", F.coalesce("documents", F.lit(0)))
    return keyed.numbered(every, [F.desc_nulls_last("started_at"), F.desc("id")], "place").select("id", "status", "started_at", "documents", F.col("place").cast("long").alias("place"))


@query("""WITH w AS (SELECT max(fetched_at) - INTERVAL 60 DAY AS t FROM crawled_documents)
    SELECT c.id, c.crawl_run_id FROM crawled_documents c LEFT JOIN crawl_runs r ON r.id = c.crawl_run_id, w WHERE c.crawl_run_id IS NOT NULL AND c.fetched_at >= w.t AND r.finished_at IS NULL""")
def run_increment(spark: SparkSession, root: str) -> DataFrame:
    """What an incremental load reads: documents since the watermark of the runs whose manifest isn't finished; finished runs are never listed again."""
    pages = table(spark, root, "crawled_documents").filter("crawl_run_id IS NOT NULL")
    since = table(spark, root, "crawled_documents").agg(F.max("fetched_at").alias("t")).scalar() - F.expr("INTERVAL 60 DAYS")
    done = table(spark, root, "crawl_runs").filter("finished_at IS NOT NULL").select(F.col("id").alias("crawl_run_id"))
    return pages.filter(F.col("fetched_at") >= since).join(done, "crawl_run_id", "left_anti").select("id", "crawl_run_id")


@query("""WITH h AS (SELECT regexp_replace(lower(split_part(host, ':', 1)), '^www\\.', '') AS domain, count(DISTINCT normalized_url) AS pages FROM crawled_documents WHERE host IS NOT NULL GROUP BY 1)
    SELECT coalesce(d.domain, h.domain) AS domain, coalesce(d.status, 'PENDING') AS status, coalesce(d.priority, 'NORMAL') AS priority, d.id IS NULL AS registered, coalesce(h.pages, 0) AS pages FROM domains d FULL JOIN h ON h.domain = d.domain""")
def domain_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The known domains and those of hosts that weren't known, which are registered with defaults."""
    host = F.regexp_replace(F.lower(F.split_part("host", F.lit(":"), F.lit(1))), r"^www\.", "")
    hosts = table(spark, root, "crawled_documents").filter("host IS NOT NULL").groupBy(host.alias("domain")).agg(F.count_distinct("normalized_url").alias("pages"))
    joined = table(spark, root, "domains").select("id", "domain", "status", "priority").join(hosts, "domain", "full_outer")
    return joined.select("domain", F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("priority", F.lit("NORMAL")).alias("priority"), F.col("id").isNull().alias("registered"), F.coalesce("pages", F.lit(0)).alias("pages"))


@query("""WITH l AS (SELECT doc_id, grader, grade_level, published_at FROM reading_labels JOIN documents USING (doc_id)) SELECT doc_id, grader, arg_max(grade_level, (coalesce(published_at, TIMESTAMP '1970-01-01'), grade_level)) AS grade_level FROM l GROUP BY ALL""")
def label_upsert(spark: SparkSession, root: str) -> DataFrame:
    """One label a document and judge: the last that was written."""
    labels = table(spark, root, "reading_labels").join(table(spark, root, "documents").select("doc_id", "published_at"), "doc_id")
    at = F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return labels.groupBy("doc_id", "grader").agg(F.max_by("grade_level", F.struct(at.alias("at"), F.col("grade_level"))).alias("grade_level"))


@query("""WITH asked AS (SELECT model_name AS name, count(*) AS chunks FROM page_embeddings GROUP BY 1), m AS (SELECT name, dimensions, is_default FROM embedding_models WHERE dimensions BETWEEN 1 AND 2000)
    SELECT a.name, a.chunks, coalesce(x.name, y.name, CASE WHEN a.name IS NULL THEN (SELECT name FROM m WHERE is_default) END) AS model FROM asked a LEFT JOIN m x ON x.name = a.name LEFT JOIN m y ON y.name = 'sentence-transformers/' || a.name AND a.name NOT LIKE '%/%'""")
def model_registry(spark: SparkSession, root: str) -> DataFrame:
    """The registered model of each name that is used: itself, the one of its family, or the default where none is named; null if unknown."""
    models = table(spark, root, "embedding_models").filter("dimensions BETWEEN 1 AND 2000").select("name", "is_default")
    used = table(spark, root, "page_embeddings").groupBy(F.col("model_name").alias("name")).agg(F.count("*").alias("chunks"))
    own = models.select(F.col("name").alias("key"), F.col("name").alias("model"), F.lit(0).alias("rank"))
    family = models.filter("name LIKE 'sentence-transformers/%'").select(F.substring_index("name", "/", -1).alias("key"), F.col("name").alias("model"), F.lit(1).alias("rank"))
    default = models.filter("is_default").select(F.lit("").alias("key"), F.col("name").alias("model"), F.lit(2).alias("rank"))
    best = own.unionByName(family).unionByName(default).groupBy("key").agg(F.min_by("model", "rank").alias("model"))
    return used.withColumn("key", F.coalesce("name", F.lit(""))).join(best, "key", "left").select("name", "chunks", "model")


@query("""SELECT n_name AS district, c_mktsegment AS type, count(DISTINCT c_custkey) AS bodies, sum(count(DISTINCT c_custkey)) OVER (PARTITION BY n_name)::BIGINT AS of_district FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def local_summary(spark: SparkSession, root: str) -> DataFrame:
    """Local bodies of each district by type, and in all."""
    from pyspark.sql.window import Window

    named = table(spark, root, "customer").join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = named.groupBy(F.col("n_name").alias("district"), F.col("c_mktsegment").alias("type")).agg(F.count_distinct("c_custkey").alias("bodies"))
    return counted.withColumn("of_district", F.sum("bodies").over(Window.partitionBy("district")))


def download_name(url: Column, kind: Column) -> Column:
    """A safe file name: the last part of an address in plain characters, with an ending by its type if it has none."""
    path = F.regexp_replace(F.trim(url), "[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    plain = F.regexp_replace(F.when(F.coalesce(last, F.lit("")).isin("", "."), "document").otherwise(last), "[^A-Za-z0-9._-]", "-")
    end = F.when(kind.startswith("text/html"), ".html").when(kind == "application/pdf", ".pdf").when(kind.startswith("text/plain"), ".txt").when(kind == "application/xhtml+xml", ".xhtml").otherwise("")
    return F.concat(plain, F.when(plain.rlike(r"\.[^.]*$"), "").otherwise(F.coalesce(end, F.lit(""))))


@query("""WITH p AS (SELECT id, content_type, coalesce(nullif(nullif(split_part(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '/', -1), ''), '.'), 'document') AS last FROM crawled_documents WHERE url IS NOT NULL), s AS (SELECT id, content_type, regexp_replace(last, '[^A-Za-z0-9._-]', '-', 'g') AS name FROM p)
    SELECT id, name || CASE WHEN regexp_matches(name, '\\.[^.]*$') THEN '' WHEN content_type LIKE 'text/html%' THEN '.html' WHEN content_type = 'application/pdf' THEN '.pdf' WHEN content_type LIKE 'text/plain%' THEN '.txt' WHEN content_type = 'application/xhtml+xml' THEN '.xhtml' ELSE '' END AS name FROM s""")
def download_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawled_documents").filter("url IS NOT NULL").select("id", download_name(F.col("url"), F.col("content_type")).alias("name"))
