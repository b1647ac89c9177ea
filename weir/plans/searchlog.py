"""Queries on logs, dashboards and windows over the events and crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.text import micros
from weir.plans.registry import query
from weir.sources.tables import table


@query("""SELECT count(*) AS searches, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS zero_rate,
    round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS click_rate, round(count(*) / epoch(max(ts) - min(ts)), 6) AS per_second FROM events""")
def search_traffic(spark: SparkSession, root: str) -> DataFrame:
    seconds = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    n = F.count("*")
    return table(spark, root, "events").agg(
        n.alias("searches"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.try_divide(F.count_if(F.col("event_type") == "error"), n), 6).alias("zero_rate"),
        F.round(F.try_divide(F.count_if(F.col("event_type") == "click"), n), 6).alias("click_rate"), F.round(F.try_divide(n, seconds), 6).alias("per_second"),
    )


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_queries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS events, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def metrics_windowed(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "events").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("events"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate"), F.round(F.percentile("value", 0.95), 6).alias("p95"))
    return done.select(F.col("w.start").alias("start"), "events", "error_rate", "p95")


@query("""WITH f AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error'))
    SELECT event_id, user_id, n, n >= 5 AS locked FROM f""")
def sliding_failures(spark: SparkSession, root: str) -> DataFrame:
    """Failures of a user within a day, and whether they are five or more."""
    window = Window.partitionBy("user_id").orderBy("second").rangeBetween(-86_399, 0)
    failures = table(spark, root, "events").filter("event_type = 'error'").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    counted = failures.withColumn("n", F.count("*").over(window))
    return counted.select("event_id", "user_id", "n", (F.col("n") >= 5).alias("locked"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return done.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT b + to_minutes(30 * k::INTEGER) - INTERVAL 30 MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), range(2) r(k) GROUP BY 1""")
def sliding(spark: SparkSession, root: str) -> DataFrame:
    """Windows of an hour that begin every half hour."""
    return table(spark, root, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that end after six hours of silence."""
    return table(spark, root, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""SELECT source, status, count(*) AS n, sum(size)::BIGINT AS size, min(moment) AS oldest FROM (SELECT 'pages' AS source, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, coalesce(length(text), 0) AS size, fetched_at AS moment FROM crawled_documents
    UNION ALL SELECT 'documents', CASE WHEN text IS NULL THEN 'failed' ELSE 'ok' END, coalesce(length(text), 0), loaded_at FROM documents) GROUP BY 1, 2""")
def storage_metrics(spark: SparkSession, root: str) -> DataFrame:
    size = F.coalesce(F.char_length("text"), F.lit(0)).alias("size")
    pages = table(spark, root, "crawled_documents").select(F.lit("pages").alias("source"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), size, F.col("fetched_at").alias("moment"))
    docs = table(spark, root, "documents").select(F.lit("documents").alias("source"), F.when(F.col("text").isNull(), "failed").otherwise("ok").alias("status"), size, F.col("loaded_at").alias("moment"))
    return pages.unionByName(docs).groupBy("source", "status").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("moment").alias("oldest"))


@query("""SELECT t.event_type, count(e.event_id) AS n FROM (SELECT unnest(['view', 'signup', 'purchase', 'error', 'click', 'refund']) AS event_type) t LEFT JOIN events e ON e.event_type = t.event_type GROUP BY 1""")
def errors_by_severity(spark: SparkSession, root: str) -> DataFrame:
    """Every kind has a row, also without events."""
    kinds = spark.sql("SELECT explode(array('view', 'signup', 'purchase', 'error', 'click', 'refund')) AS event_type")
    counted = table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.join(counted, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT (SELECT count(*) FROM crawled_documents) AS fetches, (SELECT count(DISTINCT normalized_url) FROM crawled_documents) AS pages, (SELECT count(*) FROM domains) AS domains, (SELECT count(*) FROM crawl_runs WHERE finished_at IS NULL) AS open_runs,
    (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def dashboard_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row out of scalar subqueries, each its own small aggregate."""
    pages = table(spark, root, "crawled_documents")
    parts = {
        "fetches": pages.agg(F.count("*")), "pages": pages.agg(F.count_distinct("normalized_url")), "domains": table(spark, root, "domains").agg(F.count("*")),
        "open_runs": table(spark, root, "crawl_runs").filter("finished_at IS NULL").agg(F.count("*")), "errors": table(spark, root, "events").filter("event_type = 'error'").agg(F.count("*")),
    }
    return spark.range(1).select(*[part.scalar().alias(name) for name, part in parts.items()])


@query("SELECT coalesce(category, '') AS category, count(*) AS n FROM crawled_documents GROUP BY 1")
def count_by_category(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crawled_documents").groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT id, fetched_at, (SELECT count(*) FROM crawled_documents WHERE status_code = 200) AS total FROM crawled_documents WHERE status_code = 200 ORDER BY fetched_at DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def page_limit_offset(spark: SparkSession, root: str) -> DataFrame:
    fine = table(spark, root, "crawled_documents").filter("status_code = 200").select("id", "fetched_at")
    total = fine.agg(F.count("*")).scalar()
    return fine.orderBy(F.desc_nulls_last("fetched_at"), "id").offset(40).limit(20).withColumn("total", total)


@query(r"""SELECT domain, priority FROM domains WHERE domain ILIKE '%pani%' ESCAPE '\' OR website_name ILIKE '%pani%' ESCAPE '\'""")
def ilike_search(spark: SparkSession, root: str) -> DataFrame:
    """Domains with a word in one of two columns, whatever its case; the word's own wildcards are escaped."""
    return contains(table(spark, root, "domains"), ["domain", "website_name"], "pani").select("domain", "priority")


def contains(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    pattern = "%" + "".join("\\" + c if c in "\\%_" else c for c in word) + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return df.filter(found)


@query("SELECT DISTINCT host FROM crawled_documents WHERE host IS NOT NULL EXCEPT SELECT domain FROM domains")
def set_diff_codes(spark: SparkSession, root: str) -> DataFrame:
    """Hosts that no domain knows."""
    return table(spark, root, "crawled_documents").select("host").filter("host IS NOT NULL").subtract(table(spark, root, "domains").select(F.col("domain").alias("host")))


@query("""SELECT crawl_run_id, count(*) FILTER (WHERE error IS NULL AND coalesce(status_code, 0) < 400) AS saved, count(*) FILTER (WHERE error IS NULL AND status_code >= 400) AS rejected, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM crawled_documents GROUP BY 1""")
def run_summary(spark: SparkSession, root: str) -> DataFrame:
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("status_code", F.lit(0)) < 400, "saved").otherwise("rejected")
    pivoted = table(spark, root, "crawled_documents").withColumn("outcome", outcome).groupBy("crawl_run_id").pivot("outcome", ["saved", "rejected", "failed"]).count()
    return pivoted.select("crawl_run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "rejected", "failed")])


@query("""WITH l AS (SELECT host, lower(trim(regexp_replace(w, '\\s+', ' ', 'g'))) AS key, w FROM (SELECT host, unnest(list_transform(headings, lambda h: h.text)) AS w FROM crawled_documents WHERE host IS NOT NULL) WHERE w IS NOT NULL)
    SELECT host, key, count(*) AS mentions, min(w) AS name FROM l GROUP BY 1, 2""")
def entity_merge(spark: SparkSession, root: str) -> DataFrame:
    """Headings as entities of a host: equal but for case and spacing, mentions added up."""
    names = table(spark, root, "crawled_documents").filter("host IS NOT NULL").select("host", F.explode("headings.text").alias("w")).filter("w IS NOT NULL")
    return names.groupBy("host", F.lower(F.trim(F.regexp_replace("w", r"\s+", " "))).alias("key")).agg(F.count("*").alias("mentions"), F.min("w").alias("name"))
