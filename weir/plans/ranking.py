"""Queries on retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.text import detected_language, micros
from weir.operators import keyed, rank

from weir.plans.registry import literal, query
from weir.sources.tables import table

TOKEN_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+')"
#: Rounds of PageRank at most, and the change (sum over all pages) below which they end.
MOST_ROUNDS, TOLERANCE = 100, 1e-8
#: Rounds of the SQL that the ranks are compared with: more than the tolerance takes on these graphs.
SQL_ROUNDS = 16
TERMS = ["water", "board", "ward", "खानेपानी"]
BM25_SQL = f"""tok AS (SELECT doc_id, {TOKEN_SQL} AS t FROM documents WHERE text IS NOT NULL),
    doc AS (SELECT doc_id, len(t) AS length, t FROM tok WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(length) AS mean FROM doc),
    tf AS (SELECT doc_id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM doc) WHERE term IN ('water', 'board', 'ward', 'खानेपानी') GROUP BY doc_id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, term")
def inverted_index(spark: SparkSession, root: str) -> DataFrame:
    return rank.postings(table(spark, root, "documents"), "doc_id", "text")


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_search(spark: SparkSession, root: str) -> DataFrame:
    scored = rank.bm25(table(spark, root, "documents"), "doc_id", "text", TERMS)
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10""")
def vector_search(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    target = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    return rank.nearest(vectors, "vec_id", "embedding", target, 10).withColumn("similarity", F.round("similarity", 6))


@query("""WITH cur AS (SELECT id AS page_id, content_hash FROM crawled_documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)
    SELECT page_id, content_hash FROM cur WHERE NOT EXISTS (SELECT 1 FROM page_embeddings e WHERE e.page_id = cur.page_id AND e.content_hash = cur.content_hash AND e.model_name = 'gaun-embed-base')""")
def missing_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Newest pages without a vector of the default model for what they hold now."""
    current = keyed.latest(table(spark, root, "crawled_documents").filter("text IS NOT NULL"), ["normalized_url"], [F.desc_nulls_last("fetched_at"), F.desc("id")]).select(F.col("id").alias("page_id"), "content_hash")
    have = table(spark, root, "page_embeddings").filter("model_name = 'gaun-embed-base'").select("page_id", "content_hash")
    return current.join(have, ["page_id", "content_hash"], "left_anti")


@query("""WITH x AS (SELECT e.page_id, e.embedding, m.dimensions AS d FROM page_embeddings e JOIN embedding_models m ON m.name = e.model_name AND len(e.embedding) = m.dimensions WHERE m.is_default),
    f AS (SELECT * FROM x WHERE len(list_filter(embedding, lambda v: isnan(v))) = 0),
    p AS (SELECT page_id, k, avg(v::DOUBLE) AS m FROM (SELECT page_id, unnest(range(d)) AS k, unnest(embedding) AS v FROM f) GROUP BY page_id, k)
    SELECT page_id, round(sqrt(sum(m * m)), 5) AS length, round(max(m) / nullif(sqrt(sum(m * m)), 0), 5) AS largest FROM p GROUP BY page_id""")
def embedding_mean_pool(spark: SparkSession, root: str) -> DataFrame:
    """The mean vector of each page's chunks of the default model, by its length and, once it has length one, its largest value."""
    models = table(spark, root, "embedding_models").filter("is_default").select(F.col("name").alias("model_name"), F.col("dimensions").alias("size"))
    fine = table(spark, root, "page_embeddings").join(models, "model_name").filter("size(embedding) = size AND NOT exists(embedding, x -> isnan(x))")
    mean = fine.select("page_id", F.posexplode("embedding").alias("k", "v")).groupBy("page_id", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")))
    return mean.groupBy("page_id").agg(F.round(length, 5).alias("length"), F.round(F.max("m") / F.nullif(length, F.lit(0.0)), 5).alias("largest"))


@query("""WITH b AS (SELECT unnest([1, 2, 1]) AS d, unnest([1, 2, 3]) AS r), v AS (SELECT unnest([2, 3]) AS d, unnest([1, 2]) AS r),
    a AS (SELECT d, min(r) AS r FROM b GROUP BY d UNION ALL SELECT d, min(r) FROM v GROUP BY d) SELECT d AS doc, round(sum(1.0 / (60 + r)), 9) AS score FROM a GROUP BY d""")
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    lexical, dense = literal(spark, "(1, 1), (2, 2), (1, 3)", "t(doc, rank)"), literal(spark, "(2, 1), (3, 2)", "t(doc, rank)")
    return rank.fused([lexical, dense], "doc").select("doc", F.round("score", 9).alias("score"))


@query(f"""WITH {BM25_SQL}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored QUALIFY r <= 100),
    vs AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    den AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS r FROM vs QUALIFY r <= 100),
    f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY doc_id)
    SELECT f.doc_id, round(f.score, 9) AS score, d.source FROM f JOIN documents d USING (doc_id) ORDER BY round(f.score, 9) DESC, f.doc_id LIMIT 20""")
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    """Lexical and vector candidates, fused by rank, then read from their documents; candidates without a document drop out."""
    docs, vectors = table(spark, root, "documents"), table(spark, root, "embeddings")
    lexical = rank.bm25(docs, "doc_id", "text", TERMS).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(100)
    target = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    dense = rank.nearest(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", target, 100).withColumn("similarity", F.round("similarity", 9))
    scores = rank.fused([rank.ranked(lexical, "doc_id", "score").select("doc_id", "rank"), rank.ranked(dense, "doc_id", "similarity").select("doc_id", "rank")], "doc_id")
    read = docs.select("doc_id", "source").join(F.broadcast(scores), "doc_id")  # at most 200 candidates
    return read.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score", "source")


NEWEST_SQL = """pages AS (SELECT id AS page, normalized_url AS url, host, title FROM crawled_documents WHERE normalized_url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)"""
# the crawl's links lead to pages that were never stored, so the link graph is made of suppliers and their parts
PAGES_SQL = """pages AS (SELECT s_suppkey AS page, 'https://' || s_suppkey || '.example' || CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END AS url, s_nationkey AS host, items, latest FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS items, max(l_shipdate) AS latest FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
    l AS (SELECT DISTINCT l_suppkey AS src, 'https://' || (1 + l_partkey % (SELECT count(*) FROM supplier)) || '.example' || CASE WHEN l_partkey % 3 = 0 THEN '/' ELSE '' END AS link FROM lineitem), v AS (SELECT src, link AS url FROM l UNION SELECT src, rtrim(link, '/') FROM l UNION SELECT src, rtrim(link, '/') || '/' FROM l),
    edges AS MATERIALIZED (SELECT DISTINCT v.src, p.page AS dst FROM v JOIN pages p ON p.url = v.url WHERE v.src <> p.page)"""


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of each page."""
    found = keyed.latest(table(spark, root, "crawled_documents"), ["normalized_url"], [F.desc_nulls_last("fetched_at"), F.desc("id")])
    return found.select(F.col("id").alias("page"), F.col("normalized_url").alias("url"), "host", "title")


def pages_of(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers as pages that link to others by all their items; some name themselves with a slash at the end, some links do."""
    suppliers, items = table(spark, root, "supplier"), table(spark, root, "lineitem")
    n = suppliers.agg(F.count("*").alias("n")).scalar()
    link = F.concat(F.lit("https://"), 1 + F.col("l_partkey") % n, F.lit(".example"), F.when(F.col("l_partkey") % 3 == 0, "/").otherwise(""))
    about = items.groupBy(F.col("l_suppkey").alias("page")).agg(F.count("*").alias("items"), F.max("l_shipdate").alias("latest"), F.collect_set(link).alias("links"))
    url = F.concat(F.lit("https://"), F.col("s_suppkey"), F.lit(".example"), F.when(F.col("s_suppkey") % 2 == 0, "/").otherwise(""))
    return suppliers.select(F.col("s_suppkey").alias("page"), url.alias("url"), F.col("s_nationkey").alias("host")).join(about, "page", "left")


@query(f"WITH {PAGES_SQL} SELECT src, dst FROM edges")
def link_edges(spark: SparkSession, root: str) -> DataFrame:
    return rank.edges(pages_of(spark, root))


@query(f"""WITH {PAGES_SQL} SELECT p.page, count(e.src) AS inbound, count(CASE WHEN p.host IS NOT NULL AND s.host IS DISTINCT FROM p.host AND e.src IS NOT NULL THEN 1 END) AS inbound_other
    FROM pages p LEFT JOIN edges e ON e.dst = p.page LEFT JOIN pages s ON s.page = e.src GROUP BY p.page""")
def link_stats(spark: SparkSession, root: str) -> DataFrame:
    pages = pages_of(spark, root)
    hosts = pages.select("page", "host")
    found = rank.edges(pages).join(hosts.select(F.col("page").alias("src"), F.col("host").alias("from")), "src").join(hosts.select(F.col("page").alias("dst"), F.col("host").alias("to")), "dst")
    counted = found.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("inbound"), F.count_if(F.col("to").isNotNull() & ~F.col("from").eqNullSafe(F.col("to"))).alias("inbound_other"))
    return hosts.select("page").join(counted, "page", "left").select("page", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("inbound_other", F.lit(0)).alias("inbound_other"))


def unrolled(rounds: int) -> str:
    """The rounds of PageRank as common table expressions."""
    steps = ["deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM edges GROUP BY src), cnt AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM pages), r0 AS MATERIALIZED (SELECT page, 1.0::DOUBLE / n AS rank FROM pages, cnt)"]
    for k in range(rounds):
        steps.append(f"l{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE page NOT IN (SELECT src FROM deg)), g{k} AS MATERIALIZED (SELECT e.dst AS page, sum(r.rank / d.degree) AS given FROM edges e JOIN r{k} r ON r.page = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst), r{k + 1} AS MATERIALIZED (SELECT r.page, (0.15 + 0.85 * lost) / n + 0.85 * coalesce(given, 0) AS rank FROM r{k} r LEFT JOIN g{k} USING (page), l{k}, cnt)")
    return ", ".join(steps)


@query(f"WITH {PAGES_SQL}, {unrolled(SQL_ROUNDS)} SELECT page AS node, round(rank, 9) AS rank FROM r{SQL_ROUNDS}")
def pagerank(spark: SparkSession, root: str) -> DataFrame:
    pages = pages_of(spark, root)
    return rank.pagerank(pages.select(F.col("page").alias("node")), rank.edges(pages), MOST_ROUNDS, TOLERANCE).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH {PAGES_SQL}, {unrolled(SQL_ROUNDS)}, x AS (SELECT p.host, sum(rank) * any_value(n) AS v FROM pages p JOIN r{SQL_ROUNDS} USING (page), cnt WHERE p.host IS NOT NULL GROUP BY p.host)
    SELECT host, round(least(1.0, ln(1 + v) / ln(1 + (SELECT max(v) FROM x))), 6) AS authority FROM x""")
def domain_authority(spark: SparkSession, root: str) -> DataFrame:
    pages = pages_of(spark, root)
    ranks = rank.pagerank(pages.select(F.col("page").alias("node")), rank.edges(pages), MOST_ROUNDS, TOLERANCE)
    return authority(pages, ranks).select("host", F.round("authority", 6).alias("authority"))


def authority(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    n = ranks.agg(F.count("*").alias("n")).scalar()
    summed = pages.select(F.col("page").alias("node"), "host").filter("host IS NOT NULL").join(ranks, "node").groupBy("host").agg((F.sum("rank") * n).alias("v"))
    return summed.select("host", rank.log_scale(F.col("v"), summed.agg(F.max("v").alias("m")).scalar()).alias("authority"))


@query(f"""WITH {PAGES_SQL}, {unrolled(SQL_ROUNDS)}, nw AS (SELECT max(latest) AS t FROM pages),
    a AS (SELECT host, sum(rank) * any_value(n) AS v FROM pages p JOIN r{SQL_ROUNDS} USING (page), cnt WHERE host IS NOT NULL GROUP BY host),
    s AS (SELECT p.page, least(1.0, ln(1 + r.rank * n) / ln(1 + (SELECT max(rank) FROM r{SQL_ROUNDS}) * n)) AS pr, coalesce(least(1.0, ln(1 + a.v) / ln(1 + (SELECT max(v) FROM a))), 0) AS authority,
        least(1.0, ln(1 + coalesce(p.items, 0)) / ln(1001)) AS quality,
        CASE WHEN p.latest IS NULL THEN 0 ELSE pow(0.5, epoch(nw.t - p.latest) / 86400.0 / 180) END AS freshness FROM pages p JOIN r{SQL_ROUNDS} r USING (page) LEFT JOIN a ON a.host = p.host, cnt, nw)
    SELECT page, round(quality, 6) AS quality, round(freshness, 6) AS freshness, round(greatest(0, least(1, 0.4 * pr + 0.2 * authority + 0.2 * quality + 0.2 * freshness)), 6) AS static_rank FROM s""")
def page_scores(spark: SparkSession, root: str) -> DataFrame:
    """Rank, authority, length and age of each page in one score."""
    pages = pages_of(spark, root)
    ranks = rank.pagerank(pages.select(F.col("page").alias("node")), rank.edges(pages), MOST_ROUNDS, TOLERANCE)
    hosts = authority(pages, ranks)
    n, top, now = ranks.agg(F.count("*").alias("n")).scalar(), ranks.agg(F.max("rank").alias("m")).scalar(), pages.agg(F.max("latest").alias("t")).scalar()
    joined = pages.join(ranks.withColumnRenamed("node", "page"), "page").join(hosts, "host", "left")
    quality = F.least(F.lit(1.0), F.log1p(F.coalesce("items", F.lit(0))) / F.log1p(F.lit(1000)))
    age = (micros(now) - micros("latest")) / 86_400e6
    freshness = F.coalesce(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / 180), F.lit(0.0))
    scored = joined.select("page", rank.log_scale(F.col("rank") * n, top * n).alias("pr"), F.coalesce("authority", F.lit(0.0)).alias("authority"), quality.alias("quality"), freshness.alias("freshness"))
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("0.4D * pr + 0.2D * authority + 0.2D * quality + 0.2D * freshness")))
    return scored.select("page", F.round("quality", 6).alias("quality"), F.round("freshness", 6).alias("freshness"), F.round(total, 6).alias("static_rank"))


@query("""WITH d AS (SELECT doc_id, string_split_regex(lower(trim(coalesce(title, ''))), '\\s+') AS tt, length(text) AS n, lang, published_at, loaded_at FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, round(len(list_intersect(tt, ['water', 'board', 'plan'])) / 3.0, 6) AS title_match, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS language_match,
        round(1.0 / (1 + greatest(0, floor(epoch((SELECT max(loaded_at) FROM documents) - coalesce(published_at, loaded_at)) / 86400)) / 365.0), 6) AS freshness, n::BIGINT AS content_length FROM d""")
def rerank_features(spark: SparkSession, root: str) -> DataFrame:
    """Features of documents for a query of three terms in English."""
    docs = table(spark, root, "documents")
    now = docs.agg(F.max("loaded_at").alias("t")).scalar()
    title = F.split(F.lower(F.trim(F.coalesce("title", F.lit("")))), r"\s+")
    match = F.size(F.array_intersect(title, F.array(*map(F.lit, ("water", "board", "plan"))))) / 3
    days = F.floor((micros(now) - micros(F.coalesce("published_at", "loaded_at"))) / 86_400e6)
    return docs.filter("text IS NOT NULL").select(
        "doc_id", F.round(match, 6).alias("title_match"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("language_match"), F.round(1 / (1 + F.greatest(days, F.lit(0)) / 365), 6).alias("freshness"), F.char_length("text").cast("long").alias("content_length")
    )


@query("""SELECT doc_id, count(*) AS labels, round(avg(grade_level), 2) AS grade FROM reading_labels GROUP BY doc_id HAVING count(*) >= 2""")
def training_examples(spark: SparkSession, root: str) -> DataFrame:
    """Mean grades of rows with at least two judgements."""
    return table(spark, root, "reading_labels").groupBy("doc_id").agg(F.count("*").alias("labels"), F.round(F.avg("grade_level"), 2).alias("grade")).filter("labels >= 2")


@query("""WITH j AS (SELECT d.source AS q, d.doc_id, avg(r.grade_level) AS g FROM reading_labels r JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY q ORDER BY g DESC, doc_id) AS i FROM j)
    SELECT q AS query, round(sum(CASE WHEN r <= 5 THEN (pow(2, g) - 1) / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN (pow(2, g) - 1) / log2(i + 1) ELSE 0 END), 6) AS ndcg FROM a GROUP BY q""")
def ndcg(spark: SparkSession, root: str) -> DataFrame:
    """How near the order by id comes to the order by grade, per source, among the first five."""
    grades = table(spark, root, "reading_labels").join(table(spark, root, "documents").select("doc_id", F.col("source").alias("query")), "doc_id").filter("query IS NOT NULL").groupBy("query", "doc_id").agg(F.avg("grade_level").alias("g"))
    own = Window.partitionBy("query")
    placed = grades.withColumn("r", F.row_number().over(own.orderBy("doc_id"))).withColumn("i", F.row_number().over(own.orderBy(F.desc("g"), "doc_id")))
    gain = lambda place: F.sum(F.when(F.col(place) <= 5, (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))
    return placed.groupBy("query").agg(F.round(gain("r") / gain("i"), 6).alias("ndcg"))


@query(f"""WITH {NEWEST_SQL} SELECT p.page, coalesce(p.title, p.url) AS title, d.website_name, d.category, r.word_count, e.chunks FROM pages p LEFT JOIN domains d ON d.domain = p.host
    LEFT JOIN (SELECT * FROM page_records QUALIFY row_number() OVER (PARTITION BY crawled_document_id ORDER BY fetched_at DESC NULLS LAST, word_count DESC NULLS LAST) = 1) r ON r.crawled_document_id = p.page
    LEFT JOIN (SELECT page_id, count(*) AS chunks FROM page_embeddings GROUP BY 1) e ON e.page_id = p.page""")
def search_documents(spark: SparkSession, root: str) -> DataFrame:
    """A flat row for each page: its domain, its latest record, its chunks."""
    records = keyed.latest(table(spark, root, "page_records"), ["crawled_document_id"], [F.desc_nulls_last("fetched_at"), F.desc_nulls_last("word_count")]).select(F.col("crawled_document_id").alias("page"), "word_count")
    chunks = table(spark, root, "page_embeddings").groupBy(F.col("page_id").alias("page")).agg(F.count("*").alias("chunks"))
    hosts = table(spark, root, "domains").select(F.col("domain").alias("host"), "website_name", "category")
    joined = newest(spark, root).join(hosts, "host", "left").join(records, "page", "left").join(chunks, "page", "left")
    return joined.select("page", F.coalesce("title", "url").alias("title"), "website_name", "category", "word_count", "chunks")


@query("""SELECT id FROM crawled_documents c WHERE status_code = 200 AND category IS NOT NULL AND EXISTS (SELECT 1 FROM page_records r WHERE r.crawled_document_id = c.id AND NOT r.noindex AND r.word_count >= 50)""")
def search_filters(spark: SparkSession, root: str) -> DataFrame:
    """Pages of which one and the same record passes all filters."""
    return filtered(table(spark, root, "crawled_documents"), table(spark, root, "page_records"), status=200, least_words=50, category="all").select("id")


def filtered(pages: DataFrame, records: DataFrame, status: int | None = None, least_words: int | None = None, category: str | None = None) -> DataFrame:
    """Optional filters: None and "" are no filter, "all" takes any category that is there."""
    if status is not None:
        pages = pages.filter(F.col("status_code") == status)
    if category:
        pages = pages.filter(F.col("category").isNotNull() if category == "all" else F.col("category") == category)
    if least_words is not None:
        fine = records.filter((~F.col("noindex")) & (F.col("word_count") >= least_words)).select(F.col("crawled_document_id").alias("id"))
        pages = pages.join(fine, "id", "left_semi")
    return pages


@query("""SELECT k.page, k.place, d.title, (SELECT count(*) FROM page_embeddings e WHERE e.page_id = k.page) AS chunks FROM (SELECT * FROM (VALUES (5, 1), (3, 2), (7, 3), (-1, 4)) v(page, place)) k JOIN crawled_documents d ON d.id = k.page""")
def doc_assembly(spark: SparkSession, root: str) -> DataFrame:
    """Wanted documents in the order they were asked for; unknown ids are skipped."""
    wanted = literal(spark, "(5L, 1), (3L, 2), (7L, 3), (-1L, 4)", "t(page, place)")
    chunks = table(spark, root, "page_embeddings").join(F.broadcast(wanted.withColumnRenamed("page", "page_id")), "page_id", "left_semi").groupBy(F.col("page_id").alias("page")).agg(F.count("*").alias("chunks"))
    return table(spark, root, "crawled_documents").select(F.col("id").alias("page"), "title").join(F.broadcast(wanted), "page").join(chunks, "page", "left").select("page", "place", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""SELECT id, url FROM crawled_documents c WHERE content_hash NOT IN (SELECT content_hash FROM crawled_documents WHERE error IS NOT NULL AND content_hash IS NOT NULL) AND content_hash IS NOT NULL
    AND id IN (SELECT min(id) FROM crawled_documents GROUP BY content_hash)""")
def file_location(spark: SparkSession, root: str) -> DataFrame:
    """Places of pages that are the first of their content, of which no copy failed."""
    pages = table(spark, root, "crawled_documents").select("id", "url", "content_hash", "error").filter("content_hash IS NOT NULL")
    first = pages.groupBy("content_hash").agg(F.min("id").alias("id"), F.count("error").alias("failed")).filter("failed = 0").select("id")
    return pages.join(first, "id", "left_semi").select("id", "url")


@query("""SELECT doc_id, left(text, 300) AS summary, length(text)::BIGINT AS content_length, coalesce(nullif(title, ''), url) AS title FROM documents WHERE text IS NOT NULL""")
def index_projection(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.left("text", F.lit(300)).alias("summary"), F.char_length("text").cast("long").alias("content_length"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"))


@query(r"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{0904}-\x{0939}\x{0958}-\x{0961}\x{0972}-\x{097F}\x{093D}\x{0950}\x{0971}]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL OR d + l = 0 THEN 'unknown' WHEN d >= 0.8 * (d + l) THEN 'ne' WHEN l >= 0.8 * (d + l) THEN 'en' ELSE 'mixed' END AS language FROM t""")
def detect_language(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", detected_language(F.col("text")).alias("language"))
