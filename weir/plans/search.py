"""Queries of the search stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.operators import keyed, rank, search
from weir.plans.registry import query
from weir.sources.tables import table

WORDS_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+')"
# DuckDB's edit distance counts bytes: letters of Devanagari are put into one byte each that no token holds
LETTERS = "".join(chr(c) for c in range(0x901, 0x958) if c not in (0x904, 0x90C, 0x90D, 0x90E))
BYTES = "".join(c for c in map(chr, range(1, 127)) if not (c.isdigit() or c.islower() or c in "'`_ {}"))[: len(LETTERS)]
EDITS_SQL = f"levenshtein(translate(word, '{LETTERS}', '{BYTES}'), translate(term, '{LETTERS}', '{BYTES}'))"
VARIANTS = ["water bord", "school meals", "खानेपानी"]
BOOSTS = {"title": 3.0, "text": 1.0}


@query(f"""WITH f AS (SELECT doc_id, 'title' AS field, {WORDS_SQL.format("title")} AS t FROM documents UNION ALL SELECT doc_id, 'text', {WORDS_SQL.format("text")} FROM documents),
    d AS (SELECT doc_id, field, t, len(t) AS length FROM f WHERE len(t) > 0), st AS (SELECT field, count(*) AS n, avg(length) AS mean FROM d GROUP BY field),
    po AS (SELECT field, term, doc_id, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, field, length, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM po GROUP BY ALL),
    v AS (SELECT term, sum(df) AS uses FROM df GROUP BY term), a AS (SELECT * FROM (VALUES (0, 'water'), (0, 'bord'), (1, 'school'), (1, 'meals'), (2, 'खानेपानी')) x(variant, word)),
    x AS (SELECT word, term, uses, edits AS d FROM (SELECT DISTINCT word FROM a) w, LATERAL (SELECT term, uses, {EDITS_SQL} AS edits FROM v WHERE left(term, 1) = left(word, 1)) WHERE edits <= CASE WHEN length(word) < 3 THEN 0 WHEN length(word) < 6 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, uses DESC, term) <= 20),
    w AS (SELECT po.doc_id, a.variant, po.field, a.word, max(CASE po.field WHEN 'title' THEN 3.0 ELSE 1.0 END * (1 - d / least(length(a.word), length(x.term))::DOUBLE) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * po.length / mean))) AS s
        FROM a JOIN x USING (word) JOIN po ON po.term = x.term JOIN df ON df.field = po.field AND df.term = po.term JOIN st ON st.field = po.field GROUP BY ALL),
    b AS (SELECT doc_id, variant, max(s) AS s FROM (SELECT doc_id, variant, field, sum(s) AS s FROM w GROUP BY ALL) GROUP BY ALL)
    SELECT doc_id, round(sum(s), 6) AS score FROM b GROUP BY doc_id""")
def field_search(spark: SparkSession, root: str) -> DataFrame:
    """Variants of a query over title and text of a stored index, with misspelt words: best field of each variant, the variants added up."""
    index = search.Index(table(spark, root, "documents"), "doc_id", ["title", "text"])
    return index.search(spark, VARIANTS, BOOSTS).select("doc_id", F.round("score", 6).alias("score"))


TARGET_SQL = """(SELECT embedding::DOUBLE[] AS q FROM page_embeddings e JOIN embedding_models m ON m.name = e.model_name AND m.is_default AND len(e.embedding) = m.dimensions
    WHERE len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1)"""


@query(f"""WITH q AS {TARGET_SQL}, f AS (SELECT e.page_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q) AS d FROM page_embeddings e JOIN embedding_models m ON m.name = e.model_name AND m.is_default AND len(e.embedding) = m.dimensions
    JOIN crawled_documents c ON c.id = e.page_id AND c.content_hash = e.content_hash, q WHERE len(list_filter(e.embedding, lambda x: isnan(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)
    SELECT page_id, round(min(d), 6) AS distance FROM f GROUP BY page_id ORDER BY min(d), page_id LIMIT 10""")
def chunk_search(spark: SparkSession, root: str) -> DataFrame:
    """The pages with the nearest chunk of the default model, of what they hold now."""
    chunks, models = table(spark, root, "page_embeddings"), table(spark, root, "embedding_models")
    default = models.filter("is_default").first()
    usable = "model_name = '{}' AND size(embedding) = {} AND NOT exists(embedding, x -> isnan(x)) AND exists(embedding, x -> x <> 0)"
    target = chunks.filter(usable.format(default["name"], default["dimensions"])).orderBy("id").first()["embedding"]
    found = search.best_chunks(chunks, table(spark, root, "crawled_documents"), models, [float(x) for x in target], default["name"], 10)
    return found.select("page_id", F.round("distance", 6).alias("distance"))


QUERY_SQL = f"""toks AS (SELECT doc_id, {WORDS_SQL.format("text")} AS t FROM documents WHERE text IS NOT NULL), doc AS (SELECT doc_id, len(t) AS length, t FROM toks WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(length) AS mean FROM doc),
    tf AS (SELECT doc_id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM doc) WHERE term IN ('water', 'board', 'plan') GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    lex AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id ORDER BY round(score, 9) DESC, doc_id LIMIT 100),
    den AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(s, 9) DESC, e.vec_id LIMIT 100),
    lr AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM lex), dr AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS r FROM den),
    fus AS (SELECT doc_id, sum(1.0 / (60 + r)) AS fusion FROM (SELECT doc_id, r FROM lr UNION ALL SELECT doc_id, r FROM dr) GROUP BY doc_id),
    cand AS (SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.score, 0) AS bm25_score, coalesce(d.s, 0) AS vector_score, concat_ws(',', CASE WHEN d.doc_id IS NOT NULL THEN 'dense' END, CASE WHEN l.doc_id IS NOT NULL THEN 'lexical' END) AS sources FROM lr l FULL JOIN dr d USING (doc_id)),
    hyd AS (SELECT c.*, f.fusion, row_number() OVER (ORDER BY round(f.fusion, 12) DESC, c.doc_id) AS before, d.title, d.text, d.lang, d.published_at, length(d.text)::DOUBLE AS content_length FROM cand c JOIN fus f USING (doc_id) JOIN documents d USING (doc_id))"""


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """Lexical and dense candidates of one request, fused, merged, and those without a document dropped; at most two hundred rows."""
    docs, vectors = table(spark, root, "documents"), table(spark, root, "embeddings")
    lexical = rank.bm25(docs, "doc_id", "text", ["water", "board", "plan"]).withColumn("by", F.round("score", 9)).orderBy(F.desc("by"), "doc_id").limit(100)
    target = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    dense = rank.nearest(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", target, 100).withColumn("by", F.round("similarity", 9))
    fused = rank.fused([rank.ranked(df, "doc_id", "by").select("doc_id", "rank") for df in (lexical, dense)], "doc_id")
    both = search.merged({"lexical": lexical.select("doc_id", F.col("score").alias("bm25_score")), "dense": dense.select("doc_id", F.col("similarity").alias("vector_score"))}, "doc_id", ["bm25_score", "vector_score"], [])
    read = docs.select("doc_id", "title", "text", F.col("lang").alias("language"), "published_at", F.char_length("text").alias("content_length")).join(F.broadcast(both.join(fused, "doc_id")), "doc_id")
    return rank.ranked(read.withColumn("by", F.round("score", 12)), "doc_id", "by").withColumnRenamed("rank", "before")


@query(f"WITH {QUERY_SQL} SELECT doc_id, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, sources, before FROM hyd")
def candidate_merge(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of both kinds as one row each, in the order of their fusion."""
    return candidates(spark, root).select("doc_id", F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"), F.array_join("sources", ",").alias("sources"), "before")


FEATURES_SQL = """feat AS (SELECT doc_id, before, bm25_score AS b, vector_score AS v, CASE WHEN len(list_intersect(string_split_regex(lower(coalesce(title, '')), '\\s+'), ['water', 'board', 'plan'])) > 0 THEN 1.0 ELSE 0.0 END AS title_match,
    CASE WHEN published_at IS NULL THEN 0 ELSE 1.0 / (1 + greatest(0, floor(epoch((SELECT max(loaded_at) FROM documents) - published_at) / 86400)) / 365.0) END AS freshness, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS language_match,
    len(list_intersect(list_distinct(string_split_regex(lower(concat_ws(' ', title, text)), '[ \\t\\n\\x0b\\f\\r]+')), ['water', 'board', 'plan'])) / 3.0 AS term_ratio, coalesce(content_length, 0) AS content_length FROM hyd)"""


def featured(spark: SparkSession, root: str) -> DataFrame:
    now = table(spark, root, "documents").agg(F.max("loaded_at").alias("t")).scalar()
    return search.with_features(candidates(spark, root), "water board plan", "en", now)


@query(f"""WITH {QUERY_SQL}, {FEATURES_SQL} SELECT doc_id, round(b, 6) AS bm25_score, round(v, 6) AS vector_score, title_match, 0.0::DOUBLE AS geo_match, round(freshness, 6) AS freshness, 0.0::DOUBLE AS source_authority, language_match, round(term_ratio, 6) AS query_term_ratio, content_length FROM feat""")
def rerank_nine(spark: SparkSession, root: str) -> DataFrame:
    """The nine features of one request's candidates."""
    rows = featured(spark, root)
    return rows.select("doc_id", *[F.round(F.col(f"f_{name}"), 6).alias(name) for name in search.FEATURES])


def linear(f: dict) -> object:
    """A plain scorer, in the place of a trained one."""
    return F.round(0.05 * f["bm25_score"] + 0.5 * f["vector_score"] + f["title_match"] + 0.3 * f["freshness"] + 0.2 * f["language_match"] + f["query_term_ratio"], 4)


@query(f"""WITH {QUERY_SQL}, {FEATURES_SQL}, s AS (SELECT doc_id, before, round(0.05 * b + 0.5 * v + title_match + 0.3 * freshness + 0.2 * language_match + term_ratio, 4) AS rerank_score FROM feat)
    SELECT doc_id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, before, doc_id) AS place FROM s QUALIFY place <= 20""")
def rerank_search(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty candidates by a scorer of their features; equal scores keep the order of the fusion."""
    return search.reranked(featured(spark, root), "doc_id", linear, "before", 20)


@query("""SELECT event_id, CASE WHEN trim(q) = '' THEN 'empty' WHEN length(trim(q)) > 512 THEN 'long' WHEN page < 1 OR lim < 1 OR lim > 100 THEN 'page' WHEN page * lim > 500 THEN 'window' END AS fault
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN repeat(' ', 3) WHEN event_type = 'signup' THEN repeat(props, 60) ELSE props END AS q, user_id % 13 AS page, event_id % 110 AS lim FROM events)""")
def request_validate(spark: SparkSession, root: str) -> DataFrame:
    """Requests made of events, and why they are refused."""
    text = F.when(F.col("event_type") == "error", F.repeat(F.lit(" "), F.lit(3))).when(F.col("event_type") == "signup", F.repeat("props", F.lit(60))).otherwise(F.col("props"))
    return table(spark, root, "events").select("event_id", search.request_fault(text, F.col("user_id") % 13, F.col("event_id") % 110).alias("fault"))


@query("""WITH j AS (SELECT source AS query, doc_id, round(avg(grade_level), 2) AS grade FROM reading_labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT query, count(*) AS size FROM j GROUP BY query) SELECT query, size, row_number() OVER (ORDER BY query) AS place, sum(size) OVER (ORDER BY query)::BIGINT AS until FROM g""")
def query_groups(spark: SparkSession, root: str) -> DataFrame:
    """How many labelled documents each query has, in the order of the queries, for learning to rank."""
    labels = table(spark, root, "reading_labels").join(table(spark, root, "documents").select("doc_id", F.col("source").alias("query")), "doc_id").filter("query IS NOT NULL")
    sizes = labels.groupBy("query").agg(F.count_distinct("doc_id").alias("size"))
    placed = keyed.numbered(sizes, [F.asc("query")], "place")
    return placed.select("query", "size", "place", F.sum("size").over(Window.orderBy("place")).alias("until"))  # one row a query


@query()
def ltr_train(spark: SparkSession, root: str) -> DataFrame:
    """Boosted trees on labelled documents of three quarters of the queries; how good the order of the others is, per query."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    docs = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.col("source").alias("query"), F.char_length("text").cast("double").alias("chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"), F.regexp_count("text", F.lit("[.।!?]")).cast("double").alias("sentences"))
    grades = table(spark, root, "reading_labels").groupBy("doc_id").agg(F.avg("grade_level").alias("grade"))
    rows = VectorAssembler(inputCols=["chars", "words", "sentences"], outputCol="features").transform(docs.join(grades, "doc_id").filter("query IS NOT NULL"))
    held = F.pmod(F.xxhash64("query"), F.lit(4)) == 0  # whole groups are held out
    model = GBTRegressor(labelCol="grade", maxIter=10, maxDepth=3, seed=1).fit(rows.filter(~held))
    scored = model.transform(rows.filter(held))
    own = Window.partitionBy("query")
    placed = scored.withColumn("r", F.row_number().over(own.orderBy(F.desc("prediction"), "doc_id"))).withColumn("i", F.row_number().over(own.orderBy(F.desc("grade"), "doc_id")))
    gain = lambda place: F.sum(F.when(F.col(place) <= 5, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))
    return placed.groupBy("query").agg((gain("r") / gain("i")).alias("ndcg"), F.count("*").alias("size"))
