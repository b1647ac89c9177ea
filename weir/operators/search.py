"""The search stack: a stored index of several fields, fuzzy terms, candidates of several sources, features and a stable order.

Null and empty fields have no postings; terms that stand nowhere match nothing; equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.text import tokens
from weir.operators.rank import K1, B, cosine
from weir.session import cut, spread

#: Other spellings a term is taken for at most, and letters at its beginning they share with it.
EXPANSIONS, PREFIX = 20, 1
#: Features of the reranker, in their fixed order.
FEATURES = ("bm25_score", "vector_score", "title_match", "geo_match", "freshness", "source_authority", "language_match", "query_term_ratio", "content_length")
# Limits of a request.
MOST_CHARS, MOST_RESULTS, MOST_WINDOW = 512, 100, 500


class Index:
    """Postings (field, term, id, tf, length), terms (field, term, df) and sizes (field, n, mean) of some text fields, each a written table."""

    def __init__(self, docs: DataFrame, id: str, fields: list[str]):
        self.id = id
        rows = spread(docs.select(id, *fields)).select(id, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), tokens(F.col(f)))])).alias("field", "t")).filter("size(t) > 0")
        each = rows.select(id, "field", F.size("t").alias("length"), F.explode("t").alias("term"))
        self.postings = cut(each.groupBy("field", "term", id).agg(F.count("*").alias("tf"), F.first("length").alias("length")).repartition("field", "term"))
        self.terms = cut(self.postings.groupBy("field", "term").agg(F.count("*").alias("df")))
        self.sizes = self.postings.groupBy("field", id).agg(F.first("length").alias("length")).groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))

    def expanded(self, asked: DataFrame) -> DataFrame:
        """(variant, word, term, weight) of asked words (variant, word): the word itself and the nearest others within its edits."""
        vocabulary = self.terms.groupBy("term").agg(F.sum("df").alias("uses")).withColumn("head", F.left("term", F.lit(PREFIX)))
        edits = F.when(F.char_length("word") < 3, 0).when(F.char_length("word") < 6, 1).otherwise(2)
        words = asked.select("word").distinct().withColumn("edits", edits).withColumn("head", F.left("word", F.lit(PREFIX)))
        near = vocabulary.join(F.broadcast(words), "head").withColumn("d", F.levenshtein("word", "term")).filter(F.col("d") <= F.col("edits"))  # a request holds few words
        place = F.row_number().over(Window.partitionBy("word").orderBy("d", F.desc("uses"), "term"))
        kept = near.withColumn("place", place).filter(F.col("place") <= EXPANSIONS)
        weight = 1 - F.col("d") / F.least(F.char_length("word"), F.char_length("term"))
        return asked.join(kept.select("word", "term", weight.alias("weight")), "word").select("variant", "word", "term", "weight")

    def search(self, spark, variants: list[str], boosts: dict[str, float]) -> DataFrame:
        """(id, score): of each variant the best field, a field's words added up, and the variants added up."""
        asked = spark.createDataFrame([(k, w) for k, v in enumerate(variants) for w in dict.fromkeys(v.split())], "variant int, word string")
        wanted = F.broadcast(self.expanded(asked))  # at most EXPANSIONS terms a word
        boost = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
        hits = self.postings.join(wanted, "term").join(self.terms, ["field", "term"]).join(F.broadcast(self.sizes), "field")  # a row a field
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = boost[F.col("field")] * F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        by_word = hits.groupBy(self.id, "variant", "field", "word").agg(F.max(part).alias("s"))
        by_field = by_word.groupBy(self.id, "variant", "field").agg(F.sum("s").alias("s"))
        return by_field.groupBy(self.id, "variant").agg(F.max("s").alias("s")).groupBy(self.id).agg(F.sum("s").alias("score"))


def best_chunks(chunks: DataFrame, pages: DataFrame, models: DataFrame, target: list[float], model: str, k: int) -> DataFrame:
    """(page_id, distance): the k pages with the nearest chunk of a model, among chunks of what the pages hold now; vectors that can't be compared are left out."""
    size = models.filter(F.col("name") == model).select(F.col("name").alias("model_name"), F.col("dimensions").alias("size"))
    fine = chunks.join(F.broadcast(size), "model_name").filter("size(embedding) = size AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x))")
    current = fine.join(pages.select(F.col("id").alias("page_id"), "content_hash"), ["page_id", "content_hash"], "left_semi")
    near = current.select("page_id", (1 - cosine(F.col("embedding"), F.lit(target))).alias("distance")).filter("distance IS NOT NULL")
    return near.groupBy("page_id").agg(F.min("distance").alias("distance")).orderBy("distance", "page_id").limit(k)


def merged(lists: dict[str, DataFrame], id: str, scores: list[str], others: list[str]) -> DataFrame:
    """Candidates of several sources as one row each: the greatest of each score (0 without one), the first value that isn't empty, the sources.

    The sources come in the order of `lists`; columns a source lacks are null.
    """
    parts = []
    for place, (name, df) in enumerate(lists.items()):
        filled = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in [*scores, *others]]
        parts.append(df.select(id, *filled, F.lit(name).alias("__source"), F.lit(place).alias("__place")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__place"))).alias(c) for c in others]
    return every.groupBy(id).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in scores], *first, F.array_sort(F.collect_set("__source")).alias("sources"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def with_features(candidates: DataFrame, query: str, language: str | None, now: Column, geo: Column | None = None) -> DataFrame:
    """Candidates (title, text, language, published_at, bm25_score, vector_score, content_length) with the nine features.

    Without a language asked for its match is a half; without places asked for there is no match; unknown times are not fresh.
    """
    terms = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())]) if query.split() else F.array().cast("array<string>")
    title = words(F.coalesce("title", F.lit("")))
    every = words(F.concat_ws(" ", "title", "text"))
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 86_400e6)
    made = {
        "bm25_score": F.col("bm25_score"),
        "vector_score": F.col("vector_score"),
        "title_match": F.arrays_overlap(terms, title).cast("double"),
        "geo_match": F.coalesce(geo, F.lit(False)).cast("double") if geo is not None else F.lit(0.0),
        "freshness": F.when(F.col("published_at").isNotNull(), 1 / (1 + F.greatest(days, F.lit(0)) / 365)),
        "source_authority": F.lit(0.0),
        "language_match": F.lit(0.5) if not language else F.when(F.col("language") == language, 1.0).otherwise(0.0),
        "query_term_ratio": F.size(F.array_intersect(terms, every)) / F.size(terms) if query.split() else F.lit(0.0),
        "content_length": F.col("content_length").cast("double"),
    }
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)
    return candidates.select("*", *[finite(c.cast("double")).alias(f"f_{name}") for name, c in made.items()])


def reranked(featured: DataFrame, id: str, score: Callable[[dict[str, Column]], Column], before: str, top: int | None = None) -> DataFrame:
    """(id, rerank_score, place) by a scorer of the features; equal scores keep the order of `before` (a rank), so the sort is stable."""
    value = score({name: F.col(f"f_{name}") for name in FEATURES})
    scored = featured.select(id, before, F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(0.0).alias("rerank_score"))
    placed = scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rerank_score"), before, id)))  # a candidate pool, never more than MOST_WINDOW rows
    return placed.select(id, "rerank_score", "place") if top is None else placed.filter(F.col("place") <= top).select(id, "rerank_score", "place")


def request_fault(query: Column, page: Column, limit: Column) -> Column:
    """Why a request is refused; null if it isn't."""
    asked = F.coalesce(F.trim(query), F.lit(""))
    return (
        F.when(asked == "", "empty")
        .when(F.char_length(asked) > MOST_CHARS, "long")
        .when(page.isNull() | limit.isNull() | (page < 1) | ~limit.between(1, MOST_RESULTS), "page")
        .when(page * limit > MOST_WINDOW, "window")
    )
