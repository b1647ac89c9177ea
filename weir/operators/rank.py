"""Retrieval and ranking: inverted index and BM25, vector search, rank fusion, PageRank and scores.

Scores of equal size are ordered by id. Null and empty texts have no postings, rows with null or empty vectors are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.text import tokens
from weir.session import cut, spread

K1, B, FUSION, DAMPING = 1.2, 0.75, 60, 0.85


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(term, id, tf)."""
    return spread(docs.select(id, text)).select(id, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", id).agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id: str, text: str, terms: list[str]) -> DataFrame:
    """(id, score) of the documents that hold a term. One pass over the texts, without postings of other terms."""
    found = spread(docs.filter(F.col(text).isNotNull()).select(id, text)).select(id, tokens(F.col(text)).alias("t")).select(id, F.size("t").alias("length"), *[F.expr(f"size(filter(t, x -> x = {quoted(w)}))").alias(f"tf{k}") for k, w in enumerate(terms)])
    counted = cut(found).filter("length > 0")  # the texts are cut into tokens once; statistics and hits read the counts
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    row = F.broadcast(stats)  # one row
    hits = counted.filter(" OR ".join(f"tf{k} > 0" for k in range(len(terms)))).join(row)
    parts = []
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    return hits.select(id, sum(parts[1:], parts[0]).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of equal length, in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, id: str, vector: str, target: list[float], k: int) -> DataFrame:
    """(id, similarity): the k rows most similar to a vector; rows of another length are left out."""
    wanted = F.lit(target)
    return vectors.filter(F.size(vector) == len(target)).select(id, cosine(F.col(vector), wanted).alias("similarity")).filter("similarity IS NOT NULL AND NOT isnan(similarity)").orderBy(F.desc("similarity"), id).limit(k)


def fused(lists: list[DataFrame], id: str) -> DataFrame:
    """(id, score) of ranked lists (id, rank): one count a list, at the first place an id has in it."""
    once = [x.groupBy(id).agg(F.min("rank").alias("rank")) for x in lists]
    every = once[0]
    for x in once[1:]:
        every = every.unionByName(x)
    return every.groupBy(id).agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))


def ranked(scored: DataFrame, id: str, score: str) -> DataFrame:
    """A short list with places; it is one task's work, so limit it first."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id))))


def log_scale(value: Column, top: Column) -> Column:
    return F.when((value > 0) & (top > 0), F.least(F.lit(1.0), F.log1p(value) / F.log1p(top))).otherwise(0.0)


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between pages (page, url, links): a link names a page with or without a slash at its end."""
    links = pages.select(F.col("page").alias("src"), F.explode("links").alias("link")).filter("link IS NOT NULL")
    bare = F.regexp_replace("link", "/+$", "")
    variants = links.select("src", F.explode(F.array_distinct(F.array("link", bare, F.concat(bare, F.lit("/"))))).alias("url"))
    targets = pages.select(F.col("page").alias("dst"), "url")
    return variants.join(targets, "url").filter("src <> dst").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, links: DataFrame, iterations: int = 10, tolerance: float | None = None) -> DataFrame:
    """(node, rank). Pages without links spread their rank evenly. Rounds end after `iterations`, or sooner below the tolerance.

    The edges carry their source's out-degree and are written once; each round joins the ranks to them and aggregates.
    """
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    known = links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = known.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = cut(known.join(out, "src"))
    ranks = cut(nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("degree").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost")).first()["lost"]
        given = weighted.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        base = (1 - DAMPING) / n + DAMPING * lost / n
        new = cut(ranks.select("node", "dangling", F.col("rank").alias("old")).join(given, "node", "left").select("node", "dangling", "old", (F.lit(base) + DAMPING * F.coalesce("given", F.lit(0.0))).alias("rank")))
        done = tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"] < tolerance
        ranks = new.drop("old")
        if done:
            break
    return ranks.select("node", "rank")
