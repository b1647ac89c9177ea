"""Queries on sources: tables written as objects into the shared folder and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import ann
from weir.plans.registry import query
from weir.session import ensure_checkpoint_dir
from weir.sources import documents
from weir.sources.tables import table

COLUMNS = [f.name for f in documents.DOCUMENT.fields]


def shared(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"objects-{uuid.uuid4().hex}")


@query("SELECT id, normalized_url, content_hash, len(links)::INTEGER AS links FROM crawled_documents WHERE url IS NOT NULL AND normalized_url IS NOT NULL AND content_hash IS NOT NULL")
def src_scan(spark: SparkSession, root: str) -> DataFrame:
    """All objects of a folder."""
    folder = shared(spark)
    documents.write_lines(table(spark, root, "crawled_documents").select(*COLUMNS), folder)
    good, _ = documents.split_bad(documents.scan(spark, folder))
    return documents.cleaned(good).select("id", "normalized_url", "content_hash", F.size("links").alias("links"))


@query("SELECT id, content_hash FROM crawled_documents WHERE url IS NOT NULL AND normalized_url IS NOT NULL AND content_hash IS NOT NULL")
def src_incremental(spark: SparkSession, root: str) -> DataFrame:
    """Two loads of a growing folder, the second from the moment of the first one's newest file on."""
    folder = shared(spark)
    pages = table(spark, root, "crawled_documents").select(*COLUMNS)
    documents.write_lines(pages.filter("id % 2 = 0"), folder)
    first = documents.incremental(spark, folder, None).withColumn("changed", F.col("_metadata.file_modification_time"))
    since = first.agg(F.max("changed").cast("string").alias("m")).first()["m"]
    documents.write_lines(pages.filter("id % 2 = 1"), folder)
    second = documents.incremental(spark, folder, since)
    both = documents.split_bad(documents.scan(spark, folder).filter("id % 2 = 0").unionByName(second))[0]
    return both.select("id", "content_hash").distinct()


@query("SELECT count(*) FILTER (WHERE id % 10 > 0) AS good, count(*) FILTER (WHERE id % 10 = 0) AS bad FROM crawled_documents WHERE url IS NOT NULL AND normalized_url IS NOT NULL AND content_hash IS NOT NULL")
def src_ndjson_badrows(spark: SparkSession, root: str) -> DataFrame:
    """Lines of which every tenth is broken: bad ones are counted, none stops the load."""
    folder = shared(spark)
    pages = table(spark, root, "crawled_documents").filter("url IS NOT NULL AND normalized_url IS NOT NULL AND content_hash IS NOT NULL").select(*COLUMNS)
    line = F.to_json(F.struct(*COLUMNS))
    spoiled = F.when(F.col("id") % 10 == 0, F.left(line, F.char_length(line) - 5)).otherwise(line)
    pages.select(spoiled.alias("value")).write.text(folder, compression="none")
    lines = documents.scan(spark, folder, suffix="*.txt")
    good, bad = documents.split_bad(lines)
    return good.agg(F.count("*").alias("good")).withColumn("bad", bad.agg(F.count("*")).scalar())


@query()
def vector_ann(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest of every hundredth vector by random hyperplanes, with exact cosines."""
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ann.nearest_by_planes(vectors, vectors.filter("id % 100 = 0"), 10)
