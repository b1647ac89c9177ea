"""Approximate nearest vectors: signs against random hyperplanes as buckets, several tables, exact cosine within.

Buckets keep their size as the vectors grow in number; a query also looks into the buckets beyond each one plane.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.operators.rank import cosine

#: Tables of buckets; planes a table has at least; vectors a bucket is to hold, about: the planes grow with their number.
TABLES, PLANES, BUCKET, SEED = 10, 3, 64, 9


def bucket(vector: Column, planes: np.ndarray) -> Column:
    """Which side of each hyperplane a vector is on, as a number."""
    total = F.lit(0)
    for k, plane in enumerate(planes):
        dot = F.aggregate(F.zip_with(vector, F.lit([float(x) for x in plane]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        total = total + F.when(dot > 0, 1 << k).otherwise(0)
    return total


def nearest_by_planes(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity, place) of queries (id, embedding) among vectors (id, embedding) of one length; its own row is no neighbour."""
    first = vectors.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    width = first["n"] if first else 1
    number = max(PLANES, int(np.ceil(np.log2(max(vectors.count(), 1) / BUCKET))))
    planes = np.random.default_rng(SEED).standard_normal((TABLES, number, width))
    buckets = lambda df: df.filter(F.size("embedding") == width).select("id", "embedding", F.posexplode(F.array(*[bucket(F.col("embedding"), p) for p in planes])).alias("table", "bucket"))
    asked = buckets(queries).select("id", "embedding", "table", F.explode(F.array("bucket", *[F.col("bucket").bitwiseXOR(F.lit(1 << k)) for k in range(number)])).alias("bucket"))
    found = asked.join(buckets(vectors).select(F.col("id").alias("neighbour"), F.col("embedding").alias("other"), "table", "bucket"), ["table", "bucket"]).filter("id <> neighbour")
    once = found.dropDuplicates(["id", "neighbour"]).select("id", "neighbour", cosine(F.col("embedding"), F.col("other")).alias("similarity"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).filter(F.col("place") <= k)
