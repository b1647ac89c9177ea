"""Document objects as JSON, one or many a file, from a folder of any file system Spark reads; and their sinks.

Schemas are given, never inferred. A line that isn't an object of this kind is kept aside with its file, not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("normalized_url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("crawl_run_id", T.LongType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("error", T.StringType()),
])
BAD = "_bad"


def scan(spark: SparkSession, folder: str, multiline: bool = False, suffix: str = "*.json") -> DataFrame:
    """All objects below a folder with the file they come from; `_bad` holds what couldn't be read."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", "true").option("multiLine", multiline).option("pathGlobFilter", suffix)
    return reader.json(folder).withColumn("file", F.col("_metadata.file_path"))


def split_bad(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones by file. An object without address or content is bad too."""
    missing = F.col("url").isNull() | F.col("normalized_url").isNull() | F.col("content_hash").isNull()
    bad = F.col(BAD).isNotNull() | missing
    return scanned.filter(~bad).drop(BAD), scanned.filter(bad).select("file", F.col(BAD).alias("line"))


def cleaned(rows: DataFrame) -> DataFrame:
    """Blank strings and a run of 0 as null."""
    for field in DOCUMENT.fields:
        if isinstance(field.dataType, T.StringType):
            rows = rows.withColumn(field.name, F.when(F.trim(field.name) != "", F.col(field.name)))
    return rows.withColumn("crawl_run_id", F.nullif("crawl_run_id", F.lit(0)))


def incremental(spark: SparkSession, folder: str, since: str | None) -> DataFrame:
    """Objects of files changed at or after a moment (files of that very moment are read again, which a merge makes harmless)."""
    rows = scan(spark, folder)
    return rows.filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp")) if since else rows


def write_lines(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """One object a line, appended."""
    rows.write.mode(mode).json(folder)


def write_history_and_latest(rows: DataFrame, history: str, latest: str, key: str, order: list) -> None:
    """All versions, by run, and the newest of each key."""
    from weir.operators.keyed import latest as newest

    rows.write.mode("append").partitionBy("crawl_run_id").parquet(history)
    newest(rows, [key], order).write.mode("overwrite").parquet(latest)
