"""Named parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """`root/name.parquet`, a file or a directory of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")
