"""Spark session factory and the storage settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan here is written for; a caller's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "weir", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` keys use `_` for `.` or are given as they are."""
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; only a local session may do without and gets one of its own machine."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "weir-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """This application's own folder of written tables in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "weir-" + spark.sparkContext.applicationId)


def sweep(spark: SparkSession) -> bool:
    """Remove this application's written tables; to be called when no result that reads them is needed any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    return bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and go on from there: no lineage, compressed, safe from lost executors."""
    path = os.path.join(scratch(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the scan has fewer splits than there are cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
