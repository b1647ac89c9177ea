"""Micro-batches: incremental loads, dead letters, idempotent merges, windows with watermarks, and pacing of hosts as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators import frontier, keyed
from weir.sources.documents import DOCUMENT

#: Files of a micro-batch at most; how late an event may be; seconds between fetches of a host, and after a refusal.
BATCH_FILES, LATE, PACE, BACK_OFF = 10, "10 minutes", 1.0, 30.0

EVENT = "id long, type string, version int, run long, host string, bucket string, key_prefix string, documents_prefix string"


def kafka_events(spark: SparkSession, servers: str, topic: str, batch: int = 10, wait: str = "60m") -> DataFrame:
    """Site events of a topic: a batch begins with so many of them, or when the oldest has waited so long."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("minOffsetsPerTrigger", batch).option("maxOffsetsPerTrigger", batch).option("maxTriggerDelay", wait).load()
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def stream_documents(spark: SparkSession, folder: str, files: int = BATCH_FILES) -> DataFrame:
    """Document objects as they arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)


def stream_events(spark: SparkSession, folder: str, schema: str = EVENT, files: int = BATCH_FILES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def merge_into(target: str, keys: list[str], order: Callable[[], list], guard: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that merges a batch into a table of snapshots; a batch that comes again writes the same snapshot."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{target}/batch={number}"
        try:
            before = spark.read.schema(batch.schema).parquet(f"{target}/batch={number - 1}")
        except Exception as error:  # the first batch has no snapshot before it
            if "PATH_NOT_FOUND" not in str(error):
                raise
            before = spark.createDataFrame([], batch.schema)
        keyed.upsert(before, batch, keys, order(), guard).drop("inserted", "updated").write.mode("overwrite").parquet(done)

    return merge


def validated(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that keeps valid events and sets the others aside; a batch of nothing but bad ones is an error, as then the pipeline is broken."""

    def split(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("fault", frontier.event_fault()).persist()
        try:
            counts = checked.agg(F.count("*").alias("n"), F.count("fault").alias("bad")).first()
            checked.filter("fault IS NULL").drop("fault").write.mode("overwrite").parquet(f"{target}/good/batch={number}")
            checked.filter("fault IS NOT NULL").write.mode("overwrite").parquet(f"{target}/dead/batch={number}")
            if counts["n"] and counts["n"] == counts["bad"]:
                raise ValueError(f"all {counts['n']} events of batch {number} are faulty")
        finally:
            checked.unpersist()

    return split


def run_available(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, in micro-batches; offsets are committed after each batch has succeeded."""
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and error rates of event-time windows; events later than the watermark are dropped. Also for tables, without effect of the watermark."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", LATE).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, id: str = "event_id") -> DataFrame:
    """Each event once, remembered as long as the watermark allows repeats."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([id])


def paced(requests: DataFrame) -> DataFrame:
    """(host, url, at) of requests (host, url, asked seconds, refused): when each may be fetched. The next free moment of a host is its state."""

    def pace(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0.0
        for rows in batches:
            out = []
            for url, asked, refused in rows.sort_values(["asked", "url"])[["url", "asked", "refused"]].itertuples(index=False):
                at = max(free, float(asked))
                out.append((key[0], url, at))
                free = at + (BACK_OFF if refused else PACE)
            yield pd.DataFrame(out, columns=["host", "url", "at"])
        state.update((free,))

    return requests.groupBy("host").applyInPandasWithState(pace, "host string, url string, at double", "free double", "append", "NoTimeout")
