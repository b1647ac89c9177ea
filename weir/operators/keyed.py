"""Operators over keyed versions of rows: newest row, version counters, merges, duplicates and queues.

Ties are always broken by a unique id, null keys form no group, and every operator keeps columns it doesn't know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.session import cut


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order; rows with a null key are dropped. The order must be total."""
    named = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return named.withColumn("__place", place).filter("__place = 1").drop("__place")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows with their place in a total order, without bringing them into one task.

    Rows are split by ranges of the order and numbered within their part; the sizes of the parts before it, one row a part, are added.
    """
    split = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = split.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")  # as many rows as parts
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return split.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def versions(df: DataFrame, key: str, content: str, order: list[Column]) -> DataFrame:
    """Each row with its version (one more whenever the content differs from the row before) and whether it changed it; a first row has."""
    window = Window.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(window)
    changed = F.when(F.row_number().over(window) == 1, True).otherwise(~before.eqNullSafe(F.col(content)))
    steps = F.sum((F.col("content_changed") & (F.col("__row") > 1)).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("content_changed", changed).withColumn("__row", F.row_number().over(window)).withColumn("version", steps + 1).drop("__row")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column], guard: str | None = None) -> DataFrame:
    """Target rows overwritten by the newest source row of their key, and the source's new keys, with `inserted` and `updated`.

    `guard` is SQL over `t` and `s`: where it isn't true the target row stays as it is.
    """
    newest = latest(source, keys, order)
    t = target.select(F.struct("*").alias("t"), *[F.col(k).alias(f"__{k}") for k in keys])
    s = newest.select(F.struct(*target.columns).alias("s"), *[F.col(k).alias(f"__{k}") for k in keys])
    joined = t.join(s, [f"__{k}" for k in keys], "full_outer")
    takes = F.col("s").isNotNull() & (F.expr(guard) | F.col("t").isNull() if guard else F.lit(True))
    row = F.when(takes, F.col("s")).otherwise(F.col("t"))
    return joined.select(row.alias("r"), F.col("t").isNull().alias("inserted"), (takes & F.col("t").isNotNull()).alias("updated")).select("r.*", "inserted", "updated")


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in `incoming` replaced by the incoming ones; the others stay. Running it again changes nothing."""
    kept = children.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(incoming.dropDuplicates())


def exact_duplicates(df: DataFrame, key: str, id: str) -> DataFrame:
    """Each row with the lowest id of its key as `duplicate_of`, null for that row itself and for null keys.

    The lowest ids are aggregated before the join, so a key with very many rows meets in no task.
    """
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id).alias("__first"))
    return df.join(first, key, "left").withColumn("duplicate_of", F.when(F.col("__first") < F.col(id), F.col("__first"))).drop("__first")


def claim(queue: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The queue with its n oldest unprocessed rows claimed."""
    taken = queue.filter("status = 'UNPROCESSED'").orderBy(*order).limit(n).select("id", F.lit(True).alias("__taken"))
    return queue.join(F.broadcast(taken), "id", "left").withColumn("status", F.when(F.col("__taken"), "PROCESSING").otherwise(F.col("status"))).drop("__taken")


def mode(df: DataFrame, group: str, value: str, unit: str) -> DataFrame:
    """The most common value of each group by distinct units; equal counts go to the smaller value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_distinct(unit).alias("uses"))
    return latest(counted, [group], [F.desc("uses"), F.asc(value)])


def finished(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue (id, status) with its claimed rows marked by their results (id, error): failed with the error, or processed without one.

    Claimed rows without a result and rows that weren't claimed stay as they are; their `error` is null.
    """
    told = results.groupBy("id").agg(F.max("error").alias("__error")).withColumn("__told", F.lit(True))
    joined = queue.join(told, "id", "left")
    claimed = (F.col("status") == "PROCESSING") & F.col("__told")
    status = F.when(claimed & F.col("__error").isNotNull(), "FAILED").when(claimed, "PROCESSED").otherwise(F.col("status"))
    return joined.withColumn("error", F.when(claimed, F.col("__error"))).withColumn("status", status).drop("__error", "__told")


def quarantined(bad: DataFrame, signature: str, pages: DataFrame, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of bad rows: the records (signature, id, times) by signature with the last row of each; the rows to be parked; the pages that stay.

    A null signature has no record, its rows are parked all the same.
    """
    records = bad.filter(F.col(signature).isNotNull()).groupBy(signature).agg(F.max(id).alias(id), F.count("*").alias("times"))
    return records, bad.select(id), pages.join(bad.select(id), id, "left_anti")


def count_maps(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """For each group the number of rows of each value as a map: counted by value first, so a group with very many rows meets in no task."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(value).alias("key"), F.col("__n").alias("value")))).alias(value))


def followed(rows: DataFrame, later: DataFrame, id: str, key: str, at: str, then: str, seconds: int) -> DataFrame:
    """Rows with `n`, how many of `later` (key, then) have their key and come within so many seconds from their time on.

    Both are cut into slots of that length, so a row meets its own slot and the next, not all of its key's.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    early = rows.select(id, key, at, F.explode(F.array(slot(at), slot(at) + 1)).alias("__slot"))
    met = early.join(later.select(key, then, slot(then).alias("__slot")), [key, "__slot"]).filter((F.col(then) >= F.col(at)) & (F.col(then) < F.col(at) + F.make_dt_interval(secs=F.lit(seconds))))
    return rows.join(met.groupBy(id).agg(F.count("*").alias("n")), id, "left").withColumn("n", F.coalesce("n", F.lit(0)))
