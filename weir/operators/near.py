"""Near-duplicates by fingerprints of 64 bits.

Equal fingerprints are one class before anything is compared, so copies are never expanded into pairs. A fingerprint is cut
into six blocks; three bits can spoil three of them, so fingerprints at most three bits apart agree in some three blocks
(pigeonhole). The join by the 20 choices of three blocks, 31 to 33 bits each, loses no pair and keeps its buckets small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions.text import tokens
from weir.session import cut, spread

BITS = 3
#: Where the blocks begin, and how wide they are.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHOICES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - BITS))


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows (id, tokens): each different token of a batch is hashed once, its bits vote once an occurrence."""
    for batch in batches:
        tokens_of = batch.column(1)
        out = np.zeros(batch.num_rows, np.int64)
        for begin in range(0, batch.num_rows, 500):
            part = tokens_of.slice(begin, 500)
            words = part.flatten().dictionary_encode()
            if not len(words):
                continue
            hashed = np.array([int.from_bytes(hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest()[-8:], "big") for w in words.dictionary.to_pylist()], np.uint64)
            signs = (np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1)[words.indices.to_numpy()]
            sizes = np.array([len(x) if x is not None else 0 for x in part.to_pylist()])
            some = np.flatnonzero(sizes)
            total = np.add.reduceat(signs, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            out[begin + some] = np.packbits(total > 0, axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "simhash"])


def simhash(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, simhash) of every row: each token votes for the bits of its hash by how often it stands; without tokens 0. No shuffle."""
    rows = spread(df.select(id, text)).select(F.col(id).cast("long").alias("id"), tokens(F.col(text)).alias("tokens"))
    return rows.mapInArrow(votes, "id long, simhash long").withColumnRenamed("id", id)


def near_pairs(hashed: DataFrame, id: str, simhash: str) -> DataFrame:
    """(a, b, distance, copies_a, copies_b): pairs of different fingerprints by the lowest id of each, a < b."""
    heads = cut(hashed.groupBy(simhash).agg(F.min(id).alias("head"), F.count("*").alias("copies")).withColumnRenamed(simhash, "h"))
    block = lambda c, k: F.shiftrightunsigned(c, BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    keys = [F.xxhash64(F.lit(n), *[block(F.col("h"), k) for k in choice]) for n, choice in enumerate(CHOICES)]
    banded = heads.select("h", "head", "copies", F.posexplode(F.array(*keys)).alias("band", "value"))
    other = banded.select("band", "value", *[F.col(c).alias(f"{c}_b") for c in ("h", "head", "copies")])
    apart = F.col("h").bitwiseXOR(F.col("h_b"))
    # a table of few bytes is twenty times as large once spread over the choices, which the planner doesn't see: it must not be broadcast
    joined = banded.hint("merge").join(other.hint("merge"), ["band", "value"]).filter((F.col("head") < F.col("head_b")) & (F.bit_count(apart) <= BITS))
    # a pair that agrees in several choices of blocks is kept in the first of them
    first = F.coalesce(*[F.when(sum((block(apart, k) for k in choice[1:]), block(apart, choice[0])) == 0, n) for n, choice in enumerate(CHOICES)])
    return joined.filter(first == F.col("band")).select(F.col("head").alias("a"), F.col("head_b").alias("b"), F.bit_count(apart).cast("int").alias("distance"), F.col("copies").alias("copies_a"), F.col("copies_b").alias("copies_b"))


def checksum(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes: equal for the same distinct edges, in whatever order."""
    return tuple(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): the lowest node of each connected component, by large-star and small-star steps until nothing changes."""
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        if checksum(small) == checksum(links):
            return small.select(F.col("u").alias("node"), F.col("v").alias("class"))
        links = small


def folded(hashed: DataFrame, id: str, simhash: str, content: str) -> DataFrame:
    """(id, duplicate_of) of rows (id, simhash, content): the first row of the same content if it stands itself, else the nearest older row within three bits that does.

    Rows are taken in the order of their ids, so what a row may fold into depends on what became of the older ones. Only the
    first rows of a fingerprint can stand; round by round those whose older likenesses are all decided are decided too. A
    fingerprint of 0 is no likeness, its rows fold by content alone; null contents are nobody's copy.
    """
    likely = hashed.filter(F.col(simhash) != 0)
    heads = likely.groupBy(F.col(simhash).alias("h")).agg(F.min(id).alias("head"))
    pairs = cut(near_pairs(likely, id, simhash).select(F.col("a").alias("older"), F.col("b").alias("node")))
    decided = cut(heads.select(F.col("head").alias("node")).join(pairs.select("node").distinct(), "node", "left_anti").withColumn("stands", F.lit(True)))
    open_pairs = pairs
    while not open_pairs.isEmpty():
        known = open_pairs.join(decided.select(F.col("node").alias("older"), "stands"), "older", "left")
        state = known.groupBy("node").agg(F.bool_or("stands").alias("near"), F.count_if(F.col("stands").isNull()).alias("waiting"))
        # a row near an older one that stands is folded, whatever the others are; one without waits for all of them
        fresh = cut(state.filter("near OR waiting = 0").select("node", (~F.coalesce("near", F.lit(False))).alias("stands")))
        decided = decided.unionByName(fresh)
        open_pairs = cut(open_pairs.join(fresh.select("node"), "node", "left_anti"))
    standing = cut(decided.filter("stands").select("node"))
    both = pairs.unionByName(pairs.select(F.col("node").alias("older"), F.col("older").alias("node")))  # a later copy may be nearer to one that is newer than its first
    marks = heads.select(F.col("head").alias("node"), "h")
    reach = both.join(standing.select(F.col("node").alias("older")), "older").join(marks, "node").join(marks.select(F.col("node").alias("older"), F.col("h").alias("g")), "older")
    targets = reach.groupBy("h").agg(F.collect_list(F.struct(F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("d"), F.col("older").alias("to"))).alias("targets"))  # fingerprints that stand lie apart, so few fit within three bits
    own = heads.join(standing.select(F.col("node").alias("head"), F.lit(True).alias("stands")), "head", "left").join(targets, "h", "left")
    first = hashed.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(id).alias("first"))
    rows = hashed.select(id, simhash, content).join(first, content, "left").join(own.withColumnRenamed("h", simhash), simhash, "left")
    older = F.array_sort(F.filter(F.coalesce("targets", F.array().cast("array<struct<d:int,to:bigint>>")), lambda t: t["to"] < F.col(id)))
    beside = F.when(F.col("stands") & (F.col("head") < F.col(id)), F.col("head")).otherwise(F.get(older, F.lit(0))["to"])
    exact = F.when((F.col("first") < F.col(id)) & (F.col("head").isNull() | (F.col("stands") & (F.col("head") == F.col("first")))), F.col("first"))
    return rows.select(id, F.coalesce(exact, beside).alias("duplicate_of"))


def classes(hashed: DataFrame, id: str, simhash: str) -> DataFrame:
    """(id, class, links): one row per row, with the lowest id of its class and the number of the class's links; a fingerprint of 0 is no likeness."""
    likely = hashed.filter(F.col(simhash) != 0)
    pairs = cut(near_pairs(likely, id, simhash))
    heads = likely.groupBy(simhash).agg(F.min(id).alias("head"))
    found = components(pairs)
    named = heads.join(found, heads["head"] == found["node"], "left").select(simhash, "head", F.coalesce("class", "head").alias("class"))
    links = pairs.join(found, pairs["a"] == found["node"]).groupBy("class").agg(F.count("*").alias("links"))
    every = hashed.join(named, simhash, "left").select(id, F.coalesce("class", id).alias("class"))
    return every.join(links, "class", "left").select(id, "class", F.coalesce("links", F.lit(0)).alias("links"))
