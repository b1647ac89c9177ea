"""Problem 3: for every vector the k most similar vectors of its model.

Equal vectors are one class. The classes are indexed in balanced posting lists: centroids come from hierarchical balanced
clustering of a bounded sample, vectors near a boundary are in several lists, and each vector searches the lists whose
centroids are not much farther than its nearest one. Centroids are found by a beam search over their neighbour graph. All
vectors are queries. Lists that lie side by side in the clustering form a group: a vector is sent once to each group it
searches or stands in, not once a list, and meets all the group holds. Long groups are worked off in tiles, so that no task
holds a group of any length. `exact` sends every vector to every group, which is the whole comparison in blocks.

Results: vectors that are null, of another length than their model's, not finite or all zero are left out, as are those of
a model that isn't listed. Similarity is the cosine in double precision. Equal similarities are ordered by id; of equal
vectors those with the smallest ids come first. A vector without any other of its model has no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.common import sampled
from weir.session import cut, spread

#: Neighbours of a vector; vectors in a posting list, about; vectors of a model the centroids are fitted on at most, and centroids at most.
NEIGHBOURS, LIST, SAMPLE, CENTROIDS = 10, 160, 60_000, 8192
#: Edges of a centroid in the graph; candidates kept by the search and its rounds.
EDGES, BEAM, ROUNDS = 14, 20, 5
#: A vector is in the lists, and searches the lists, whose centroid is at most so many times as far as the nearest; and how many.
POST_RATIO, POSTS, SEARCH_RATIO, SEARCHES = 1.15, 3, 1.60, 12
#: Lists in a group; rows of a group that one task compares with others; copies of a class that one task names.
GROUP, TILE, COPIES = 12, 6000, 2000


def usable(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """(id, model, embedding) of the vectors that can be compared."""
    sizes = models.select(F.col("name").alias("model"), F.col("dimensions").alias("size")).dropDuplicates(["model"])
    found = vectors.select("id", F.col("model_name").alias("model"), "embedding").filter("embedding IS NOT NULL").join(sizes, "model")
    fine = "size(embedding) = size AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return found.filter(fine).select("id", "model", "embedding")


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of clusters of at most about `most` vectors: k-means over and over, full clusters pushing vectors on."""
    if len(x) <= most:
        return [x.mean(0)]
    k = int(min(8, np.ceil(len(x) / most)))
    centers = x[rng.choice(len(x), k, replace=False)]
    load = np.zeros(k)
    for _ in range(10):
        distance = 2 - 2 * x @ centers.T + load
        own = distance.argmin(1)
        counts = np.bincount(own, minlength=k)
        load += 0.05 * (counts / (len(x) / k) - 1)
        for j in range(k):
            if counts[j]:
                mean = x[own == j].mean(0)
                centers[j] = mean / max(np.linalg.norm(mean), 1e-12)
    parts = [x[own == j] for j in range(k) if counts[j]]
    if len(parts) == 1 or max(map(len, parts)) == len(x):
        parts = np.array_split(x[rng.permutation(len(x))], k)
    return [c for part in parts for c in balanced(part, most, rng)]


class Index:
    """Centroids of one model and the graph between them."""

    def __init__(self, x: np.ndarray, total: int):
        rng = np.random.default_rng(3)
        wanted = int(min(CENTROIDS, max(1, total / LIST)))
        found = np.array(balanced(x, max(1, int(np.ceil(len(x) / wanted))), rng))
        self.centers = (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        n = len(self.centers)
        edges = min(EDGES, n - 1)
        self.graph = np.zeros((n, 0), np.int32)
        if edges:
            near = np.empty((n, edges), np.int32)
            for k in range(0, n, 1024):
                sims = self.centers[k : k + 1024] @ self.centers.T
                sims[np.arange(len(sims)), np.arange(k, k + len(sims))] = -9
                near[k : k + 1024] = np.argpartition(-sims, edges - 1, axis=1)[:, :edges]
            self.graph = np.concatenate([near, rng.integers(0, n, (n, 2), dtype=np.int32)], 1)  # a few long edges
        self.entries = rng.choice(n, min(n, 2 * BEAM), replace=False).astype(np.int32)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the nearest centroids the beam search finds, and their squared distances, the nearest first."""
        x = x.astype(np.float32)
        beam = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        sims = x @ self.centers[self.entries].T
        keep = min(BEAM, len(self.entries))
        for _ in range(ROUNDS if self.graph.shape[1] else 0):
            best = np.argpartition(-sims, min(keep, sims.shape[1]) - 1, axis=1)[:, :keep]
            beam, sims = np.take_along_axis(beam, best, 1), np.take_along_axis(sims, best, 1)
            front = np.argsort(-sims, axis=1)[:, : max(1, keep // 4)]
            more = self.graph[np.take_along_axis(beam, front, 1)].reshape(len(x), -1)
            more_sims = (self.centers[more] @ x[:, :, None])[:, :, 0]
            beam, sims = np.concatenate([beam, more], 1), np.concatenate([sims, more_sims], 1)
            order = np.argsort(beam, axis=1, kind="stable")
            beam, sims = np.take_along_axis(beam, order, 1), np.take_along_axis(sims, order, 1)
            sims[:, 1:][beam[:, 1:] == beam[:, :-1]] = -9
        order = np.argsort(-sims, axis=1, kind="stable")[:, :SEARCHES]
        return np.take_along_axis(beam, order, 1), np.maximum(2 - 2 * np.take_along_axis(sims, order, 1), 0)

    def groups(self, x: np.ndarray, exact: bool) -> list[tuple[list[int], list[bool]]]:
        """Of each vector the groups it searches, and which of them it stands in."""
        found, distance = self.search(x)
        limit = distance[:, :1] + 1e-9
        searched = distance <= limit * SEARCH_RATIO
        posted = (distance <= limit * POST_RATIO) & (np.arange(found.shape[1]) < POSTS)
        number = -(-len(self.centers) // GROUP)
        asks, posts = np.zeros((len(x), number), bool), np.zeros((len(x), number), bool)
        at = np.broadcast_to(np.arange(len(x))[:, None], found.shape)
        asks[at[searched], found[searched] // GROUP] = True
        posts[at[posted], found[posted] // GROUP] = True
        if exact:
            asks[:] = True
        return [(np.flatnonzero(a).tolist(), p[a].tolist()) for a, p in zip(asks, posts, strict=True)]


def fitted(classes: DataFrame) -> dict[str, Index]:
    """An index for each model, from its vectors with the smallest hash of their id."""
    out = {}
    for row in classes.groupBy("model").count().collect():  # a row for each listed model
        sample = sampled(classes.filter(F.col("model") == row["model"]), "class", SAMPLE, row["count"]).select("class", "embedding").toArrow().sort_by("class")
        out[row["model"]] = Index(matrix(sample.column(1)), row["count"])
    return out


def compare(table: pa.Table) -> pa.Table:
    """Within a tile of a list: of each searching vector the nearest posted ones."""
    names = ["class", "other", "similarity"]
    posts, asks = (np.flatnonzero(table.column(n).to_numpy()) for n in ("post", "ask"))
    out: list[list[np.ndarray]] = [[], [], []]
    if len(posts) and len(asks):
        x, ids = matrix(table.column("embedding")), table.column("class").to_numpy()
        for k in range(0, len(asks), 1024):
            rows = asks[k : k + 1024]
            sims = x[rows] @ x[posts].T
            sims[ids[rows][:, None] == ids[posts][None, :]] = -9
            most = min(NEIGHBOURS, len(posts))
            best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(sims, best, 1)
            fine = value > -2
            out[0].append(np.repeat(ids[rows], fine.sum(1)))
            out[1].append(ids[posts][best][fine])
            out[2].append(value[fine])
    kinds = (np.int64, np.int64, np.float64)
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(out, kinds, strict=True)], names=names)


def class_neighbours(classes: DataFrame, exact: bool = False) -> DataFrame:
    """(class, other, similarity, place) of the classes (class, model, embedding)."""
    shared = classes.sparkSession.sparkContext.broadcast(fitted(classes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            models, found = np.array(batch.column(1).to_pylist(), object), [([], [])] * batch.num_rows
            for model in set(models):
                rows = np.flatnonzero(models == model)
                for begin in range(0, len(rows), 512):
                    part = rows[begin : begin + 512]
                    for row, lists in zip(part, shared.value[model].groups(matrix(batch.column(2).take(pa.array(part))), exact), strict=True):
                        found[row] = lists
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([p for _, p in found], pa.list_(pa.bool_()))], names=["class", "model", "embedding", "lists", "posts"])

    assigned = cut(spread(classes.select("class", "model", "embedding")).mapInArrow(assign, "class long, model string, embedding array<float>, lists array<int>, posts array<boolean>"))
    rows = assigned.select("class", "model", "embedding", F.explode(F.arrays_zip("lists", "posts")).alias("z")).select("class", "model", "embedding", F.col("z.lists").alias("list"), F.col("z.posts").alias("post"))
    tiles = rows.groupBy("model", "list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = "pmod(xxhash64(class), tiles)"
    keys = f"""CASE WHEN tiles = 1 THEN array(named_struct('a', 0L, 'b', 0L, 'post', post, 'ask', true))
        ELSE concat(IF(post, transform(sequence(0, tiles - 1), t -> named_struct('a', {tile}, 'b', cast(t AS long), 'post', true, 'ask', false)), array()),
                    transform(sequence(0, tiles - 1), t -> named_struct('a', cast(t AS long), 'b', {tile}, 'post', false, 'ask', true))) END"""
    tiled = rows.join(tiles, ["model", "list"]).select("class", "model", "list", "embedding", F.explode(F.expr(keys)).alias("k")).select("class", "model", "list", "embedding", "k.a", "k.b", "k.post", "k.ask")
    near = tiled.groupBy("model", "list", "a", "b").applyInArrow(compare, "class long, other long, similarity double")
    once = near.repartition("class").groupBy("class", "other").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("similarity"), "other"))
    return once.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS)


def neighbours(vectors: DataFrame, models: DataFrame, exact: bool = False) -> DataFrame:
    """(id, neighbour, similarity, place) of every usable vector; with `exact` by comparing each with all others of its model."""
    fine = usable(vectors, models).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(1), "embedding"))
    keys = ["model", "a", "b"]
    heads = fine.groupBy(*keys).agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    members = cut(fine.select("id", *keys).join(heads, keys).select("id", "class", F.ceil(F.col("copies") / COPIES).cast("int").alias("parts")))
    classes = cut(fine.join(heads.select(F.col("class").alias("id")), "id", "left_semi").select(F.col("id").alias("class"), "model", "embedding"))
    near = class_neighbours(classes, exact).select("class", "other", "similarity", "place")
    first = members.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("rank") <= NEIGHBOURS + 1)
    own = classes.select("class", F.col("class").alias("other"), F.lit(1.0).alias("similarity"), F.lit(0).alias("place"))
    named = near.unionByName(own).join(first.select(F.col("class").alias("other"), F.col("id").alias("neighbour")), "other")
    short = named.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("place", "neighbour"))).filter(F.col("rank") <= NEIGHBOURS + 1)
    # only a class of many copies is spread over several tasks
    sizes = members.filter("parts > 1").groupBy("class").agg(F.max("parts").alias("parts"))
    salted = short.join(sizes, "class", "left").select("class", "neighbour", "similarity", "rank", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    each = members.withColumn("salt", F.pmod("id", "parts").cast("int")).join(salted, ["class", "salt"]).filter("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return each.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).select("id", "neighbour", "similarity", "place")


def pairs(near: DataFrame, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the pairs that are at least so similar."""
    return near.filter(F.col("similarity") >= least).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
