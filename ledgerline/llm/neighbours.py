"""Nearest neighbours by collision counting over query-centred windows (operator 8).

Vectors are dealt into shards of bounded size. In a shard every projection on a random line gives a sorted array; a
query opens a window around its own projection on each line and counts, for every vector, on how many lines it lies
inside. Windows widen step by step (virtual rehashing: no second index), and a vector that collides on enough lines is
verified by its true distance. A query is done when its k-th verified distance is within the radius that the windows
stand for. A shard's arrays are built once, by the task that holds it, and the queries stream past them. Shards'
answers are merged by distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read_table, salt

NEIGHBOURS = 10
#: Random lines, and the part of them on which a vector must collide to be verified.
LINES = 48
THRESHOLD = 0.66
#: Window width at radius 1. A vector at the radius collides on a line with probability 0.83.
WIDTH = 2.72
#: By so much the radius grows in each step.
GROWTH = math.sqrt(2)
SEED = 17
#: Components in a shard, at most about; a smaller table is dealt over the tasks in shards of at least so many vectors.
SHARD_COMPONENTS = 8 << 20
LEAST_VECTORS = 4096
#: Counts that are held at once.
HELD_COUNTS = 2 << 20


class Lines:
    """The sorted projections of the vectors x of one shard."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.verified = 0  # vectors whose distance was calculated, over all queries
        self.lines = np.random.default_rng(SEED).standard_normal((x.shape[1], LINES))
        projected = x @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()
        # The first radius: a small part of the spread on the lines.
        spread = np.median(self.sorted[:, (3 * len(x)) // 4] - self.sorted[:, len(x) // 4])
        self.radius = max(float(spread) / 16, 1e-12)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of k nearest vectors found for each query, all if there are fewer."""
        held = max(1, HELD_COUNTS // len(self.x))
        parts = [self._block(queries[i : i + held], k, i) for i in range(0, len(queries), held)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _block(self, q: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, least = len(self.x), math.ceil(THRESHOLD * LINES)
        centre = q @ self.lines
        count = np.zeros((len(q), n), np.uint8)
        checked = np.zeros((len(q), n), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre.T)])
        high = low.copy()
        todo, radius = list(range(len(q))), self.radius
        while todo:
            half = radius * WIDTH / 2
            rows = np.array(todo)
            new_low = np.array([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centre[rows].T)])
            new_high = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centre[rows].T)])
            left = []
            for i, r in enumerate(todo):
                c = count[r]
                for line in range(LINES):
                    c[self.order[line, new_low[line, i] : low[line, r]]] += 1
                    c[self.order[line, high[line, r] : new_high[line, i]]] += 1
                low[:, r], high[:, r] = new_low[:, i], new_high[:, i]
                fresh = np.flatnonzero((c >= least) & ~checked[r])
                checked[r, fresh] = True
                self.verified += len(fresh)
                distance = np.sqrt(((self.x[fresh] - q[r]) ** 2).sum(axis=1))
                ids, d = np.concatenate([found[r][0], fresh]), np.concatenate([found[r][1], distance])
                best = np.lexsort((ids, d))[:k]
                found[r] = ids[best], d[best]
                everything = (high[:, r] - low[:, r] == n).all()
                if not everything and (len(best) < k or d[best[-1]] > radius):
                    left.append(r)
            todo, radius = left, radius * GROWTH
        return (
            np.concatenate([np.full(len(f[0]), base + r) for r, f in enumerate(found)]),
            np.concatenate([f[0] for f in found]),
            np.concatenate([f[1] for f in found]),
        )


def usable(embedding: str) -> Column:
    """Vectors that take part: not null, not empty, without null, NaN or infinite components, and not all zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def vectors_of(lists: pa.ListArray) -> np.ndarray:
    """The rows of a matrix of doubles; all lists have one length and no null."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    embedding_col: str = "embedding",
    k: int = NEIGHBOURS,
    shards: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), id, score: k nearest found for each row of vectors that the condition queries holds.

    Nearness is the Euclidean distance in double precision; ties go to the smaller id; a query is no neighbour of its
    own. Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id;
    a query meets the vectors of its own length. Equal vectors are one entry of the index, which lists the k + 1
    smallest ids (no query can use more), so that a vector that is very common costs one. An id that repeats with equal
    vectors counts once. An empty table gives an empty table. shards: their number, else by the table's size.
    """
    good = vectors.where(usable(embedding_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(embedding_col).cast("array<double>").alias("v"), queries.alias("asks")
    )
    copies = Window.partitionBy("v").orderBy("id")
    entries = materialise(
        good.select("id", "v").distinct()
        .withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")),
        "vectors",
    )
    n, components = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if shards is None:
        spread = min(partitions(vectors.sparkSession), -(-n // LEAST_VECTORS))
        shards = max(1, -(-components // SHARD_COMPONENTS), spread)
    shard, none = salt(shards, "v").alias("shard"), F.lit(None).cast("long").alias("query_id")
    indexed = entries.select(F.size("v").alias("length"), shard, F.lit(False).alias("asks"), none, "ids", "v")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = good.where("asks").select(F.col("id").alias("query_id"), "v").distinct().select(
        F.size("v").alias("length"), everywhere, F.lit(True).alias("asks"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, ids, held = None, None, [], []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "shard", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]) if len(keys) else ():
                part = batch.slice(start, end - start)
                if place != tuple(keys[start, :2]):
                    place, lines, ids, held = tuple(keys[start, :2]), None, [], []
                if not keys[start, 2]:
                    held.append(vectors_of(part["v"]))
                    ids += part["ids"].to_pylist()
                    continue
                if held:
                    lines, held = Lines(np.concatenate(held)), []
                if lines is not None:
                    who, which, score = lines.nearest(vectors_of(part["v"]), k + 1)
                    yield pa.RecordBatch.from_arrays(
                        [part["query_id"].take(pa.array(who)), pa.array([ids[i] for i in which], pa.list_(pa.int64())), pa.array(score)],
                        names=["query_id", "ids", "score"],
                    )

    by = ("length", "shard")
    met = indexed.unionByName(asking).repartition(max(shards, partitions(vectors.sparkSession)), *by).sortWithinPartitions(*by, "asks", "ids")
    found = met.mapInArrow(run, "query_id long, ids array<long>, score double").select(
        "query_id", F.explode("ids").alias("id"), "score"
    )
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        found.where("id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by 100; see nearest_neighbours for nulls, ties and repeats."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
