"""Hard negatives through an inverted multi-index (operator 11).

Every vector is cut into halves, and each half has a codebook of its own; the pairs of codewords are the cells of the
index. For an anchor, a half's codeword bounds the inner product of all vectors under it: the product with the codeword
plus the anchor's length times the codeword's radius. Each anchor visits cells by the sum of the two bounds, highest first,
in rounds; a cell is multiplied at once with all anchors that come to it in a round. An anchor stops once nothing unseen can
enter: for positives, when the bound falls below the k-th score; for negatives, when it falls below each window's k-th score
or lower end. Results are therefore exact, whatever the codebooks.

Codebooks are fitted on a bounded sample; all vectors are indexed and written with their cells. Shards of bounded size
are read by one task each, past which the anchors stream, first for positives, then with the windows these define.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read_table, salt
from .neighbours import LEAST_VECTORS, SHARD_COMPONENTS, vectors_of

POSITIVES, NEGATIVES = 5, 3
#: Components become floor(SCALE * x).
SCALE = 256
LABELS = 10
#: Vectors that codebooks are fitted on: those with the smallest hashes. Steps of the fit.
SAMPLE, STEPS = 4096, 8
#: Codewords of a half.
CODES = 16
SEED = 29
#: Vectors that an anchor scores in its first round, as far as the next cells have them.
BLOCK = 256
#: Anchors that visit cells together, and rows of a cell that are multiplied with them at once.
TOGETHER, PIECE = 256, 2048
#: A bound is a sum of doubles; by so much it is raised, so that rounding cannot hide a vector.
SLACK = 1e-6
#: Sums of products up to here are exact in doubles; beyond, up to 2^63, integers are used.
EXACT = float(1 << 52)

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_half(x: np.ndarray, codes: int) -> np.ndarray:
    """Codewords of one half by k-means from rows drawn with a fixed seed."""
    different = np.unique(x, axis=0)
    book = different[np.random.default_rng(SEED).permutation(len(different))[:codes]].copy()
    for _ in range(STEPS):
        own = nearest_code(x, book)
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(book))
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def nearest_code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * (x @ book.T), axis=1)


def fit_codebooks(entries: DataFrame, n: int, codes: int = CODES) -> Codebooks:
    """Both halves' codewords by vector length, from the SAMPLE vectors with the smallest hashes of n entries. Lengths
    that the sample lacks are indexed under one codeword at the origin."""
    # About twice as many as wanted pass, whatever n is, so the driver does not get SAMPLE rows of every task.
    passing = int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 30))
    hashed = entries.select("v", F.xxhash64("v").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < passing).distinct()
    sample = hashed.orderBy("h").limit(SAMPLE).collect()
    by_length: dict[int, list[list[int]]] = {}
    for row in sample:
        by_length.setdefault(len(row["v"]), []).append(row["v"])
    found = {}
    for length, rows in by_length.items():
        x = np.array(rows, float)
        found[length] = fit_half(x[:, : length // 2], codes), fit_half(x[:, length // 2 :], codes)
    return found


def books_of(length: int, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    half = length // 2
    return books.get(length) or (np.zeros((1, half)), np.zeros((1, length - half)))


class Cells:
    """The cells of some vectors of one length and shard; labels and ids go with the rows."""

    def __init__(self, x: np.ndarray, cell: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = x.shape[1] // 2
        codes = len(books[1])
        self.order = np.argsort(cell, kind="stable")
        ordered = cell[self.order]
        self.x = x[self.order]
        self.places, self.starts = np.unique(ordered, return_index=True)
        self.ends = np.append(self.starts[1:], len(x))
        self.halves = []
        for side, book, own in ((slice(0, half), books[0], ordered // codes), (slice(half, None), books[1], ordered % codes)):
            radius = np.zeros(len(book))
            apart = np.sqrt(((self.x[:, side] - book[own]) ** 2).sum(axis=1))
            np.maximum.at(radius, own, apart)
            self.halves.append((side, book, radius, own[self.starts]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries x cells) what no score of a cell's rows is above: the sum of the bounds of its two codewords."""
        total = np.zeros((len(q), len(self.places)))
        for side, book, radius, own in self.halves:
            part = q[:, side].astype(float)
            total += (part @ book.T + np.sqrt((part**2).sum(axis=1))[:, None] * radius)[:, own]
        return total + SLACK * (1 + np.abs(total))


def exact_type(x: np.ndarray, q: np.ndarray) -> type:
    """The type in which all products of x and q are exact; an error if even long integers are too short."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most >= 2.0**63:
        raise ValueError("components are too large for inner products in long integers")
    return np.float64 if most < EXACT else np.int64


def _offers(scores: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, none: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) in scores of those in a query's window that can be among its depth best; low is raised to the
    depth-th best score here."""
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    many = np.flatnonzero(inside.sum(axis=1) > depth)
    if len(many):
        kept = np.where(inside[many], scores[many], none)
        low[many] = np.partition(kept, kept.shape[1] - depth, axis=1)[:, -depth]
        inside[many] &= scores[many] >= low[many, None]
    return np.nonzero(inside)


def best_in(
    cells: Cells, ids: list[list[int]], q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
    labels: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[list[list[list[tuple[int, int]]]], np.ndarray]:
    """For each query and each of its windows (low to high) the k best (score, id) with another id than its own, smaller ids
    first among equal scores, and how many rows each query scored. labels, of vectors and of queries: rows of a query's
    label take no part.

    Each query visits cells by falling bound until no window can gain; a cell is multiplied at once with all queries that
    come to it in a round, and a round takes twice as many rows a query as the one before. Of a window's rows depth stay:
    an id is in at most common rows, so these have k ids but the query's own that are as good as any in the rows left out.
    """
    common = int(np.unique(np.concatenate([np.asarray(i) for i in ids]), return_counts=True)[1].max())
    depth = (k + 1) * common
    least = np.array([i[0] for i in ids])[cells.order]
    none = -np.inf if cells.x.dtype.kind == "f" else np.iinfo(np.int64).min
    sizes, windows = cells.ends - cells.starts, low.shape[1]
    found, seen = [[[] for _ in range(windows)] for _ in range(len(q))], np.zeros(len(q), np.int64)
    for first in range(0, len(q), TOGETHER):
        part = slice(first, first + TOGETHER)
        asked, floor, top, mine = q[part], low[part].astype(q.dtype), high[part].astype(q.dtype), own[part]
        bound = cells.bounds(asked)
        by = np.argsort(-bound, axis=1, kind="stable")
        # After so many cells: what the others' rows can score at most, and how many rows came.
        limit = np.append(np.take_along_axis(bound, by, axis=1), np.full((len(asked), 1), -np.inf), axis=1)
        passed = np.append(np.zeros((len(asked), 1), np.int64), np.cumsum(sizes[by], axis=1), axis=1)
        done, open_, block = np.zeros(len(asked), np.int64), floor <= top, BLOCK
        hits = [np.zeros(0, np.int64), np.zeros(0, asked.dtype), np.zeros(0, np.int64)]
        while (active := np.flatnonzero(open_.any(axis=1) & (done < len(sizes)))).size:
            goal = passed[active, done[active]] + block
            ends = np.minimum((passed[active] < goal[:, None]).sum(axis=1), len(sizes))
            turn = np.arange(len(sizes))
            at, turn = np.nonzero((turn >= done[active, None]) & (turn < ends[:, None]))
            which = by[active[at], turn]
            order = np.argsort(which, kind="stable")
            new = [hits]
            for pairs in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
                c, asks = which[pairs[0]], active[at[pairs]]
                for start in range(cells.starts[c], cells.ends[c], PIECE):
                    rows = slice(start, min(start + PIECE, cells.ends[c]))
                    scores = asked[asks] @ cells.x[rows].T
                    if labels:
                        scores[labels[1][part][asks, None] == labels[0][cells.order[rows]]] = none
                    for w in np.flatnonzero(open_[asks].any(axis=0)):
                        edge = floor[asks, w]
                        i, j = _offers(scores, edge, np.where(open_[asks, w], top[asks, w], none), depth, none)
                        floor[asks, w] = edge
                        new.append([asks[i] * windows + w, scores[i, j], start + j])
            slot, score, row = (np.concatenate([n[i] for n in new]) for i in range(3))
            order = np.lexsort((least[row], -score, slot))
            slot, score, row = slot[order], score[order], row[order]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
            full = rank == depth - 1
            at = slot[full] // windows, slot[full] % windows
            floor[at] = np.maximum(floor[at], score[full])
            hits = [x[rank < depth] for x in (slot, score, row)]
            done[active] = ends
            open_ &= limit[np.arange(len(asked)), done][:, None] >= floor
            block *= 2
        seen[part] = passed[np.arange(len(asked)), done]
        for slot, score, row in zip(*(x.tolist() for x in hits)):
            a = slot // windows
            found[first + a][slot % windows] += [(int(score), i) for i in ids[cells.order[row]] if i != mine[a]]
    return [[sorted(set(f), key=lambda f: (-f[0], f[1]))[:k] for f in w] for w in found], seen


def best_positives(cells: Cells, ids: list[list[int]], q: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """best_in for one query without a window."""
    found, seen = best_in(cells, ids, q[None], np.array([own]), *everything(1, q.dtype), k)
    return found[0][0], int(seen[0])


def everything(n: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Windows of n queries that all scores are in."""
    edge = np.finfo(kind) if np.dtype(kind).kind == "f" else np.iinfo(kind)
    return np.full((n, 1), edge.min + (edge.dtype.kind == "i"), kind), np.full((n, 1), edge.max, kind)


def entries_of(vectors: DataFrame, id_col: str, embedding_col: str, label_col: str) -> DataFrame:
    """id, v (whole numbers), label of the rows that take part, each once."""
    e = F.col(embedding_col)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(e.isNotNull() & (F.size(e) > 0) & finite & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.col(label_col).cast("long").alias("label")).distinct()


def index_of(entries: DataFrame, shards: int, books: Codebooks, kept: int) -> DataFrame:
    """shard, length, cell, label, v, ids: equal vectors of a label are one entry with their kept smallest ids (no anchor
    can use more), so that a vector that is very common costs one."""
    copies = Window.partitionBy("v", "label").orderBy("id")
    few = entries.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= kept)
    ids = few.groupBy("v", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch["length"])
            cell = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x, (one, two) = vectors_of(batch["v"].take(pa.array(at))).astype(float), books_of(int(length), shared.value)
                half = int(length) // 2
                cell[at] = nearest_code(x[:, :half], one) * len(two) + nearest_code(x[:, half:], two)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = ids.select(salt(shards, "v", "label").alias("shard"), F.size("v").alias("length"), "label", "v", "ids")
    return materialise(
        placed.mapInArrow(run, "shard int, length int, label long, v array<long>, ids array<long>, cell long"), "cells"
    )


def _search(index: DataFrame, anchors: DataFrame, shards: int, books: Codebooks, extra: str, answer: str, search) -> DataFrame:
    """What search says of every anchor (key, id, label, v, and the array extra) in each shard of its length; a shard's
    vectors come first in its task, then the anchors stream past."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(books)
    fields = {"key": "string", "id": "long", extra: "array<long>"}
    indexed = index.select("shard", "length", F.lit(False).alias("asks"), "label", "v", "cell", "ids", *(F.lit(None).cast(t).alias(c) for c, t in fields.items()))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = anchors.select(
        everywhere, F.size("v").alias("length"), F.lit(True).alias("asks"), "label", "v", F.lit(None).cast("long").alias("cell"),
        F.lit(None).cast("array<long>").alias("ids"), *fields,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "shard", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]) if len(keys) else ():
                part = batch.slice(start, end - start)
                if place != tuple(keys[start, :2]):
                    place, held, shard = tuple(keys[start, :2]), [], None
                if not keys[start, 2]:
                    held.append((vectors_of(part["v"]), part["cell"].to_numpy(), part["label"].to_numpy(), part["ids"].to_pylist()))
                    continue
                if held:
                    x, cell, label = (np.concatenate([h[i] for h in held]) for i in range(3))
                    shard, held = (x, cell, label, [i for h in held for i in h[3]], books_of(x.shape[1], shared.value)), []
                if shard is not None:
                    yield from search(*shard, part)

    by = ("length", "shard")
    # Several partitions a shard, so that few shards share one by their hashes.
    met = indexed.unionByName(asking).repartition(max(4 * shards, partitions(spark)), *by).sortWithinPartitions(*by, "asks", "label", "ids", "key")
    return met.mapInArrow(run, answer)


def _positives_in(k: int):
    def search(x, cell, label, ids, books, part):
        asked, queries = part["label"].to_numpy(), vectors_of(part["v"])
        keys, own = part["key"].to_pylist(), part["id"].to_numpy()
        out, kind = [], exact_type(x, queries)
        for value in np.unique(asked):
            rows = np.flatnonzero(label == value)
            if not len(rows):
                continue
            cells, mine, asks = Cells(x[rows].astype(kind), cell[rows], books), [ids[r] for r in rows], np.flatnonzero(asked == value)
            best, seen = best_in(cells, mine, queries[asks].astype(kind), own[asks], *everything(len(asks), np.dtype(kind)), k)
            for a, windows, n in zip(asks, best, seen.tolist()):
                out += [(keys[a], score, i, n) for score, i in windows[0]]
        names = ("key", "score", "id", "seen")
        yield pa.RecordBatch.from_pydict({c: pa.array([o[i] for o in out], pa.string() if i == 0 else pa.int64()) for i, c in enumerate(names)})

    return search


def _negatives_in(k: int):
    def search(x, cell, label, ids, books, part):
        asked, queries = part["label"].to_numpy(), vectors_of(part["v"])
        keys, positives = part["key"].to_pylist(), part["positives"].to_pylist()
        kind = exact_type(x, queries)
        # As many windows for all; those that an anchor lacks are empty, as are those of scores below zero.
        width = max(map(len, positives))
        low, high = np.ones((len(keys), width), np.int64), np.zeros((len(keys), width), np.int64)
        for a, scores in enumerate(positives):
            low[a, : len(scores)], high[a, : len(scores)] = [-(-p // 2) for p in scores], [19 * p // 20 for p in scores]
        best, seen = best_in(
            Cells(x.astype(kind), cell, books), ids, queries.astype(kind), part["id"].to_numpy(), low, high, k, (label, asked)
        )
        out = []
        for a, (found, n) in enumerate(zip(best, seen.tolist())):
            out += [(keys[a], p, score, i, n) for p, window in zip(positives[a], found) for score, i in window]
        names = ("key", "positive_score", "score", "id", "seen")
        yield pa.RecordBatch.from_pydict({c: pa.array([o[i] for o in out], pa.string() if i == 0 else pa.int64()) for i, c in enumerate(names)})

    return search


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: str | Column = "label",
    id_col: str = "vec_id",
    embedding_col: str = "embedding",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    shards: int | None = None,
    codes: int = CODES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components x count as floor(256 x), scores are inner products of these. Anchors are the rows whose id, as column id,
    the condition anchors holds. An anchor's positives are its n_positives best rows with its label and another id; for
    each, the first n_negatives rows with another label follow whose score is from half to 0.95 of the positive's. Equal
    scores go by the smaller id. Rows with a null id or label, or a vector that is null, empty or holds a null, NaN or
    infinite component, take no part; an anchor meets vectors of its own length. Rows that repeat count once; a repeated
    id with other vectors or labels is a row of its own, as an anchor too. Scores that long integers cannot hold are an
    error. An empty table gives an empty table.
    """
    named = vectors.withColumn("__label", label if isinstance(label, Column) else F.col(label))
    entries = materialise(entries_of(named, id_col, embedding_col, "__label"), "vectors")
    n, components = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if shards is None:
        spread = min(partitions(vectors.sparkSession), -(-n // LEAST_VECTORS))
        shards = max(1, -(-components // SHARD_COMPONENTS), spread)
    books = fit_codebooks(entries, n, codes)
    index = index_of(entries, shards, books, max(n_positives + 1, n_negatives))
    key = F.concat_ws("/", "id", "label", F.xxhash64("v")).alias("key")
    asking = entries.where(anchors).select(key, "id", "label", "v")
    none = F.array().cast("array<long>").alias("positives")
    near = _search(
        index, asking.select("*", none), shards, books, "positives", "key string, score long, id long, seen long", _positives_in(n_positives)
    )
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    positives = materialise(
        near.select("key", "score", "id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_positives)
        .select("key", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")),
        "positives",
    )
    windows = positives.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("positives"))
    far = _search(
        index, asking.join(windows, "key"), shards, books, "positives",
        "key string, positive_score long, score long, id long, seen long", _negatives_in(n_negatives),
    )
    order = Window.partitionBy("key", "positive_score").orderBy(F.desc("score"), "id")
    first = (
        far.select("key", "positive_score", "score", "id").distinct()
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    )
    return positives.join(first, ["key", "positive_score"]).select(
        F.split_part("key", F.lit("/"), F.lit(1)).cast("long").alias("anchor_id"), "positive_id", "rank",
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50, labels moved on where it is divisible by 7; see
    hard_negatives for nulls, ties and repeats."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, moved)


ORACLE_SQL = """
WITH rows_ AS (
    SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ r ON a.id % 50 = 0 AND r.id <> a.id AND len(a.v) = len(r.v)
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
