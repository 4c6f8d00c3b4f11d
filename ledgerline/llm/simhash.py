"""SimHash near-duplicates by sharded BK-trees (operator 9).

Two 64-bit fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, or on k of r + k, so the
fingerprints are dealt into shards by the values of chosen blocks; no link is lost. A shard that is too large for a tree
is dealt again by blocks of the bits that are left. Each shard becomes a BK-tree, in the task that searches it: children hang at the integer Hamming distance to their parent, and a search with radius r that stands at distance d
follows the edges from d - r to d + r alone. All trees of a partition are built and searched level by level with numpy.
A shard gives back its links as stars (at most one row for each fingerprint), which keeps what is connected;
components over all shards follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read_table
from .components import connected_components

BITS = 64
#: Links: at most so many differing bits.
RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in a tree; a larger shard is dealt again, and what is still larger is split into several trees, and every
#: part searches every tree.
TREE_SIZE = 1024
#: A fingerprint of one in so many documents, or more, is joined by broadcast.
COMMON_SHARE = 1000
#: (fingerprint, node) pairs that a search handles at once.
FRONTIER = 1 << 20
#: A long text is split into words in blocks of this many bytes.
BLOCK_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of data (runs of bytes other than ASCII white space), in blocks of bounded size."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        gap = _SPACE.search(data, end) if end < len(data) else None
        stop = gap.end() if gap else len(data)
        yield data[at:stop].split()
        at = stop


def simhash(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half the hashes of the text's word shingles.

    Words are lower-cased in A-Z only. A text of fewer words than a shingle has one, all its words; no word gives 0.
    """
    data = (text or "").encode().lower()
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(data):
        words = carry + words
        n = len(words) - shingle + 1
        if n > 0:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle))))), "<u8", n)
            for i in range(0, n, 1 << 16):
                part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and carry:
        return digest(b" ".join(carry))
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > total))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """id_col, carried columns and fp (the fingerprint as a signed long) of every row; a null text counts as empty.
    No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py(), shingle) for t in batch.column(text_col)], np.uint64)
            kept = [batch.column(c) for c in (id_col, *carried)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.view(np.int64))], names=[id_col, *carried, "fp"])

    fields = [docs.schema[c] for c in (id_col, *carried)]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col, *carried).mapInArrow(run, schema)


def shard_masks(n: float, radius: int) -> list[int]:
    """Bit masks; two fingerprints at most radius apart agree under one mask at least.

    With radius + k blocks, k of them agree. k grows with the number n of fingerprints, so that a shard of
    fingerprints with even bits stays below about 64.
    """
    k = 1
    while k < 4 and n / 2 ** (BITS * k // (radius + k)) > 64:
        k += 1
    edges = [BITS * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, k)]


class Forest:
    """BK-trees, one for each tree number, over fingerprints x (distinct within a tree)."""

    def __init__(self, x: np.ndarray, tree: np.ndarray):
        self.x = x
        n = len(x)
        _, first, of = np.unique(tree, return_index=True, return_inverse=True)
        self.roots = first
        at = first[of]  # the node at which each fingerprint stands while it is passed down
        edges, children = [], []
        moving = np.flatnonzero(at != np.arange(n))
        while len(moving):
            d = np.bitwise_count(x[moving] ^ x[at[moving]]).astype(np.int64)
            edge = at[moving] * (BITS + 1) + d
            keys, first, of = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            children.append(moving[first])  # the first to come along an edge stays as its child
            at[moving] = moving[first][of]
            moving = moving[at[moving] != moving]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def search(self, y: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in y, node) for all nodes of the tree under root[i] at most radius from y[i], in blocks."""
        todo = [(np.arange(len(y)), root)]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(y[q] ^ self.x[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.edge, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edge, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            if n.any():
                ends = np.cumsum(n)
                step = np.arange(ends[-1]) - np.repeat(ends - n, n)
                todo.append((np.repeat(q, n), self.child[np.repeat(low, n) + step]))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that is linked by (a, b) one label, the least of them; label[i] <= i throughout."""
    while True:
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))


def shard_links(key: np.ndarray, x: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (a, b) that connect, within each run of equal keys, whatever links of at most radius bits connect.

    Members of a run make its tree; the others only search it.
    """
    order = np.lexsort((~member, key))
    key, x, member = key[order], x[order], member[order]
    u = x.view(np.uint64)
    inside = np.flatnonzero(member)
    if not len(inside):
        return x[:0], x[:0]
    forest = Forest(u[inside], key[inside])
    roots = forest.roots
    slot = np.searchsorted(key[inside][roots], key)
    slot[slot == len(roots)] = 0
    can = key[inside][roots][slot] == key
    asks = np.flatnonzero(can)
    label = np.arange(len(x))
    for q, node in forest.search(u[asks], roots[slot[asks]], radius):
        a, b = asks[q], inside[node]
        other = a != b
        hook(label, a[other], b[other])
    moved = np.flatnonzero(label != np.arange(len(x)))
    return x[moved], x[label[moved]]


def further_masks(mask: int, radius: int) -> list[int]:
    """radius + 1 masks over the bits that mask leaves: of two fingerprints at most radius apart that agree under mask,
    one at least agrees too."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << i for i in rest[a:b]) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links that connect all fingerprints fp of distinct which are within radius bits of each other."""
    masks = shard_masks(distinct.count(), radius)
    first = distinct.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(_signed(m)) for m in masks))).alias("mask", "block"),
    ).select("fp", "mask", F.xxhash64("mask", "block").alias("shard"))

    def large(dealt: DataFrame) -> DataFrame:
        """The shards of over tree_size fingerprints, and how many trees each would fill."""
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_size)
        return sizes.select("shard", F.ceil(F.col("n") / tree_size).cast("int").alias("parts"))

    # A large shard is dealt again by the bits it does not agree on yet.
    split = first.join(large(first), "shard", "left")
    more = F.array(*(F.array(*map(_signed, further_masks(m, radius))) for m in masks))
    again = split.where("parts is not null").select(
        "fp", "mask", "shard", F.posexplode(F.element_at(more, F.col("mask") + 1)).alias("further", "bits")
    ).select("fp", F.xxhash64("shard", "further", F.col("fp").bitwiseAND(F.col("bits"))).alias("shard"))
    # What is large even then is cut into parts; each two parts meet in one group of bounded size.
    second = again.join(large(again), "shard", "left").select("fp", "shard", F.coalesce("parts", F.lit(1)).alias("parts"))
    whole = (
        split.where("parts is null").select("fp", "shard", F.lit(1).alias("parts")).unionByName(second)
        .withColumn("part", F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int"))
    )
    met = whole.select(
        "fp", "shard", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("meeting"),
        "fp",
        (F.col("part") <= F.col("other")).alias("member"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def stars(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = shard_links(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "fp", "member")))
            rows = tuple(np.concatenate(x) for x in zip(*held))
            split = np.searchsorted(rows[0], rows[0][-1], "left") if len(rows[0]) else 0
            held = [tuple(x[split:] for x in rows)]  # the last group may go on in the next batch
            if split:
                yield stars(tuple(x[:split] for x in rows))
        if held and len(held[0][0]):
            yield stars(held[0])

    return met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def _signed(mask: int) -> F.Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, carried columns, fp, root and component_id of every row of docs: the smallest fingerprint and the
    smallest id reachable over links of at most radius bits.

    Equal fingerprints are one node, so a group of copies of any size costs one. Null texts count as empty; texts
    without a word have fingerprint 0 and are linked like any other. A null id never names a component unless all
    ids of it are null. Rows that repeat are all returned; an empty table gives an empty table.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle, carried), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")), "nodes")
    joined = connected_components(links(nodes.select("fp"), radius))
    rooted = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", "n", F.coalesce("component", "fp").alias("root")
    )
    # Only fingerprints with links need their root's smallest id; it is joined back through the nodes.
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "n", "root", "component_id"), "named")
    # A fingerprint that many documents share must not meet in one task: those few are broadcast.
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * COMMON_SHARE >= total
    hot = F.broadcast(named.where(common).drop("n"))  # at most COMMON_SHARE rows
    joined = marked.join(hot, "fp").unionByName(
        marked.join(hot.select("fp"), "fp", "left_anti").join(named.where(~common).drop("n"), "fp")
    )
    return joined.select(id_col, *carried, "fp", "root", "component_id")


def op9_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates for nulls, empty texts and repeats."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
