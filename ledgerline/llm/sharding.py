"""Resharding by minimum-cost flow (operator 10).

Documents lie in old shards; each is a folder of files, and each file holds some of the shard's blocks, into which rows
fall by a hash of their place. From the old shards' sizes and the new capacities a minimum-cost flow says how many bytes go from where
to where (staying is free); whole blocks realise it, those of one file together where they can. The plan has at most
shards x BLOCKS rows whatever the corpus, so it is made on the driver and broadcast. Only files with a block that moves
are written anew; all others stay as they are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, salt, scratch_path

SHARDS = 24
#: Blocks per old shard, and how many of them lie in one file.
BLOCKS = 256
FILE_BLOCKS = 16
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Bytes of rows, about, in a part of a block: what one task writes or orders.
PART_BYTES = 128 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that ships all supply within capacity at least cost, by successive shortest paths.

    Costs must not be negative; the capacities must take all supply.
    """
    n, k = len(supply), len(capacity)
    source, sink = n + k, n + k + 1
    edges: list[list[int]] = []  # to, free, cost; the reverse edge follows each
    out: list[list[int]] = [[] for _ in range(n + k + 2)]

    def edge(a: int, b: int, free: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, free, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(k):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, left = [0] * len(out), sum(supply)
    while left:
        price, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            p, a = heapq.heappop(heap)
            if p > price[a]:
                continue
            for e in out[a]:
                b, free, c = edges[e]
                q = p + c + potential[a] - potential[b]
                if free and q < price.get(b, q + 1):
                    price[b], by[b] = q, e
                    heapq.heappush(heap, (q, b))
        if sink not in price:
            raise ValueError("the capacities do not take all supply")
        far = max(price.values())
        potential = [p + price.get(a, far) for a, p in enumerate(potential)]
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
        left -= amount
    flow = [[0] * k for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0 and edges[e][0] < n + k:
                flow[i][edges[e][0] - n] = edges[e ^ 1][1]
    return flow


class Block(NamedTuple):
    old: int
    block: int
    size: int
    rows: int


def plan_blocks(blocks: list[Block], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The new shard of every block (old, block), near the flow that moves the fewest bytes."""
    olds = sorted({b.old for b in blocks})
    at = {old: i for i, old in enumerate(olds)}
    supply = [0] * len(olds)
    for b in blocks:
        supply[at[b.old]] += b.size
    cost = [[int(old != j) for j in range(len(capacity))] for old in olds]
    quota = min_cost_flow(supply, capacity, cost)
    room, to = list(capacity), {}
    # A shard's first blocks stay while they fit; each of the others goes where most of its shard's flow is still open.
    for b in sorted(blocks):
        open_ = quota[at[b.old]]
        home = b.old < len(open_) and open_[b.old] >= b.size
        j = b.old if home else max(range(len(open_)), key=lambda j: (open_[j], -j))
        open_[j] -= b.size
        room[j] -= b.size
        to[b.old, b.block] = j
    level(blocks, to, room)
    return to


def level(blocks: list[Block], to: dict[tuple[int, int], int], room: list[int]) -> None:
    """Move a block, or swap two, from the fullest to the emptiest shard while that brings the two nearer.

    Blocks that are away from home anyway go first, since that moves no further byte. Each step lowers the sum of
    squares of room, so the steps end.
    """
    inside: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        inside[to[b.old, b.block]].append(b)

    def best(mine: list[Block], theirs: list[Block], gap: int) -> tuple[int, Block, Block | None] | None:
        theirs = sorted(theirs, key=lambda b: (b.size, b))
        sizes = [b.size for b in theirs]
        gives = [(b.size, b, None) for b in mine]
        for b in mine:  # with the block of the other side that comes nearest to half the gap
            i = _nearest(sizes, b.size - gap // 2)
            if i is not None:
                gives.append((b.size - theirs[i].size, b, theirs[i]))
        return min((g for g in gives if 0 < g[0] < gap), key=lambda g: (abs(2 * g[0] - gap), g[1]), default=None)

    while True:
        full = min(range(len(room)), key=lambda j: (room[j], j))
        empty = max(range(len(room)), key=lambda j: (room[j], -j))
        gap = room[empty] - room[full]
        away = lambda j: [b for b in inside[j] if b.old != j]
        step = best(away(full), away(empty), gap) or best(inside[full], inside[empty], gap)
        if step is None:
            return
        amount, mine, other = step
        inside[full].remove(mine)
        inside[empty].append(mine)
        to[mine.old, mine.block] = empty
        if other:
            inside[empty].remove(other)
            inside[full].append(other)
            to[other.old, other.block] = full
        room[full] += amount
        room[empty] -= amount


def _nearest(sizes: list[int], x: int) -> int | None:
    i = bisect_left(sizes, x)
    return min((k for k in (i - 1, i) if 0 <= k < len(sizes)), key=lambda k: abs(sizes[k] - x), default=None)


def sized(text_col: str) -> Column:
    """Bytes of a row: its text in UTF-8 (none for a null) and ROW_BYTES."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")


def write_shards(
    docs: DataFrame, old_shard: Column, folder: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs (id_col, text_col) written to folder as shards of files, and read back: the columns, block, old_shard and
    file. A file is one or more part files, so that a shard with most rows is written by several tasks.

    Blocks go by a hash of a row's place in its partition, so rows that repeat, however often, fall into all blocks alike. The
    place is written with the row and read from there; docs must be a table, whose partitions a lost task reads again in
    the same order."""
    block = salt(BLOCKS, F.monotonically_increasing_id())  # unequal blocks: their differences level the shards
    placed = docs.select(F.col(id_col), F.col(text_col), old_shard.cast("int").alias("old_shard"), block.alias("block"))
    marked = placed.select(
        F.col(id_col), F.col(text_col), "block", "old_shard", F.floor(F.col("block") / FILE_BLOCKS).cast("int").alias("file")
    )
    spread = F.pmod(F.xxhash64(F.lit(1), id_col, text_col), F.lit(max(1, partitions(docs.sparkSession) // SHARDS)))
    marked.repartition("old_shard", "file", spread).write.partitionBy("old_shard", "file").parquet(folder)
    return docs.sparkSession.read.schema(marked.schema).parquet(folder)


def reshard(
    docs: DataFrame, old_shard: Column, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs after resharding to equal capacities.

    old_shard: an int from 0 on for every row, computed from the row: the shards that there are, which are written
    next to folder. Shards get near equal sizes in bytes (a text's UTF-8 bytes plus ROW_BYTES; a null text has none) with
    the fewest bytes moved; files with a block that moves are written to folder, by new shard, all others stay.
    slot: place in the shard, gapless from 0. Equal texts are rows like others and may lie in
    several shards. Rows that repeat are placed once each, in all shards alike; null ids are rows like others. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    old = write_shards(docs, old_shard, f"{folder}-old", id_col, text_col)
    size = sized(text_col)
    by_block = old.groupBy("old_shard", "block")
    blocks = sorted(Block(*r) for r in by_block.agg(F.sum(size), F.count(F.lit(1))).collect())  # shards x BLOCKS rows
    total = sum(b.size for b in blocks)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    to = plan_blocks(blocks, capacity)
    start, first = [0] * shards, {}
    for b in blocks:
        j = to[b.old, b.block]
        first[b.old, b.block] = start[j]
        start[j] += b.rows
    touched = {(b.old, b.block // FILE_BLOCKS) for b in blocks if to[b.old, b.block] != b.old}
    plan = spark.createDataFrame(
        [(b.old, b.block, to[b.old, b.block], first[b.old, b.block], (b.old, b.block // FILE_BLOCKS) in touched) for b in blocks],
        "old_shard int, block int, shard int, first long, affected boolean",
    )
    files = spark.createDataFrame(sorted(touched), "old_shard int, file int")
    parts = 1 + max((b.size for b in blocks), default=0) // PART_BYTES
    placed = old.join(F.broadcast(plan), ["old_shard", "block"]).withColumn("part", salt(parts, id_col, text_col))
    affected = placed.join(F.broadcast(files), ["old_shard", "file"], "left_semi").drop("affected")
    affected.repartition("shard", "block", "part").write.partitionBy("shard").parquet(folder)
    written = spark.read.schema(affected.schema).parquet(folder) if touched else affected
    layout = placed.where("not affected").drop("affected").unionByName(written)
    key = ("old_shard", "block", "part")
    rows = layout.select(
        F.col(id_col), *key, "shard", "first", size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    earlier = Window.partitionBy("old_shard", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
        *key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    order = Window.partitionBy(*key).orderBy(id_col, "text_crc32")
    slot = F.col("first") + F.col("start") + F.row_number().over(order) - 1
    return rows.join(starts, list(key)).withColumn("slot", slot).select(id_col, "size", "text_crc32", "shard", "slot")


def op10_min_cost_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law bytes. The shards that there are go by a hash of source; see reshard for nulls, equal texts and repeats."""
    docs = read_table(spark, sf_dir, "documents")
    placed = reshard(docs, salt(SHARDS, "source"), scratch_path(spark, "shards"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
