"""Plans against the flow's bound, and which files a resharding touches."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import sharding

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_flow_and_levels_shards(seed):
    rng = random.Random(seed)
    weight = [rng.random() ** 2 for _ in range(13)]
    blocks = [sharding.Block(old, k, int(weight[old] * rng.uniform(900, 1100)) + 1, 3) for old in range(13) for k in range(256)]
    total = sum(b.size for b in blocks)
    capacity = [total // 24 + (j < total % 24) for j in range(24)]
    to = sharding.plan_blocks(blocks, capacity)
    assert set(to) == {(b.old, b.block) for b in blocks}
    supply = [sum(b.size for b in blocks if b.old == old) for old in range(13)]
    bound = sum(max(0, s - c) for s, c in zip(supply, capacity))
    moved = sum(b.size for b in blocks if to[b.old, b.block] != b.old)
    assert bound <= moved <= 1.005 * bound + 2 * max(b.size for b in blocks)
    sizes = [sum(b.size for b in blocks if to[b.old, b.block] == j) for j in range(24)]
    assert max(sizes) - min(sizes) <= max(b.size for b in blocks)


def test_one_old_shard_that_is_full():
    blocks = [sharding.Block(0, k, 10, 1) for k in range(240)]
    to = sharding.plan_blocks(blocks, [100] * 24)
    assert [sum(1 for j in to.values() if j == s) for s in range(24)] == [10] * 24


def test_files_without_moving_blocks_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = sharding.scratch_path(spark, "shards")
    got = sharding.reshard(docs, sharding.salt(24, "source"), folder).toPandas().set_index("doc_id")["shard"].to_dict()
    old = {r.doc_id: (r.old_shard, r.file) for r in spark.read.parquet(f"{folder}-old").collect()}
    assert set(old) == set(got)
    touched = {old[i] for i in got if got[i] != old[i][0]}
    written = {r.doc_id for r in spark.read.parquet(folder).select("doc_id").collect()}
    assert written == {i for i in got if old[i] in touched} and len(written) < len(got)


def test_rows_that_repeat_fill_all_shards(spark, table):
    """However often a row repeats: shards of one row's size within one row of each other, slots without gaps."""
    rows = [(None, "same text", "a", 1)] * 2000
    docs = table(rows, "doc_id long, text string, block string, shard int").repartition(3)
    for old in (F.lit(0), sharding.salt(24, "block")):
        got = sharding.reshard(docs, old, sharding.scratch_path(spark, "shards")).toPandas()
        counts = got.groupby("shard").size()
        assert len(got) == 2000 and len(counts) == 24 and counts.max() - counts.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_hot_row_among_others(spark, table):
    rows = [(i, f"text {i} " * (i % 40), "", 0) for i in range(1200)] + [(7, "a hot row " * 30, "", 0)] * 800
    got = sharding.reshard(table(rows, "doc_id long, text string, block string, shard int"), F.lit(3), sharding.scratch_path(spark, "shards")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 2000 and len(sizes) == 24 and sizes.max() - sizes.min() <= got["size"].max()
    assert got["size"].sum() == sum(len(t.encode()) + 8 for _, t, _, _ in rows)
