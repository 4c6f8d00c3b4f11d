"""Rounds of best fit over several ranges against the sequential answer."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import packing

from .test_text_operators import check_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=8))
def test_gaps_take_the_nearest_pieces_below(counts):
    left = [(at, pieces, gaps) for at, (pieces, gaps) in enumerate(counts)]
    free, want = [], {}
    for at, pieces, gaps in left:
        for g in range(gaps):
            if free:
                want[free.pop()] = (at, g)
        free += [(at, k) for k in reversed(range(pieces))]
    got = {(of, k): (at, k + shift) for of, first, end, at, shift in packing.carried(left) for k in range(first, end)}
    assert got == want


def sequential(lengths, capacity):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    return packing.best_fit_rounds(counts, capacity)[1]


@pytest.mark.parametrize("kind", ["even", "small", "one length", "full"])
def test_rounds_pack_like_the_sequential_answer(spark, many_ranges, kind):
    rng = random.Random(3)
    draw = {"even": lambda: rng.randint(1, 1024), "small": lambda: rng.randint(1, 90), "full": lambda: 1024,
            "one length": lambda: 300 if rng.random() < 0.4 else rng.randint(1, 700)}[kind]
    lengths = [draw() for _ in range(3000)]
    pieces = spark.createDataFrame([(i // 2 if i % 5 else None, n, "mine") for i, n in enumerate(lengths)], "doc_id long, length long, offset string")
    got = packing.pack(pieces.repartition(4), "length").toPandas()
    assert sorted(got["length"]) == sorted(lengths) and got["doc_id"].isna().sum() == 600
    check_packed(got, 1024)
    assert got["sequence_id"].nunique() <= 1.01 * sequential(lengths, 1024) + 2


def test_hot_lengths_are_dealt_over_ranges(spark, many_ranges):
    items = spark.range(4000).select(F.lit(100).alias("size"), (F.col("id") % 2).cast("int").alias("kind"), "id", F.lit(0).alias("used"))
    found = packing.swept(items)
    assert max(r["count"] for r in found.groupBy("range").count().collect()) < 2000


def test_op2_packs_whole_documents(spark):
    got = packing.op2_best_fit_packing(spark, SF).toPandas()
    check_packed(got, 1024)
    assert set(got["doc_id"]) == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got["sequence_id"].nunique() <= 1.01 * -(-got["length"].sum() // 1024) + 2


@pytest.mark.parametrize("rows", [60, 400])
def test_ranges_hold_a_bounded_number_of_rows(spark, monkeypatch, rows):
    """With few shuffle partitions there are as many ranges as the rows ask for, and the packing stays near the bound."""
    most, sweep = [], packing.swept

    def counted(items, ranges=None):
        found = sweep(items, ranges)
        sizes = items.repartitionByRange(ranges, "size", "kind", "id").groupBy(F.spark_partition_id()).count().collect()
        most.append(max(r["count"] for r in sizes))
        return found

    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    monkeypatch.setattr(packing, "swept", counted)
    rng = random.Random(rows)
    lengths = [rng.choice([20, 30, 31, rng.randint(1, 400)]) for _ in range(4000)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long").repartition(3), "length").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(most) <= 4 * rows
    assert sorted(got["length"]) == sorted(lengths)
    check_packed(got.reset_index(names="doc_id"), 1024) if "doc_id" not in got else check_packed(got, 1024)
    assert got["sequence_id"].nunique() <= 1.01 * -(-sum(lengths) // 1024) + 2
