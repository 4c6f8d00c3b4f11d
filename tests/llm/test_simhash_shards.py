"""Shards that are dealt again, and fingerprints that many documents share."""

import random

from pyspark.sql import functions as F

from ledgerline.llm import simhash

from .test_relations import brute_components, close


def test_further_masks_lose_nothing():
    rng = random.Random(2)
    for mask in simhash.shard_masks(10, 3) + simhash.shard_masks(2**31, 3):
        further = simhash.further_masks(mask, 3)
        assert mask + sum(further) == 2**64 - 1
        rest = [i for i in range(64) if not mask >> i & 1]
        for _ in range(50):
            x = rng.getrandbits(64)
            y = x
            for i in rng.sample(rest, 3):
                y ^= 1 << i
            assert any(x & m == y & m for m in further)


def test_shards_that_stay_large(spark):
    rng = random.Random(5)
    x = {rng.getrandbits(18) << 2 for _ in range(150)} | {rng.getrandbits(6) for _ in range(40)} | {rng.getrandbits(64) for _ in range(40)}
    signed = sorted(v - 2**64 if v >> 63 else v for v in x)
    near = [(a, b) for a in signed for b in signed if a < b and close(a % 2**64, b % 2**64, 3)]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, 8).collect()
    assert all(close(r.a % 2**64, r.b % 2**64, 64) for r in found)
    assert brute_components(signed, [(r.a, r.b) for r in found]) == brute_components(signed, near)


def test_common_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON_SHARE", 4)
    texts = ["a text of which there are many copies"] * 50 + [f"text number {i} of the others {i * i}" for i in range(40)] + [None] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("mine"))
    got = simhash.near_duplicates(docs, carried=("n",)).collect()
    assert len(got) == len(texts) and {r.n for r in got} == {"mine"}
    by = {r.doc_id: r.component_id for r in got}
    assert {by[i] for i in range(50)} == {0} and {by[i] for i in range(90, 120)} == {90}
