"""Repeated windows where hashes collide, against brute force."""

import collections
import random

from pyspark.sql import functions as F

from ledgerline.llm import quality


def brute(words):
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    return len({k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)})


def test_windows_that_share_a_hash(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))] for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, words array<string>")
    few = lambda *w: F.shiftleft(F.pmod(F.xxhash64(*w), F.lit(5)), 58)
    for hash_of in (F.xxhash64, few):
        got = {r.id: r.n for r in df.select("id", quality.repeated_words(F.col("words"), hash_of).alias("n")).collect()}
        assert got == {i: brute(t) for i, t in enumerate(texts)}
