"""Profiles that grow by batches against those of all rows at once."""

import datetime
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import transforms as X
from ledgerline.sources import profiles

KIND = "merchant_category string, amount decimal(15,2), merchant_name string, transaction_date timestamp"


def rows(seed, n):
    draw = random.Random(seed)
    scale = {"a": 1, "b": 1000, "c": 10**6, None: 3}
    found = []
    for _ in range(n):
        category = draw.choice(list(scale))
        amount = decimal.Decimal(str(round(draw.choice([-1, 1, 1, 1]) * draw.expovariate(1) * scale[category], 2)))
        if draw.random() < 0.05:
            amount = draw.choice([None, decimal.Decimal(0), decimal.Decimal("0.01"), decimal.Decimal("9999999999999.99")])
        at = datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=draw.randrange(9000))
        found.append((category, amount, draw.choice([None, *(f"m{i:02}" for i in range(30))]), draw.choice([at, at, at, None])))
    return found


def same(a, b):
    order = lambda df: sorted((tuple(r) for r in df.select(*sorted(a.columns)).collect()), key=repr)
    return order(a) == order(b)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    for i, n in enumerate([700, 1, 2000]):
        spark.createDataFrame(rows(i, n), KIND).coalesce(1).write.parquet(f"{folder}/{i}")
    return [spark.read.parquet(f"{folder}/{i}") for i in range(3)]


def test_merged_equals_recomputed(spark, parts, tmp_path):
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = profiles.profile(whole)
    folder = str(tmp_path / "p")
    for i, part in enumerate(parts):
        profiles.add(profiles.profile(part), folder, f"day-{i}")
    assert same(profiles.stored(spark, folder), want)
    profiles.add(profiles.profile(parts[2]), folder, "day-2")  # once more
    assert same(profiles.stored(spark, folder), want)
    profiles.add(profiles.profile(parts[1].limit(0)), folder, "day-1")  # withdrawn
    assert same(profiles.stored(spark, folder), profiles.merged(profiles.profile(parts[0].unionByName(parts[2]))))


def test_a_batch_that_fails_leaves_the_others(spark, parts, tmp_path):
    folder = str(tmp_path / "p")
    profiles.add(profiles.profile(parts[0]), folder, "x")
    bad = profiles.profile(parts[2]).withColumn("n", F.when(F.col("part") == "rows", F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        profiles.add(bad, folder, "x")
    assert same(profiles.stored(spark, folder), profiles.profile(parts[0]))


def test_says_what_the_rows_say(spark, parts):
    whole = parts[0].unionByName(parts[2])
    p = profiles.merged(profiles.profile(parts[0]).unionByName(profiles.profile(parts[2])))
    named = lambda df: df.withColumnRenamed("category", "merchant_category")
    assert same(named(profiles.categories(p)), X.profile_categories(whole))
    assert same(named(profiles.merchants(p)), X.profile_merchants(whole))
    for name, part in (("hour", F.hour("transaction_date")), ("weekday", F.weekday("transaction_date")), ("month", F.month("transaction_date"))):
        assert same(profiles.weights(p, name), X.profile_weights(whole, part, name))
    want = {r.merchant_category: r for r in X.profile_amounts(whole).collect()}
    got = {r.category: r for r in profiles.amounts(p).collect()}
    assert set(got) == set(want) == {"a", "b", "c", None}
    for k, r in got.items():
        assert (r.min, r.max) == (want[k].min, want[k].max)
        assert r.mean == pytest.approx(want[k].mean, rel=1e-12, abs=1e-6) and r.std == pytest.approx(want[k].std, rel=1e-9)
        values = sorted(float(x.amount) for x in whole.where(F.col("merchant_category").eqNullSafe(k)).select("amount").collect() if x.amount is not None)
        for q, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            place = (len(values) - 1) * share
            ends = values[math.floor(place)], values[math.ceil(place)]
            assert abs(r[q] - want[k][q]) <= 0.01 * max(map(abs, ends)) + 1e-6, (k, q)


def test_odd_tables(spark):
    none = profiles.merged(profiles.profile(spark.createDataFrame([], KIND)))
    assert [(r.part, r.n) for r in none.collect()] == [("rows", 0)]
    assert profiles.amounts(none).count() == profiles.categories(none).count() == profiles.weights(none, "hour").count() == 0
    odd = spark.createDataFrame([("a", "x", None, None), ("a", "2", None, None), ("b", None, "m", None)], "merchant_category string, amount string, merchant_name string, transaction_date timestamp")
    got = {r.category: r for r in profiles.amounts(profiles.profile(odd)).collect()}
    assert (got["a"].mean, got["a"].std, got["a"].median) == (2.0, None, 2.0) and got["b"].mean is None


def test_bins_keep_the_order_and_are_narrow(spark):
    values = sorted({round(s * 1.37**i, 2) for i in range(-14, 90) for s in (-1, 1)} | {0.0, 0.01, -0.01, 1.0, 1.01})
    df = spark.createDataFrame([(decimal.Decimal(str(v)),) for v in values if abs(v) < 1e13], "x decimal(15,2)")
    bins = [(r.x, r.b) for r in df.orderBy("x").select("x", profiles.bin_of(F.col("x")).alias("b")).collect()]
    assert [b for _, b in bins] == sorted(b for _, b in bins)
    assert all((x > 0) == (b > 0) and (x < 0) == (b < 0) for x, b in bins) and len({b for _, b in bins}) <= 6946
