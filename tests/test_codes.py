"""Values that come by broadcast codes of keys, and sets of few values as bits, against joins and Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import bitsets
from ledgerline.operators.transforms import flag_high_value
from ledgerline.sources import adapter

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kinds", [1, 2, 63, 300])
@pytest.mark.parametrize("repeated", [False, True])
def test_values_equal_a_join(spark, kinds, repeated):
    draw = random.Random(kinds)
    keys = [-(2**63), -64, -1, 0, 63, 64, 2**63 - 1, *range(1000, 1400)]
    table = [(k, draw.choice([None, f"t{i % kinds}"]), i % 3) for i, k in enumerate(keys)] + [(None, "null", 1)] + [(5000, "twice", 1)] * (2 if repeated else 1)
    table = spark.createDataFrame(table, "k long, t string, u int")
    rows = spark.createDataFrame([(draw.choice([None, 7, 5000, *keys]), i) for i in range(2000)], "k long, i long").repartition(3)
    got = bitsets.with_values(rows, "k", table, ["t", "u"])
    want = rows.join(table, "k")
    assert sorted(got.select("k", "i", "t", "u").collect(), key=repr) == sorted(want.select("k", "i", "t", "u").collect(), key=repr)
    assert ("__plane0" in plan(got)) != repeated
    assert bitsets.with_values(rows, "k", table.limit(0), ["t", "u"]).count() == 0


def test_no_codes_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(bitsets, "KINDS", 2)
    table = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"))
    found = bitsets.with_values(spark.range(20).select(F.col("id").alias("k")), "k", table, ["t"])
    assert "__plane0" not in plan(found) and found.count() == 10


def test_repeated_keys_are_no_key_set(spark):
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert bitsets.unique_key_set(keys, "k") is not None
    assert bitsets.unique_key_set(keys.union(keys), "k") is None


@pytest.mark.parametrize("values", [3, 64, 65])
def test_few_distinct(spark, values):
    rows = [(i % 7, f"v{i * 31 % values}" if i % 5 else None, i % 3 > 0) for i in range(1500)] + [(99, None, True), (98, "v1", False)]
    df = spark.createDataFrame(rows, "g int, c string, x boolean").repartition(4)
    got = dict(map(tuple, df.groupBy("g").agg(bitsets.few_distinct(df, "c", F.col("x"))).collect()))
    assert got == {g: len({c for h, c, x in rows if h == g and x and c is not None}) for g in {r[0] for r in rows}}


def test_a_category_stays_where_its_rows_are(spark):
    """Rows met their category's quartile in a join that sent each category to one task."""
    rows = spark.range(1000).select(F.lit("one").alias("merchant_category"), F.col("id").cast("double").alias("amount"))
    flagged = flag_high_value(rows)
    assert flagged.where("is_high_value").count() == 250
    assert "Exchange hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_lines_move_once(spark):
    found = adapter.fact_transactions(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in found.splitlines() if "Join" in line]
    assert sum("BroadcastHashJoin" in j or "BroadcastNestedLoopJoin" in j for j in joins) >= 3 and "__plane0" in found
