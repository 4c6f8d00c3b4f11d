"""Sets as words against Python sets: negative and large numbers, nulls, empty tables, sets that are merged, and orphans."""

import random

from pyspark.sql import functions as F

from ledgerline.functions import bitsets
from ledgerline.plans import quality, revenue
from ledgerline.sources import warehouse

SF = "/root/testdata/sf0.001"


def sample(spark, n=4000):
    draw = random.Random(n)
    keys = [None, -1, -64, -65, 0, 63, 64, 2**62, -(2**63), 2**63 - 1, *range(100, 400)]
    rows = [(draw.choice([None, "a", "b", "c"]), draw.choice([1, 2]), draw.choice(keys), draw.choice([None, 1, 5])) for _ in range(n)]
    rows += [("none", 1, None, 3)] * 3
    return rows, spark.createDataFrame(rows, "g string, h int, k long, x int").repartition(5)


def test_counts_equal_sets(spark):
    rows, df = sample(spark)
    got = {r.g: r[1:] for r in bitsets.distinct(df, ["g"], "k", "members", n=F.count(F.lit(1)), s=F.sum("x")).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        assert got.pop(g) == (len({r[2] for r in mine} - {None}), len(mine), sum(r[3] or 0 for r in mine))
    assert not got
    assert bitsets.distinct(df.limit(0), ["g"], "k", "members").collect() == []
    assert bitsets.distinct(df, [], "k", "members").first()[0] == len({r[2] for r in rows} - {None})


def test_finer_sets_roll_up(spark):
    _, df = sample(spark)
    fine = bitsets.with_members(df, ["g", "h"], "k", n=F.count(F.lit(1)))
    for keys in (["g"], ["h"], []):
        rolled = bitsets.counted(bitsets.rolled_up(fine, keys, ["n"]), keys, "members", ["n"])
        straight = bitsets.distinct(df, keys, "k", "members", n=F.count(F.lit(1)))
        assert sorted(rolled.collect(), key=repr) == sorted(straight.collect(), key=repr)


def test_lost_keys_by_words_and_by_join(spark, monkeypatch):
    s = warehouse.load(spark, SF)
    s = s.__class__(**{**s.__dict__, "dim_customer": s.dim_customer.where("customer_id % 7 <> 0").union(s.dim_customer.limit(3))})
    facts = s.fact_transactions.withColumn("customer_id", F.when(F.col("transaction_id") % 11 > 0, F.col("customer_id") - 5))
    s = s.__class__(**{**s.__dict__, "fact_transactions": facts})
    links = {"c": ("customer_id", "dim_customer"), "p": ("product_id", "dim_product")}
    there = {r[0] for r in s.dim_customer.select("customer_id").collect()}
    lost = sum(r[0] is not None and r[0] not in there for r in facts.select("customer_id").collect())
    found = quality.orphan_counts(s, "fact_transactions", links)
    assert tuple(found.first()) == (lost, 0) and lost > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    monkeypatch.setattr(bitsets, "WORDS", 1)  # as if the parents had too many keys to broadcast
    found = quality.orphan_counts(s, "fact_transactions", links)
    assert tuple(found.first()) == (lost, 0) and "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_expand_and_no_pairs(spark):
    s = warehouse.load(spark, SF)
    rows = revenue.with_customers(revenue.dated(s, "year", "month_number"), "year", "month_number")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan and "SortAggregate" not in plan and "Sort " not in plan
