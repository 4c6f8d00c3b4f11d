"""Customers behind transactions are counted by bits of words, not by moving a row for each of them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import transaction
from ledgerline.sources import warehouse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    """With customers and amounts that are not known, and customers of large and negative numbers."""
    s = warehouse.load(spark, SF)
    t = s.fact_transactions
    who = F.when(F.col("transaction_id") % 7 == 0, None).when(F.col("transaction_id") % 5 == 0, F.col("customer_id") - 2**62).otherwise(F.col("customer_id"))
    return replace(s, fact_transactions=t.withColumn("amount", F.when(F.col("transaction_id") % 11 > 0, F.col("amount"))).withColumn("customer_id", who))


@pytest.mark.parametrize("job", [transaction.txn_high_value, transaction.txn_holiday, transaction.txn_weekend])
def test_no_row_a_customer(star, job):
    assert "distinct" not in job(star)._jdf.queryExecution().analyzed().toString()


def test_high_value_by_brute_force(star):
    want = star.fact_transactions.where("is_high_value").groupBy("merchant_category").agg(
        F.count(F.lit(1)), F.floor(F.sum("amount").cast("double") + 0.5).cast("double"),
        F.floor(F.sum("amount").cast("double") / F.count("amount") + 0.5).cast("double"), F.count_distinct("customer_id"),
    )
    got = transaction.txn_high_value(star).drop("share_pct")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
