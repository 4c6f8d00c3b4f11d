"""Every analytics query on a warehouse that was stored before, and the hours of its transactions."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerline import catalog, schema
from ledgerline.plans import derived, models, views
from ledgerline.plans.registry import QUERIES
from ledgerline.sources import warehouse

SF = "/root/testdata/sf0.001"
catalog.queries()


@pytest.fixture(scope="module")
def stored(spark):
    return warehouse.open_warehouse(spark, warehouse.load(spark, SF).folder)


@pytest.fixture(scope="module")
def in_catalog(spark):
    s = warehouse.load(spark, SF)
    spark.sql("CREATE DATABASE IF NOT EXISTS all_queries")
    for t in schema.TABLES:
        getattr(s, t).write.mode("overwrite").saveAsTable(f"all_queries.{t}")
    yield warehouse.open_catalog(spark, "all_queries")
    spark.sql("DROP DATABASE all_queries CASCADE")


@pytest.mark.parametrize("name", sorted(n for n, job in QUERIES.items() if job.__module__ != models.__name__))
def test_query_on_a_stored_warehouse(stored, name):
    QUERIES[name](stored).isEmpty()


@pytest.mark.parametrize("name", ["v_transaction_heatmap", "profile_hour", "rev_monthly", "dqv_summary", "seed_dims"])
def test_query_on_a_catalog(in_catalog, name):
    assert not QUERIES[name](in_catalog).isEmpty()


def test_hours_come_from_the_transactions(spark, stored):
    assert {r.hour_of_day for r in views.v_transaction_heatmap(stored).collect()} == {0}  # the adapter's days have no time
    hours = F.col("transaction_date") + F.make_dt_interval(hours=F.col("transaction_id") % 5 + 7)
    timed = replace(stored, fact_transactions=stored.fact_transactions.withColumn("transaction_date", hours))
    got = {r.hour_of_day: r.n for r in views.v_transaction_heatmap(timed).groupBy("hour_of_day").agg(F.sum("transactions").alias("n")).collect()}
    want = {r.h: r.n for r in timed.fact_transactions.groupBy(F.hour("transaction_date").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert got == want and set(got) == {7, 8, 9, 10, 11}
    assert {r.hour for r in derived.profile_hour(timed).collect()} == set(want)


def test_forgetting_a_warehouse_forgets_its_models(spark, monkeypatch):
    key = (spark.sparkContext.applicationId, "no such folder")
    models._fitted[key] = None
    warehouse.forget(spark, "no such folder")
    assert key not in models._fitted
