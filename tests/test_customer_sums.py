"""Customers' sums from order lines, from stored transactions and by brute force, on tables with odd rows."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.sources import adapter, warehouse

SF = "/root/testdata/sf0.001"
#: Rows that are added to a table, read as t.
ODD = {
    "orders": [
        "SELECT * FROM t LIMIT 40",  # orders that are there twice
        "SELECT * REPLACE (NULL AS o_orderpriority, o_orderkey + 10000000 AS o_orderkey) FROM t LIMIT 300",
        "SELECT * REPLACE (NULL AS o_orderkey) FROM t LIMIT 9",
        "SELECT * REPLACE (NULL AS o_custkey, o_orderkey + 20000000 AS o_orderkey) FROM t LIMIT 9",
    ],
    "lineitem": [
        "SELECT * REPLACE (-1 AS l_partkey) FROM t LIMIT 20",
        "SELECT * REPLACE (NULL AS l_orderkey) FROM t LIMIT 20",
        "SELECT * REPLACE (NULL AS l_extendedprice) FROM t LIMIT 20",
        "SELECT * REPLACE (NULL AS l_shipdate) FROM t LIMIT 20",
        "SELECT * REPLACE (-l_extendedprice AS l_extendedprice, l_orderkey + 10000000 AS l_orderkey) FROM t LIMIT 500",
    ],
    "part": [],
}


@pytest.fixture(scope="module", params=["few", "many"])
def folder(request, tmp_path_factory):
    """many: each part has a category of its own, and priorities are more than are counted side by side."""
    out, con = tmp_path_factory.mktemp(request.param), duckdb.connect()
    kinds = "CASE WHEN p_partkey % 11 > 0 THEN p_type END" if request.param == "few" else "'kind ' || p_partkey"
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{SF}/{name}.parquet'")
        source = " UNION ALL ".join(["SELECT * FROM t", *(f"({x})" for x in ODD.get(name, []))])
        if name == "part":
            source = f"SELECT * REPLACE ({kinds} AS p_type) FROM t"
        if name == "orders" and request.param == "many":
            source = f"SELECT * REPLACE (o_orderpriority || o_orderkey % 9 AS o_orderpriority) FROM ({source})"
        con.execute(f"COPY ({source}) TO '{out}/{name}.parquet'")
    return str(out)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines_say_what_transactions_say(spark, folder):
    s = warehouse.load(spark, folder)
    s.derive("fact_transactions")
    many = folder.endswith("many0")
    found = adapter.sales_of_lines(spark, folder)
    assert (found is None) == many
    if not many:
        mine = lambda df: sorted_rows(df.where("customer_id is not null").select(sorted(df.columns)))
        assert mine(found) == mine(adapter.sales_of_transactions(s.fact_transactions))
    asked = []
    ways = [adapter.dim_customer(spark, folder, lambda: asked.append(1) or s.fact_transactions, there) for there in (False, True)]
    assert sorted_rows(ways[0]) == sorted_rows(ways[1]) and len(asked) == (2 if many else 1)


def test_brute_force(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
    channels, spent = defaultdict(Counter), Counter()
    for o in orders:
        channels[o.o_custkey][o.o_orderpriority] += 1
    first = lambda ct: min(ct, key=lambda c: (-ct[c], c is not None, c or ""))
    of = defaultdict(list)
    for o in orders:
        of[o.o_orderkey].append(o.o_custkey)
    kinds = {p.p_partkey: p.p_type for p in spark.read.parquet(f"{folder}/part.parquet").collect()}
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("cents", (F.col("l_extendedprice").cast("decimal(15,2)") * 100).cast("long"))
    for x in lines.collect():
        if x.l_orderkey is not None and kinds.get(x.l_partkey) is not None:
            for customer in of.get(x.l_orderkey, []):
                spent[customer] += x.cents or 0
    for r in adapter.dim_customer(spark, folder, lambda: warehouse.load(spark, folder).fact_transactions, False).collect():
        assert r.total_trans_amt_12m * 100 == spent[r.customer_id]
        assert r.preferred_channel == (first(channels[r.customer_id]) if r.customer_id in channels else None)


@pytest.mark.parametrize("name", ["risk_category", "cust_by_channel", "dq_range_age", "bv_campaign2_targeting"])
def test_customers_need_no_transactions(spark, folder, monkeypatch, name):
    if folder.endswith("many0"):
        pytest.skip("many categories are counted from transactions")
    warehouse.forget(spark, folder)
    derived = []
    facts = adapter.INDEPENDENT["fact_transactions"]
    monkeypatch.setitem(adapter.INDEPENDENT, "fact_transactions", lambda *a: derived.append(1) or facts(*a))
    assert not catalog.queries()[name](spark, folder).isEmpty() and not derived
