"""Customers who never ordered: no tenure, no card score, no first month. The tables are the smallest data and one more row."""

import os

import duckdb
import pytest

from tests.test_oracle import ORACLE, QUERIES, SF, rows

NAMES = (
    "bi_customer_overview", "campaign_audience", "card_tier", "clv_historical", "cust_churn_by_card", "cust_monthly_acquisition",
    "dq_dist_card", "products_held", "v_customer_360", "svc_by_tier_category",
)
NEWCOMER = 10_000_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The tables with a customer of a high income who has a ticket and no order."""
    out = tmp_path_factory.mktemp("newcomer")
    con = duckdb.connect()
    more = {
        "customer": f"SELECT * REPLACE ({NEWCOMER} AS c_custkey, 'BUILDING' AS c_mktsegment) FROM t LIMIT 1",
        "events": f"SELECT * REPLACE ({NEWCOMER} AS event_id, {NEWCOMER} AS user_id) FROM t WHERE event_type = 'error' LIMIT 1",
    }
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{SF}/{name}.parquet'")
        source = f"SELECT * FROM t UNION ALL ({more[name]})" if name in more else "SELECT * FROM t"
        con.execute(f"COPY ({source}) TO '{out}/{name}.parquet'")
    return str(out)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, folder, duck, name):
    ours, theirs = QUERIES[name](spark, folder).toPandas(), duck.execute(ORACLE[name]).df()
    assert rows(ours) == rows(theirs)


def test_no_score_is_blue_and_no_month_comes_last(spark, folder):
    tier = QUERIES["card_tier"](spark, folder).where(f"customer_id = {NEWCOMER}").first()
    assert (tier.score, tier.card_category) == (None, "Blue")
    months = QUERIES["cust_monthly_acquisition"](spark, folder).toPandas()
    first, undated = months.sort_values("month").iloc[0], months[months["month"].isna()].iloc[0]
    assert first.isna()["previous"] and first["cumulative"] == first["new_customers"]
    assert undated["cumulative"] == months["new_customers"].sum()
