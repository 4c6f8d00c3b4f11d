"""Every analytics query with SQL against that SQL, on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, (bool, str)):
            return v
        try:
            return round(float(v), 6)
        except TypeError:
            return str(v)[:10]

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def test_every_query_has_sql_or_rests_on_a_model():
    without = set(QUERIES) - set(ORACLE)
    models = {"bv_clusters", "bv_risk_tier_distribution", "bi_portfolio_risk", "bi_segment_scatter"}
    models |= {"act_ticket_routing", "act_high_value_at_risk", "act_segment_conversion"}
    assert all(n.startswith("ml_") or n in models for n in without)
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
