"""A query derives only the tables that it reads, each once."""

import os
import threading
from dataclasses import replace

import pytest

from ledgerline import catalog, schema
from ledgerline.sources import adapter, warehouse

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.fixture
def folder(tmp_path):
    """The smallest data under a path of its own, so that nothing of it is derived yet."""
    path = str(tmp_path / "tables")
    os.symlink(SF, path)
    return path


@pytest.fixture
def derived(monkeypatch):
    """The names of the tables, as they are derived."""
    found = []

    def noted(t, make):
        return lambda *a: found.append(t) or make(*a)

    monkeypatch.setattr(adapter, "INDEPENDENT", {t: noted(t, make) for t, make in adapter.INDEPENDENT.items()})
    monkeypatch.setattr(adapter, "dim_customer", noted("dim_customer", adapter.dim_customer))
    return found


@pytest.mark.parametrize("name, tables", [
    ("bi_csat_vs_resolution", {"dim_date", "fact_service_logs"}),
    ("bi_roi_by_type", {"dim_campaign", "fact_campaign_responses"}),
    ("txn_high_value", {"fact_transactions"}),
    ("txn_holiday", {"dim_date", "fact_transactions"}),
])
def test_only_what_is_read(spark, folder, derived, name, tables):
    assert not QUERIES[name](spark, folder).isEmpty()
    assert sorted(derived) == sorted(tables)
    assert not QUERIES[name](spark, folder).isEmpty()
    assert len(derived) == len(tables)
    warehouse.forget(spark, folder)


def test_the_folder_has_all(spark, folder, derived):
    s = warehouse.load(spark, folder)
    assert not derived
    assert s.stored() == set(schema.TABLES) and sorted(derived) == sorted(schema.TABLES)
    other = replace(s, dim_customer=s.dim_customer.limit(3))
    assert other.dim_customer.count() == 3 and other.folder == s.folder and len(derived) == len(schema.TABLES)
    warehouse.forget(spark, folder)


def test_later_is_made_once():
    made, calls = warehouse.Later(lambda: calls.append(1) or object()), []
    got = []
    threads = [threading.Thread(target=lambda: got.append(made())) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1 and len(set(map(id, got))) == 1


def test_a_failure_is_tried_again():
    calls = []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError
        return 7

    later = warehouse.Later(make)
    with pytest.raises(ValueError):
        later()
    assert later() == later() == 7 and len(calls) == 2


def test_transactions_come_before_customers(spark, folder, derived):
    """Customers read the stored transactions then, and no order line a second time."""
    assert QUERIES["bv_tables_ready"](spark, folder).count() == 5
    assert derived.index("fact_transactions") < derived.index("dim_customer")
    warehouse.forget(spark, folder)
