"""All analytics queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.columns import longs
from ledgerline.oracle.star import sql
from ledgerline.plans.registry import QUERIES
from ledgerline.sources import warehouse

PLANS = ("customer", "revenue", "transaction", "service", "campaign", "value", "views", "quality", "business", "derived", "models")
ORACLES = ("kpi", "checks", "derived")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for name in PLANS:
        import_module(f"ledgerline.plans.{name}")

    def bound(job: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: longs(job(warehouse.load(spark, sf_dir)))

    return {name: bound(job) for name, job in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in ORACLES:
        for key, body in import_module(f"ledgerline.oracle.{name}").BODIES.items():
            found[key] = sql(*body) if isinstance(body, tuple) else sql(body)
    return found
