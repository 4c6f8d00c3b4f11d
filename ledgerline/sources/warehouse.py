"""The star schema as a loaded warehouse: derived from the order-processing tables, built from raw files, or opened."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerline import schema
from ledgerline.sources import adapter
from ledgerline.sources.files import exists
from ledgerline.sources.storage import shared_dir


class Later:
    """A value that is made at its first use, once, also where threads ask at the same time; a failure is no value."""

    def __init__(self, make: Callable[[], Any]):
        self.make, self.made, self.value, self.lock = make, False, None, threading.Lock()

    def __call__(self) -> Any:
        with self.lock:
            if not self.made:
                self.value, self.made = self.make(), True
            return self.value


@dataclass(frozen=True)
class Star:
    """The tables of one warehouse and the days that ages count up to. folder: where they are stored, or catalog: the
    database that holds them. A field that is given as Later is made when it is first read."""

    spark: SparkSession
    sf_dir: str
    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_campaign: DataFrame
    fact_transactions: DataFrame
    fact_service_logs: DataFrame
    fact_campaign_responses: DataFrame
    as_of: str = adapter.AS_OF
    events_as_of: str = adapter.EVENTS_AS_OF
    folder: str | None = None
    catalog: str | None = None
    timed_transactions: DataFrame | None = None

    def __getattribute__(self, name: str) -> Any:
        value = super().__getattribute__(name)
        return value() if isinstance(value, Later) else value

    def derive(self, *tables: str) -> None:
        """See that tables are there, those that do not depend on each other at the same time. Customers come last, as
        they cost less where the transactions are there."""
        first = [t for t in tables if t != "dim_customer"]
        with ThreadPoolExecutor(max(1, len(first))) as pool:
            list(pool.map(lambda t: getattr(self, t), first))
        if "dim_customer" in tables:
            self.dim_customer  # noqa: B018

    def timed(self) -> DataFrame:
        """Transactions with a time of day: those of the fact table, where a warehouse has no others for it."""
        return self.fact_transactions if self.timed_transactions is None else self.timed_transactions

    def stored(self) -> set[str]:
        """The tables of the model that the store has now."""
        if self.catalog:
            return {t for t in schema.TABLES if self.spark.catalog.tableExists(f"{self.catalog}.{t}")}
        if self.folder:
            return {t for t in schema.TABLES if exists(self.spark, f"{self.folder}/{t}")}
        return set()


_loaded: dict[tuple[str, str], Star] = {}


def open_warehouse(
    spark: SparkSession, folder: str, as_of: str = adapter.AS_OF, events_as_of: str = adapter.EVENTS_AS_OF
) -> Star:
    """A warehouse that was stored below folder before; a missing table is an error at its first use."""
    tables = {t: spark.read.schema(kind).parquet(f"{folder}/{t}") for t, kind in schema.TABLES.items() if exists(spark, f"{folder}/{t}")}
    missing = sorted(set(schema.TABLES) - set(tables))
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return Star(spark, folder, **tables, as_of=as_of, events_as_of=events_as_of, folder=folder)


def open_catalog(
    spark: SparkSession, database: str, as_of: str = adapter.AS_OF, events_as_of: str = adapter.EVENTS_AS_OF
) -> Star:
    """A warehouse whose tables lie in a database of the session's catalog."""
    missing = [t for t in schema.TABLES if not spark.catalog.tableExists(f"{database}.{t}")]
    if missing:
        raise FileNotFoundError(f"{database} lacks {', '.join(missing)}")
    tables = {t: spark.table(f"{database}.{t}") for t in schema.TABLES}
    return Star(spark, database, **tables, as_of=as_of, events_as_of=events_as_of, catalog=database)


def load(spark: SparkSession, sf_dir: str) -> Star:
    """The warehouse of sf_dir: each table is derived at its first use in an application, written to the shared folder
    and read from there; asking for the folder derives all. forget drops it, after which changed input is seen."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        folder = f"{shared_dir(spark)}/warehouse-{uuid.uuid4().hex}"

        def stored(t: str, rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{t}")
            return spark.read.schema(schema.TABLES[t]).parquet(f"{folder}/{t}")

        def whole() -> str:
            star.derive(*schema.TABLES)
            return folder

        tables = {t: Later(lambda t=t, make=make: stored(t, make(spark, sf_dir))) for t, make in adapter.INDEPENDENT.items()}
        sales = tables["fact_transactions"]

        def customers() -> DataFrame:
            return stored("dim_customer", adapter.dim_customer(spark, sf_dir, sales, sales.made))

        star = Star(
            spark, sf_dir, **tables, dim_customer=Later(customers), folder=Later(whole),
            timed_transactions=adapter.timed_purchases(spark, sf_dir),
        )
        _loaded[key] = star
    return _loaded[key]


#: Called with the key of a warehouse that is forgotten, by what was derived from it.
FORGETTING: list[Callable[[tuple[str, str]], None]] = []


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop the warehouse of sf_dir and what rests on it, models included; the next use derives it again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    _loaded.pop(key, None)
    for drop in FORGETTING:
        drop(key)
