"""Where the analytics jobs are listed by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerline.sources.warehouse import Star

QUERIES: dict[str, Callable[[Star], DataFrame]] = {}


def query(job: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[job.__name__] = job
    return job
