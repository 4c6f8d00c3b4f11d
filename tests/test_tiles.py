"""Tiles by their edges against ROW_NUMBER arithmetic: ties, nulls, few rows, and values that a sketch cannot tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import tiles


def ntile(rows, k):
    """rows in order to tiles."""
    small, more = divmod(len(rows), k)
    sizes = [small + (j < more) for j in range(k)]
    return dict(zip(rows, [j + 1 for j, size in enumerate(sizes) for _ in range(size)]))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 200, 3001])
def test_equals_a_sort(spark, n):
    draw = random.Random(n)
    rows = [(i * 7 - n, draw.choice([None, *range(6)]), draw.random(), f"{draw.randint(0, 40) / 4:.2f}", 5) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, few int, many double, money string, one int").withColumn("money", F.col("money").cast("decimal(15,2)"))
    columns = {"few_t": F.col("few"), "many_t": -F.col("many"), "money_t": F.col("money"), "one_t": F.col("one")}
    got = {r.id: r for r in tiles.with_tiles(df.repartition(5), columns, "id", 5).collect()}
    assert len(got) == n
    low = lambda x: -1 if x is None else x
    for name, value in (("few_t", lambda r: low(r.few)), ("many_t", lambda r: -r.many), ("money_t", lambda r: r.money), ("one_t", lambda r: 1)):
        want = ntile([i for _, i in sorted((value(r), i) for i, r in got.items())], 5)
        assert {i: r[name] for i, r in got.items()} == want, name


def test_large_ties_and_close_values(spark):
    rows = spark.range(40_000).select(
        "id", F.when(F.col("id") % 10 == 0, F.lit("12345678901234567890.01").cast("decimal(24,2)") + F.col("id") / 100).otherwise(F.lit("12345678901234567890.00").cast("decimal(24,2)")).cast("decimal(24,2)").alias("v")
    )
    got = tiles.with_tiles(rows, {"t": F.col("v")}, "id", 4).toPandas()
    want = ntile([i for _, i in sorted(zip(got["v"], got["id"]))], 4)
    assert dict(zip(got["id"], got["t"])) == want


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    monkeypatch.setattr(tiles.F, "percentile_approx", lambda value, shares, accuracy: F.array(F.lit(3.0), F.lit(4.0)))
    got = tiles.with_tiles(spark.range(100), {"t": F.col("id")}, "id", 4).toPandas()
    assert dict(zip(got["id"], got["t"])) == ntile(list(range(100)), 4)


def test_nothing_is_written_for_quartiles(spark, monkeypatch):
    from ledgerline.functions import ranking
    from ledgerline.plans import transaction
    from ledgerline.sources import warehouse

    s = warehouse.load(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(ranking, "materialise", lambda *a: 1 / 0)
    assert transaction.txn_quartiles(s).count() == 4
