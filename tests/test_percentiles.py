"""Exact percentiles by brackets against sorted lists, where brackets are narrow, wide, tied or many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import ranking

SHARES = {"least": 0.0, "low": 0.0001, "q": 0.25, "mid": 0.5, "high": 0.9, "most": 1.0}


def percentile(values, share):
    place = (len(values) - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


@pytest.mark.parametrize("accuracy", [20, 500])
@pytest.mark.parametrize("groups", [10_000, 1])
def test_equals_sorted_lists(spark, monkeypatch, accuracy, groups):
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    monkeypatch.setattr(ranking, "GROUPS", groups)
    draw = random.Random(accuracy)
    kinds = {
        "spread": lambda: draw.gauss(0, 1e6), "tied": lambda: float(draw.choice([1, 1, 1, 2, 3])), "one": lambda: 4.0,
        "ends": lambda: draw.choice([-math.inf, 0.5, math.inf]) if draw.random() < 0.01 else 0.5, None: lambda: draw.random() ** 9,
    }
    rows = [(g, value()) for g, value in kinds.items() for _ in range(3000)] + [("none", None)] * 3 + [("few", 2.0), ("few", 1.0), ("few", math.nan), ("few", None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.asDict() for r in ranking.percentiles(df, F.col("v"), SHARES, "g").collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for x, v in rows if x == g and v is not None and not math.isnan(v))
        for name, share in SHARES.items():
            assert got[g][name] == (percentile(values, share) if values else None), (g, name)
    assert len(got) == 7
    whole = ranking.percentiles(df.where("g <> 'ends'"), F.col("v"), SHARES).collect()
    values = sorted(v for g, v in rows if g not in ("ends", None) and v is not None and not math.isnan(v))
    assert [r.asDict() for r in whole] == [{name: percentile(values, share) for name, share in SHARES.items()}]


def test_a_sketch_that_misses_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ACCURACY", 10)
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda value, shares, accuracy: F.array(*[F.lit(-1.0)] * 2))
    with pytest.raises(Exception, match="sketch"):
        ranking.percentiles(spark.range(100).select(F.col("id").cast("double").alias("v")), F.col("v"), {"m": 0.5}).collect()


def test_nothing_is_written(spark, monkeypatch):
    monkeypatch.setattr(ranking, "materialise", lambda *a: 1 / 0)
    df = spark.createDataFrame([], "g string, v double")
    assert ranking.percentiles(df, F.col("v"), {"m": 0.5}, "g").collect() == []
    assert ranking.percentiles(df, F.col("v"), {"m": 0.5}).first().m is None
