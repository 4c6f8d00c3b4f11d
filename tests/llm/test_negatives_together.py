"""Anchors that visit cells together: equal to brute force, and a cell is multiplied once for all that come to it in a round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import negatives


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_windows_equal_brute_force_and_share_products(monkeypatch, kind):
    draw = np.random.default_rng(5)
    x = draw.integers(-6, 7, (1500, 8))
    books = negatives.fit_half(x[:, :4].astype(float), 8), negatives.fit_half(x[:, 4:].astype(float), 8)
    cell = negatives.nearest_code(x[:, :4], books[0]) * len(books[1]) + negatives.nearest_code(x[:, 4:], books[1])
    # Some ids are in two rows, some rows have two ids.
    ids = [sorted({i, i // 2}) for i in range(len(x))]
    labels = draw.integers(0, 3, len(x))
    own = np.arange(0, 1500, 5)
    low = draw.integers(-40, 60, (len(own), 3))
    high = low + draw.integers(-5, 40, low.shape)
    offers, calls = negatives._offers, []
    monkeypatch.setattr(negatives, "_offers", lambda *a: calls.append(1) or offers(*a))
    found, seen = negatives.best_in(
        negatives.Cells(x.astype(kind), cell, books), ids, x[own].astype(kind), own, low, high, 3, (labels, labels[own])
    )
    for a, i in enumerate(own):
        scores = x @ x[i]
        for w in range(3):
            inside = {(int(scores[r]), j) for r in range(len(x)) if labels[r] != labels[i] and low[a, w] <= scores[r] <= high[a, w] for j in ids[r] if j != i}
            assert found[a][w] == sorted(inside, key=lambda f: (-f[0], f[1]))[:3]
    # One by one, each query would meet up to 64 cells.
    assert len(calls) < len(own) * len(np.unique(cell)) / 10


def test_own_id_under_another_label_is_no_negative(spark):
    rows = [(50, [1.0, 1.0], 0), (50, [0.75, 0.75], 1), (1, [1.0, 1.0], 0), (2, [0.5, 0.75], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = negatives.hard_negatives(df, F.col("id") == 50).collect()
    assert {(r.positive_id, r.negative_id) for r in found if r.anchor_id == 50 and r.positive_id == 1} == {(1, 2)}
