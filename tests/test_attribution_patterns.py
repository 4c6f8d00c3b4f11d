"""Rows that a leaf treats alike are found by marking patterns, not by sorting rows."""

import numpy as np

from ledgerline.ml import churn


def test_patterns_and_the_place_of_each_rows():
    one, two = np.array([True, False, True, True]), np.array([True, False, False, True])
    patterns, own = churn.distinct_patterns([one, two])
    assert patterns.tolist() == [0, 1, 3] and patterns[own].tolist() == [3, 0, 1, 3]


def test_rows_are_not_sorted(monkeypatch):
    draw = np.random.default_rng(3)
    tree = churn.Tree(
        np.array([0, 1, -1, -1, 0, -1, -1]), np.array([0.0, 0.3, 0, 0, 1.0, 0, 0]), np.array([1, 2, -1, -1, 5, -1, -1]),
        np.array([4, 3, -1, -1, 6, -1, -1]), np.array([0.56, 0.5, 0.1, 0.9, 0.65, 0.8, 0.2]), np.array([10.0, 6.0, 3.0, 3.0, 4.0, 3.0, 1.0]),
    )
    x = draw.normal(size=(50, 2))

    def fail(*_, **__):
        raise AssertionError("a sort")

    monkeypatch.setattr(np, "unique", fail)
    values, base = churn.attributions([tree], x)
    leaf = np.where(x[:, 0] <= 0, np.where(x[:, 1] <= 0.3, 0.1, 0.9), np.where(x[:, 0] <= 1, 0.8, 0.2))
    assert values.shape == x.shape and np.abs(values.sum(axis=1) + base - leaf).max() < 1e-12
