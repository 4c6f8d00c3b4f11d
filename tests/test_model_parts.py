"""Queries on models work out only what they read; customers whom no tree tells apart share one calculation."""

import numpy as np
import pytest

from ledgerline.ml import churn, segmentation
from ledgerline.plans import models
from ledgerline.sources import warehouse

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(spark, monkeypatch):
    monkeypatch.setattr(models, "_fitted", {})
    return warehouse.load(spark, SF)


def fail(*_):
    raise AssertionError("not needed")


def test_segments_need_no_forest(fresh, monkeypatch):
    monkeypatch.setattr(churn, "fit", fail)
    assert models.bv_clusters(fresh).count() == 1


def test_scales_need_no_clusters_and_scores_no_drivers(fresh, monkeypatch):
    monkeypatch.setattr(segmentation, "fit", fail)
    monkeypatch.setattr(churn, "drivers", fail)
    assert models.ml_seg_impute_scale(fresh).count() == len(segmentation.FEATURES)
    assert models.ml_churn_eval(fresh).count() == 2


def test_equal_bins_equal_values():
    tree = churn.Tree(
        np.array([0, 1, -1, -1, -1]), np.array([1.0, 2.0, 0, 0, 0]), np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]),
        np.array([0.5, 0.4, 0.1, 0.9, 0.8]), np.array([10.0, 6.0, 3.0, 3.0, 4.0]),
    )
    x = np.array([[1.0, 2.0], [0.5, -7.0], [1.1, 2.0], [9.0, 1.0], [1.0, 2.1]])
    found, values = churn.bins([tree], x), churn.attributions([tree], x)[0]
    assert found.tolist() == [[0, 0], [0, 0], [1, 0], [1, 0], [0, 1]]
    assert (values[0] == values[1]).all() and (values[2] == values[3]).all() and (values[0] != values[4]).any()
