"""A step of k-means goes by features: equal to plain arrays, to the last bit, in a part of their memory."""

import tracemalloc

import numpy as np

from ledgerline.ml import clusters


def test_nearest_equals_plain_arrays_in_less_memory():
    draw = np.random.default_rng(9)
    points, centres = draw.standard_normal((50_000, 7)), draw.standard_normal((4, 7))
    centres[3] = centres[1]
    plain = ((points[:, None, :] - centres) ** 2).sum(axis=2)
    turned = np.ascontiguousarray(points.T)
    tracemalloc.start()
    near, least = clusters.nearest_of(turned, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (near == plain.argmin(axis=1)).all() and (least == plain.min(axis=1)).all() and 3 not in near
    assert peak < points.nbytes * len(centres) / 2


def test_a_step_counts_slices_and_empty_partitions(spark):
    points = np.random.default_rng(2).standard_normal((3000, 7))
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "x array<double>").repartition(5).unionByName(spark.createDataFrame([], "x array<double>"))
    centres = points[:8].reshape(2, 4, 7)
    n, sums, cost = clusters._step(rows, "x", centres)
    for run in range(2):
        apart = ((points[:, None, :] - centres[run]) ** 2).sum(axis=2)
        near = apart.argmin(axis=1)
        assert n[run].tolist() == np.bincount(near, minlength=4).tolist()
        np.testing.assert_allclose(cost[run], apart.min(axis=1).sum())
        np.testing.assert_allclose(sums[run], [points[near == j].sum(axis=0) for j in range(4)])
