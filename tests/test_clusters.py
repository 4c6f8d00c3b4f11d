"""K-means with all restarts together: against Lloyd's steps on plain arrays, Spark's own k-means, and odd rows."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerline.ml import clusters


def cost_of(points, centres):
    return ((points[:, None, :] - np.array(centres)) ** 2).sum(axis=2).min(axis=1).sum()


def frame(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>").repartition(6)


@pytest.fixture(scope="module")
def blobs():
    draw = np.random.default_rng(5)
    return np.concatenate([draw.normal(c, 0.7, (150, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 0], [3, 3, 6])])


def test_best_cost_of_all_runs(spark, blobs):
    df = frame(spark, blobs)
    got = clusters.fit(df, "id", "x", 4, 5, 42)
    order = [r.x for r in df.orderBy(F.xxhash64("id", "x"), "x").collect()]
    costs = []
    for centres in clusters.first_centres(np.array(order), 4, 5, 42):
        while True:
            near = ((blobs[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([blobs[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(4)])
            if np.abs(moved - centres).max() < 1e-12:
                break
            centres = moved
        costs.append(cost_of(blobs, centres))
    assert cost_of(blobs, got) == pytest.approx(min(costs), rel=1e-6)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.select(*(F.col("x")[i].alias(c) for i, c in enumerate("abc"))))
    theirs = min(KMeans(k=4, seed=s, tol=1e-9, maxIter=100).fit(vectors).summary.trainingCost for s in range(3))
    assert cost_of(blobs, got) <= theirs * (1 + 1e-6)
    near = {r.id: r.c for r in df.select("id", clusters.nearest(F.col("x"), got).alias("c")).collect()}
    want = ((blobs[:, None, :] - np.array(got)) ** 2).sum(axis=2).argmin(axis=1)
    assert [near[i] for i in range(len(blobs))] == want.tolist()


def test_a_step_is_one_pass_for_all_runs(spark, blobs, monkeypatch):
    passes = []
    step = clusters._step
    monkeypatch.setattr(clusters, "_step", lambda rows, x, centres: passes.append(len(centres)) or step(rows, x, centres))
    clusters.fit(frame(spark, blobs), "id", "x", 4, 7, 1)
    assert set(passes) == {7} and len(passes) < 40


def test_few_equal_and_no_rows(spark):
    same = clusters.fit(frame(spark, [[1.0, 2.0]] * 9), "id", "x", 4, 3, 42)
    assert same == [[1.0, 2.0]] * 4
    two = clusters.fit(frame(spark, [[0.0], [0.0], [8.0]]), "id", "x", 4, 3, 42)
    assert {v for c in two for v in c} == {0.0, 8.0}
    with pytest.raises(ValueError, match="no rows"):
        clusters.fit(frame(spark, [[1.0]]).limit(0), "id", "x", 4, 3, 42)
