"""K-means whose restarts all run together: a step reads the rows once, however many restarts there are.

Each task sums up its rows for every cluster of every run and gives back one row for each; the driver sees restarts x
clusters rows a step. Only the first centres come from a bounded sample, all steps and costs from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First centres are drawn from so many rows, those with the smallest hashes of key and features.
SAMPLE = 4096
STEPS, STILL = 100, 1e-9


def first_centres(sample: np.ndarray, k: int, restarts: int, seed: int) -> np.ndarray:
    """restarts x k x features: each run's centres, drawn one after another in proportion to the squared distance from
    the nearest one before. Where fewer rows differ than there are clusters, some centres are equal."""
    runs = []
    for run in range(restarts):
        draw = np.random.default_rng(seed + run)
        centres = [sample[draw.integers(len(sample))]]
        while len(centres) < k:
            far = np.min([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
            share = far / far.sum() if far.sum() > 0 else None
            centres.append(sample[draw.choice(len(sample), p=share)])
        runs.append(centres)
    return np.array(runs)


def nearest_of(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points (features x points) the number of the nearest centre, the first of several, and its squared distance: by
    features, so that no array holds points x centres x features."""
    apart = np.zeros((len(centres), points.shape[1]))
    for c, centre in enumerate(centres):
        for x, at in zip(points, centre):
            gap = x - at
            gap *= gap
            apart[c] += gap
    near = apart.argmin(axis=0)
    return near, apart[near, np.arange(len(near))]


def _step(rows: DataFrame, x: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rows, sums of features by run and cluster, and each run's cost, for the nearest of the centres."""
    restarts, k, width = centres.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, sums = np.zeros((restarts, k)), np.zeros((restarts, k)), np.zeros(centres.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.ascontiguousarray(batch.column(0).flatten().to_numpy().reshape(-1, width).T)
            for run in range(restarts):
                near, least = nearest_of(points, centres[run])
                n[run] += np.bincount(near, minlength=k)
                cost[run] += np.bincount(near, weights=least, minlength=k)
                for j in range(width):
                    sums[run, :, j] += np.bincount(near, weights=points[j], minlength=k)
        yield pa.RecordBatch.from_pydict({
            "run": np.repeat(np.arange(restarts), k), "cluster": np.tile(np.arange(k), restarts), "n": n.ravel(), "cost": cost.ravel(),
            **{f"s{j}": sums[:, :, j].ravel() for j in range(width)},
        })

    numbers = ["n", "cost", *(f"s{j}" for j in range(width))]
    schema = ", ".join(["run long", "cluster long", *(f"{c} double" for c in numbers)])
    found = rows.select(x).mapInArrow(partial, schema).groupBy("run", "cluster").agg(*(F.sum(c).alias(c) for c in numbers))
    n, cost, sums = np.zeros((restarts, k)), np.zeros(restarts), np.zeros(centres.shape)
    for r in found.collect():
        n[r.run, r.cluster] = r.n
        cost[r.run] += r.cost
        sums[r.run, r.cluster] = r[4:]
    return n, sums, cost


def fit(rows: DataFrame, key: str, x: str, k: int, restarts: int, seed: int) -> list[list[float]]:
    """The k centres of the run with the smallest cost. x: arrays of doubles without nulls; a centre that no row is near stays.
    No row is an error."""
    drawn = rows.select(x).orderBy(F.xxhash64(key, x), x).limit(SAMPLE).collect()
    if not drawn:
        raise ValueError("no rows to find clusters in")
    centres = first_centres(np.array([r[0] for r in drawn]), k, restarts, seed)
    for _ in range(STEPS):
        n, sums, cost = _step(rows, x, centres)
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
        if np.abs(moved - centres).max() <= STILL:
            break
        centres = moved
    else:
        cost = _step(rows, x, centres)[2]
    return centres[cost.argmin()].tolist()


def nearest(x: Column, centres: list[list[float]]) -> Column:
    """The number, from 0, of the nearest centre; the first of several."""

    def apart(centre: list[float]) -> Column:
        squares = F.zip_with(x, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda total, one: total + one)

    return F.array_min(F.array(*(F.struct(apart(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]
