"""Neighbours over several shards against brute force, and vectors of several lengths."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerline.llm import neighbours

SF = "/root/testdata/sf0.01"


def exact(table, k=10):
    table = table[[v is not None and len(v) > 0 and np.isfinite(np.asarray(v, float)).all() and np.any(v) for v in table["embedding"]]]
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:k]
        found[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in best]
    return found


def test_recall_on_embeddings_over_shards(spark):
    want = exact(pd.read_parquet(f"{SF}/embeddings.parquet"))
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for got in (neighbours.op8_collision_counting(spark, SF), neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0, shards=7)):
        rows = got.toPandas()
        assert set(rows["query_id"]) == set(want) and (rows.groupby("query_id")["rank"].max() == 10).all()
        hits = 0
        for r in rows.itertuples():
            near = dict(want[r.query_id])
            hits += r.vec_id in near
            assert r.vec_id not in near or abs(near[r.vec_id] - r.score) < 1e-12
        assert hits >= 0.9 * len(rows)


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(3)] + [(200, [1.0]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, shards=3).toPandas()
    mine = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")}
    assert mine == {0: [1, 2, 3, 4], 100: [101, 102]}


def test_verifies_few_vectors_where_neighbours_stand_out():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((100, 64))
    x = centres[rng.integers(0, 100, 8000)] + 0.15 * rng.standard_normal((8000, 64))
    lines, queries = neighbours.Lines(x), np.arange(0, 8000, 200)
    who, which, _ = lines.nearest(x[queries], 11)
    hits = 0
    for i, q in enumerate(queries):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hits += len(set(np.argsort(d, kind="stable")[:11]) & set(which[who == i]))
    assert hits >= 0.97 * 11 * len(queries) and lines.verified < 0.05 * len(queries) * len(x)
