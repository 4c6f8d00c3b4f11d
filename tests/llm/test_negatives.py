"""Hard negatives against brute force: ties, copies, odd rows, several shards and lengths, and how much is visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import negatives


def brute(rows, anchors=lambda i: i % 50 == 0):
    good = set()
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e):
            good.add((i, tuple(int(np.floor(256.0 * x)) for x in e), label))
    out = []
    for i, v, label in sorted(good):
        if not anchors(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in good if j != i and len(v) == len(w)]
        same = sorted({(s, j) for s, j, other in scored if other == label}, key=lambda x: (-x[0], x[1]))[:5]
        for p, j in same:
            inside = {(s, m) for s, m, other in scored if other != label and 50 * p <= 100 * s <= 95 * p}
            out += [(i, j, r + 1, m, p, s) for r, (s, m) in enumerate(sorted(inside, key=lambda x: (-x[0], x[1]))[:3])]
    return sorted(out)


def result(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


DDL = "vec_id long, embedding array<double>, label int, id string, v string"


def test_equals_brute_force_with_ties_copies_and_odd_rows(spark, table):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 6) / 8], int(draw.integers(3))) for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(60)] + rows[:60]
    rows += [(2000 + i, [float(x) for x in draw.integers(-3, 4, 5)], int(draw.integers(2))) for i in range(80)]
    rows += [(2050, [0.0] * 6, 1), (2100, None, 1), (None, rows[0][1], 1), (2150, rows[0][1], None), (2200, [float("nan")] * 6, 1), (2250, [None] * 6, 1), (2300, [], 1)]
    rows += [(50, [float(x) for x in draw.integers(-3, 4, 6)], 2), (2350, [float("inf")] * 6, 0)]
    df = table([(*r, "x", "y") for r in rows], DDL)
    want = brute(rows)
    assert len(want) > 100
    for shards, codes in ((1, 16), (5, 4), (None, 1)):
        assert result(negatives.hard_negatives(df, F.col("id") % 50 == 0, shards=shards, codes=codes)) == want
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_large_components(spark, table):
    rows = [(i * 50, [float(1 << 21) + i, 3.0], i % 2) for i in range(4)]
    assert result(negatives.hard_negatives(table([(*r, "", "") for r in rows], DDL), F.lit(True))) == brute(rows, lambda i: True)
    wide = table([(i, [1e300, 1.0], i % 2, "", "") for i in range(4)], DDL)
    with pytest.raises(Exception, match="(?i)too large|overflow|out of range"):
        negatives.hard_negatives(wide, F.lit(True)).collect()


def test_visits_a_part_of_clustered_vectors():
    """Codebooks that fit leave most rows of planted clusters unscored, and the answers stay exact."""
    draw = np.random.default_rng(11)
    centres = draw.standard_normal((40, 32)) * 100
    x = np.floor(centres[draw.integers(0, 40, 8000)] + draw.standard_normal((8000, 32)) * 4)
    books = negatives.fit_half(x[:2000, :16], 16), negatives.fit_half(x[:2000, 16:], 16)
    cell = negatives.nearest_code(x[:, :16], books[0]) * 16 + negatives.nearest_code(x[:, 16:], books[1])
    cells, ids, seen = negatives.Cells(x, cell, books), [[i] for i in range(len(x))], []
    for a in range(0, 8000, 400):
        best, n = negatives.best_positives(cells, ids, x[a], a, 5)
        scores = x @ x[a]
        assert best == [(int(scores[i]), i) for i in np.lexsort((np.arange(8000), -scores)) if i != a][:5]
        seen.append(n / 8000)
    assert np.mean(seen) < 0.3
