"""The models on a slice of the warehouse that is quick to fit."""

import itertools
import math

import numpy as np
import pytest

from ledgerline.ml import churn, segmentation
from ledgerline.sources import warehouse

SF = "/root/testdata/sf0.001"


def test_churn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(churn, "TREES", 5)
    s = warehouse.load(spark, SF)
    rows = churn.split(churn.features(s.dim_customer))
    again = churn.split(churn.features(s.dim_customer))
    key = lambda df: sorted(r.customer_id for r in df.where("is_train").collect())
    assert key(rows) == key(again)
    model = churn.fit(rows.where("is_train"))
    scored = churn.score(model, rows).cache()
    assert scored.count() == s.dim_customer.count()
    assert all((0.0 <= r.churn_probability <= 1.0) for r in scored.collect())
    forest = churn.trees(model, f"file://{tmp_path}/forest")
    assert len(forest) == 5
    found = churn.drivers(forest, scored).toPandas()
    assert np.allclose(found["gap"], 0, atol=1e-9)  # contributions add up to the probability
    assert (found["top_risk_driver_1"] != found["top_risk_driver_2"]).all()
    assert churn.evaluate(scored).count() == 2
    assert abs(sum(r.importance for r in churn.importance(model).collect()) - 1) < 1e-6
    model.prepare.write().overwrite().save(f"file://{tmp_path}/prepare")


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.7,), (0.71,)], "p double")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(churn.tier(F.col("p"))).collect()]
    assert got == ["Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk"]


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "RESTARTS", 2)
    found = segmentation.segments(warehouse.load(spark, SF)).toPandas()
    assert found["cluster_id"].nunique() == segmentation.CLUSTERS
    assert found.groupby("cluster_id")["behavioral_segment"].nunique().eq(1).all()
    assert abs(found["pca_x"].mean()) < 1e-6


def test_queries_on_models_equal_recomputation(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(churn, "TREES", 5)
    monkeypatch.setattr(segmentation, "RESTARTS", 1)
    from ledgerline.plans import models
    from ledgerline.plans.value import with_clv

    monkeypatch.setattr(models, "_fitted", {})
    s = warehouse.load(spark, SF)
    f = models.fitted(s)
    scored, segments = f.scored.toPandas(), f.segments.toPandas()
    assert models.bv_clusters(s).collect()[0]["detail"] == segments["cluster_id"].nunique()
    tiers = {r.churn_risk_tier: (r.customers, r.share_pct) for r in models.bv_risk_tier_distribution(s).collect()}
    counts = scored["churn_risk_tier"].value_counts()
    assert {k: v[0] for k, v in tiers.items()} == counts.to_dict() and abs(sum(v[1] for v in tiers.values()) - 100) < 0.1
    drivers = f.drivers.toPandas()
    for r in models.bi_portfolio_risk(s).collect():
        mine = drivers[drivers.churn_risk_tier == r.churn_risk_tier]
        often = mine["top_risk_driver_1"].value_counts()
        assert r.customers == len(mine) and r.main_driver == min(often[often == often.max()].index)
        assert abs(r.avg_probability - mine["churn_probability"].mean()) < 1e-4
    scatter = models.bi_segment_scatter(s).toPandas().set_index("customer_id")
    assert np.allclose(scatter.loc[segments.customer_id, ["pca_x", "pca_y"]], segments[["pca_x", "pca_y"]])
    high = scored.set_index("customer_id")["churn_probability"][lambda p: p > churn.TIERS[1][0]]
    logs = s.fact_service_logs.toPandas()
    open_ = logs[((logs.status != "Resolved") | logs.escalation_flag.fillna(False)) & logs.customer_id.isin(high.index)]
    assert sorted(r.service_id for r in models.act_ticket_routing(s).collect()) == sorted(open_.service_id)
    edge = np.quantile(scored["churn_probability"], 0.9)
    valued = with_clv(s.dim_customer).select("customer_id", "estimated_clv").toPandas().set_index("customer_id")["estimated_clv"]
    want = sorted(c for c, p in zip(scored.customer_id, scored.churn_probability) if p >= edge - 1e-12 and valued[c] is not None and valued[c] > models.HIGH_CLV)
    assert sorted(r.customer_id for r in models.act_high_value_at_risk(s).collect()) == want
    answers = s.fact_campaign_responses.toPandas().merge(segments[["customer_id", "behavioral_segment"]], on="customer_id")
    assert {r.behavioral_segment: r.targeted for r in models.act_segment_conversion(s).collect()} == answers.groupby("behavioral_segment").size().to_dict()
    raw = churn.features(s.dim_customer).join(f.scored.select("customer_id", "is_train"), "customer_id").where("is_train").toPandas()
    for r in models.ml_churn_scale(s).collect():
        x = raw[r.feature].fillna(raw[r.feature].mean())
        assert np.isclose(r["mean"], x.mean()) and np.isclose(r["std"], x.std(ddof=1))
    models.save(s, f"file://{tmp_path}/models")
    before = {r.customer_id: r.churn_probability for r in models.ml_churn_score(s).collect()}
    monkeypatch.setattr(models, "_fitted", {})
    loaded = models.fitted(s, f"file://{tmp_path}/models")
    assert {r.customer_id: r.churn_probability for r in models.ml_churn_score(s).collect()} == before
    assert loaded.segments.select("customer_id", "cluster_id").exceptAll(f.segments.select("customer_id", "cluster_id")).isEmpty()


def random_tree(draw, features, depth):
    """A tree with splits that may ask a feature again, as arrays."""
    feature, threshold, left, right, value, cover = [], [], [], [], [], []

    def grow(level, weight):
        at = len(feature)
        for part in (feature, threshold, left, right, value, cover):
            part.append(-1)
        cover[at] = weight
        if level == depth or (level and draw.random() < 0.2):
            value[at] = draw.random()
        else:
            feature[at], threshold[at] = int(draw.integers(features)), draw.random()
            share = draw.uniform(0.1, 0.9)
            left[at], right[at] = grow(level + 1, weight * share), grow(level + 1, weight * (1 - share))
            value[at] = share * value[left[at]] + (1 - share) * value[right[at]]
        return at

    grow(0, 100.0)
    return churn.Tree(*map(np.array, (feature, threshold, left, right, value, cover)))


def expected(t, row, known, node=0):
    """The tree's value where only known features are looked at."""
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    if f in known:
        return expected(t, row, known, t.left[node] if row[f] <= t.threshold[node] else t.right[node])
    return sum(expected(t, row, known, c) * t.cover[c] / t.cover[node] for c in (t.left[node], t.right[node]))


@pytest.mark.parametrize("features, depth", [(1, 3), (3, 5), (5, 4), (6, 7)])
def test_attributions_equal_enumeration_over_all_subsets(features, depth):
    draw = np.random.default_rng(features)
    forest = [random_tree(draw, features, depth) for _ in range(4)]
    x = draw.random((12, features))
    got, base = churn.attributions(forest, x)
    for r, row in enumerate(x):
        worth = {s: np.mean([expected(t, row, s) for t in forest]) for k in range(features + 1) for s in itertools.combinations(range(features), k)}
        for f in range(features):
            want = sum(
                math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features) * (worth[tuple(sorted((*s, f)))] - v)
                for s, v in worth.items() if f not in s
            )
            assert abs(got[r, f] - want) < 1e-12
        assert abs(base + got[r].sum() - worth[tuple(range(features))]) < 1e-12 and abs(base - worth[()]) < 1e-12


def test_both_features_of_a_conjunction_count_alike():
    tree = churn.Tree(*map(np.array, ([0, -1, 1, -1, -1], [0.5, 0, 0.5, 0, 0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.25, 0, 0.5, 0, 1], [4.0, 2, 2, 1, 1])))
    got, base = churn.attributions([tree], np.array([[1.0, 1.0], [0.0, 1.0]]))
    assert base == 0.25 and np.allclose(got, [[0.375, 0.375], [-0.375, 0.125]])


def test_evaluation_equals_recomputation(spark):
    draw = np.random.default_rng(2)
    target, p = draw.integers(0, 2, 300), np.round(draw.random(300), 2)
    p = np.clip(np.round(p + 0.2 * target, 2), 0, 1)
    rows = [(int(t), float(q), float(q > 0.5)) for t, q in zip(target, p)]
    scored = spark.createDataFrame(rows, "target int, rawPrediction double, prediction double")
    got = {r["class"]: r for r in churn.evaluate(scored).collect()}
    pairs = [(a > b) + 0.5 * (a == b) for a in p[target == 1] for b in p[target == 0]]
    for k in (0, 1):
        hit = ((p > 0.5) == k) & (target == k)
        precision, recall = hit.sum() / ((p > 0.5) == k).sum(), hit.sum() / (target == k).sum()
        assert abs(got[k].precision - precision) < 1e-4 and abs(got[k].recall - recall) < 1e-4
        assert abs(got[k].f1 - 2 * precision * recall / (precision + recall)) < 1e-4
        assert got[k].support == (target == k).sum() and abs(got[k].auc - np.mean(pairs)) < 1e-4


def test_components_equal_recomputation(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "RESTARTS", 1)
    s = warehouse.load(spark, SF)
    model = segmentation.fit(segmentation.features(s))
    raw = segmentation.features(s).select(*segmentation.FEATURES).toPandas().astype(float)
    raw = raw.fillna(raw.mean())
    scaled = ((raw - raw.mean()) / raw.std(ddof=1)).to_numpy()
    variances, axes = np.linalg.eigh(np.cov(scaled.T))
    want = variances[::-1][:2] / variances.sum()
    assert np.allclose(model.pca.explainedVariance.toArray(), want, atol=1e-6)
    found = segmentation.segments(s, model).orderBy("customer_id").toPandas()
    order = np.argsort(segmentation.features(s).select("customer_id").toPandas()["customer_id"].to_numpy())
    for k, name in enumerate(("pca_x", "pca_y")):
        mine = (scaled @ axes[:, -1 - k])[order]
        assert min(np.abs(found[name] - mine).max(), np.abs(found[name] + mine).max()) < 1e-3
