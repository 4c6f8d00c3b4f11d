"""What the models say, as queries, and the checks and analyses that rest on it.

Models are fitted once for a warehouse in an application, or loaded where they were saved; their outputs are written to
the shared folder.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import n, rounded, share_of_total
from ledgerline.functions.ranking import percentiles
from ledgerline.ml import churn, segmentation
from ledgerline.plans.business import row
from ledgerline.plans.campaign import conversion
from ledgerline.plans.registry import query
from ledgerline.plans.value import with_clv
from ledgerline.sources.storage import materialise, shared_dir
from ledgerline.sources.warehouse import FORGETTING, Star

HIGH_CLV = 50_000


class Fitted:
    """The models of one warehouse and what they say. Each part is worked out at its first use and kept, so a query pays
    for no model or table that it does not read."""

    def __init__(self, s: Star, saved: str | None = None):
        self.star, self.saved = s, saved

    @cached_property
    def rows(self) -> DataFrame:
        return materialise(churn.split(churn.features(self.star.dim_customer)), "churn-rows")

    @cached_property
    def churn(self) -> churn.Churn:
        return churn.load(f"{self.saved}/churn") if self.saved else churn.fit(self.rows.where("is_train"))

    @cached_property
    def scored(self) -> DataFrame:
        """With is_train."""
        return materialise(churn.score(self.churn, self.rows, "is_train"), "churn-scored")

    @cached_property
    def drivers(self) -> DataFrame:
        forest = churn.trees(self.churn, f"{shared_dir(self.star.spark)}/churn-forest-{uuid.uuid4().hex}")
        return materialise(churn.drivers(forest, self.scored), "churn-drivers")

    @cached_property
    def behaviour(self) -> DataFrame:
        return materialise(segmentation.features(self.star), "segment-rows")

    @cached_property
    def prepare(self) -> PipelineModel:
        """How segments' features are filled and scaled."""
        return self.segmentation.prepare if self.saved else segmentation.preparation(self.behaviour)

    @cached_property
    def segmentation(self) -> segmentation.Segments:
        if self.saved:
            return segmentation.load(f"{self.saved}/segmentation")
        return segmentation.fit(self.behaviour, self.prepare)

    @cached_property
    def segments(self) -> DataFrame:
        return materialise(segmentation.named(self.segmentation, self.behaviour), "segments")


_fitted: dict[tuple[str, str], Fitted] = {}
FORGETTING.append(lambda key: _fitted.pop(key, None))


def save(s: Star, folder: str) -> None:
    """Save both models of the warehouse below folder."""
    churn.save(fitted(s).churn, f"{folder}/churn")
    segmentation.save(fitted(s).segmentation, f"{folder}/segmentation")


def fitted(s: Star, saved: str | None = None) -> Fitted:
    """The models of s and what they say; saved: the folder to load them from instead of fitting them."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _fitted:
        _fitted[key] = Fitted(s, saved)
    return _fitted[key]


@query
def ml_churn_scale(s: Star) -> DataFrame:
    """Mean and standard deviation that each feature is scaled by."""
    scaler = fitted(s).churn.prepare.stages[-1]
    rows = list(zip(churn.FEATURES, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()))
    return s.spark.createDataFrame(rows, "feature string, mean double, std double")


@query
def ml_churn_fit(s: Star) -> DataFrame:
    """The size of each tree."""
    forest = fitted(s).churn.forest
    rows = [(i, t.numNodes, t.depth) for i, t in enumerate(forest.trees)]
    return s.spark.createDataFrame(rows, "tree int, nodes int, depth int")


@query
def ml_churn_eval(s: Star) -> DataFrame:
    return churn.evaluate(fitted(s).scored.where("not is_train"))


@query
def ml_churn_score(s: Star) -> DataFrame:
    return fitted(s).scored.select("customer_id", rounded(F.col("churn_probability"), 6).alias("churn_probability"), "churn_risk_tier")


@query
def ml_churn_drivers(s: Star) -> DataFrame:
    return fitted(s).drivers.drop("gap")


@query
def ml_churn_importance(s: Star) -> DataFrame:
    return churn.importance(fitted(s).churn).orderBy(F.col("importance").desc()).limit(5)


@query
def ml_seg_impute_scale(s: Star) -> DataFrame:
    """Mean and standard deviation that each feature is scaled by, to four digits."""
    scaler = fitted(s).prepare.stages[-1]
    rows = list(zip(segmentation.FEATURES, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()))
    found = s.spark.createDataFrame(rows, "feature string, mean double, std double")
    return found.select("feature", *(rounded(F.col(c), 4).alias(c) for c in ("mean", "std")))


@query
def ml_seg_pca(s: Star) -> DataFrame:
    rows = list(enumerate(fitted(s).segmentation.pca.explainedVariance.toArray().tolist(), 1))
    return s.spark.createDataFrame(rows, "component int, explained_variance double")


@query
def ml_seg_kmeans(s: Star) -> DataFrame:
    return fitted(s).segments.select("customer_id", "cluster_id")


@query
def ml_seg_name(s: Star) -> DataFrame:
    return fitted(s).segments.groupBy("cluster_id", "behavioral_segment").agg(n().alias("customers"))


@query
def ml_seg_sizes(s: Star) -> DataFrame:
    return segmentation.sizes(fitted(s).segments)


@query
def bv_clusters(s: Star) -> DataFrame:
    """detail: number of clusters, each with customers of its own."""
    found = fitted(s).segments.agg(F.count_distinct("cluster_id").alias("detail"))
    return row(found, "distinguishable_clusters", "segmentation", F.col("detail") > 1, critical=True)


@query
def bv_risk_tier_distribution(s: Star) -> DataFrame:
    return share_of_total(fitted(s).scored.groupBy("churn_risk_tier").agg(n().alias("customers")), "customers", "share_pct")


@query
def bi_portfolio_risk(s: Star) -> DataFrame:
    """By tier: customers, mean probability and the most frequent first driver."""
    d = fitted(s).drivers
    often = Window.partitionBy("churn_risk_tier").orderBy(F.col("n").desc(), "top_risk_driver_1")
    first = d.groupBy("churn_risk_tier", "top_risk_driver_1").agg(n().alias("n")).withColumn("place", F.row_number().over(often))
    tiers = d.groupBy("churn_risk_tier").agg(n().alias("customers"), rounded(F.avg("churn_probability"), 4).alias("avg_probability"))
    return tiers.join(first.where("place = 1").select("churn_risk_tier", F.col("top_risk_driver_1").alias("main_driver")), "churn_risk_tier")


@query
def bi_segment_scatter(s: Star) -> DataFrame:
    return fitted(s).segments.select("customer_id", "pca_x", "pca_y", "behavioral_segment")


@query
def act_ticket_routing(s: Star) -> DataFrame:
    """Open or escalated tickets of customers in the highest tier."""
    high = fitted(s).scored.where(F.col("churn_risk_tier") == churn.TOP_TIER).select("customer_id", "churn_probability")
    tickets = s.fact_service_logs.where("status <> 'Resolved' or escalation_flag")
    return tickets.join(high, "customer_id").select("service_id", "customer_id", "priority", "status", "churn_probability")


@query
def act_high_value_at_risk(s: Star) -> DataFrame:
    """Customers in the top tenth by probability whose lifetime value is over HIGH_CLV."""
    scored = fitted(s).scored.select("customer_id", "churn_probability")
    edge = percentiles(scored, F.col("churn_probability"), {"edge": 0.9})  # one row
    top = scored.crossJoin(F.broadcast(edge)).where(F.col("churn_probability") >= F.col("edge")).drop("edge")
    valued = with_clv(s.dim_customer).where(F.col("estimated_clv") > HIGH_CLV).select("customer_id", "estimated_clv")
    return top.join(valued, "customer_id")


@query
def act_segment_conversion(s: Star) -> DataFrame:
    mine = fitted(s).segments.select("customer_id", "behavioral_segment")
    return s.fact_campaign_responses.join(mine, "customer_id").groupBy("behavioral_segment").agg(n().alias("targeted"), conversion())

