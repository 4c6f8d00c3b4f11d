"""Behavioural segments: seven features, two principal components, four k-means clusters with names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Imputer, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import mean, n, share_of_total
from ledgerline.ml import clusters
from ledgerline.sources.warehouse import Star

FEATURES = (
    "total_trans_amt_12m", "total_trans_ct_12m", "customer_tenure_months", "credit_utilization_ratio",
    "total_products_held", "avg_csat", "campaign_engagements",
)
CLUSTERS, SEED, RESTARTS = 4, 42, 10
DEFAULT_CSAT = 3.0
# Names by rule, in order of the rules, and by cluster where the rules do not tell all apart.
RULES = (
    ("total_trans_amt_12m", 1.5, "1. Elite High-Spenders"), ("credit_utilization_ratio", 1.5, "2. Credit Dependent"),
    ("campaign_engagements", 1.2, "3. Engaged Opportunists"),
)
PASSIVE = ("total_trans_ct_12m", 0.5, "4. Passive / Low Activity")
FALLBACK = ("Elite Spenders", "Digital Engagers", "Credit Dependent", "Passive Customers")


def features(s: Star) -> DataFrame:
    """Facts are summed up by customer first, so that tickets do not multiply engagements."""
    csat = s.fact_service_logs.groupBy("customer_id").agg(mean("csat_score").alias("avg_csat"))
    won = s.fact_campaign_responses.where("was_accepted").groupBy("customer_id").agg(n().alias("campaign_engagements"))
    return (
        s.dim_customer.join(csat, "customer_id", "left").join(won, "customer_id", "left")
        .fillna(DEFAULT_CSAT, ["avg_csat"]).fillna(0, ["campaign_engagements"])
        .select("customer_id", *(F.col(c).cast("double").alias(c) for c in FEATURES))
    )


class Segments(NamedTuple):
    prepare: PipelineModel
    pca: PCAModel
    centres: list[list[float]]


def preparation(rows: DataFrame) -> PipelineModel:
    """Fill, assemble and scale."""
    filled = [f"{c}__filled" for c in FEATURES]
    return Pipeline(stages=[
        Imputer(inputCols=list(FEATURES), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(rows)


def fit(rows: DataFrame, prepare: PipelineModel | None = None) -> Segments:
    """The best of RESTARTS runs of k-means by cost; all runs share each pass over the rows."""
    prepare = prepare or preparation(rows)
    arrays = vector_to_array("features").alias("x")
    ready = prepare.transform(rows).select("customer_id", "features", arrays).persist()
    pca = PCA(k=2, inputCol="features", outputCol="pca").fit(ready)  # features are centred
    centres = clusters.fit(ready, "customer_id", "x", CLUSTERS, RESTARTS, SEED)
    ready.unpersist()
    return Segments(prepare, pca, centres)


def save(model: Segments, folder: str) -> None:
    """Write the fitted stages and centres below folder, in place of what is there."""
    model.prepare.write().overwrite().save(f"{folder}/prepare")
    model.pca.write().overwrite().save(f"{folder}/pca")
    spark = SparkSession.getActiveSession()
    numbered = spark.createDataFrame(list(enumerate(model.centres)), "cluster_id int, centre array<double>")
    numbered.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")


def load(folder: str) -> Segments:
    stored = SparkSession.getActiveSession().read.parquet(f"{folder}/centres").orderBy("cluster_id").collect()
    return Segments(PipelineModel.load(f"{folder}/prepare"), PCAModel.load(f"{folder}/pca"), [r.centre for r in stored])


def assign(model: Segments, rows: DataFrame) -> DataFrame:
    """rows with cluster_id, pca_x and pca_y."""
    found = model.pca.transform(model.prepare.transform(rows))
    found = found.withColumn("cluster_id", clusters.nearest(vector_to_array("features"), model.centres))
    xy = vector_to_array("pca")
    return found.withColumn("pca_x", xy[0]).withColumn("pca_y", xy[1]).select(*rows.columns, "cluster_id", "pca_x", "pca_y")


def cluster_names(assigned: DataFrame) -> DataFrame:
    """(cluster_id, behavioral_segment): each cluster's means against the mean of all clusters' means."""
    means = assigned.groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in FEATURES))  # CLUSTERS rows
    every = Window.partitionBy()
    name = F
    for c, factor, label in RULES:
        name = name.when(F.col(c) > F.avg(c).over(every) * factor, label)
    c, factor, label = PASSIVE
    name = name.when(F.col(c) < F.avg(c).over(every) * factor, label)
    general = F.concat(F.lit("Cluster "), F.col("cluster_id"), F.lit(" (General)"))
    named = means.withColumn("name", name.otherwise(general))
    kinds = F.size(F.collect_set("name").over(every))
    fallback = F.element_at(F.array(*map(F.lit, FALLBACK)), F.col("cluster_id") + 1)
    return named.select("cluster_id", F.when(kinds < F.count("name").over(every), fallback).otherwise(F.col("name")).alias("behavioral_segment"))


def named(model: Segments, rows: DataFrame) -> DataFrame:
    """rows (of features) with cluster_id, pca_x, pca_y, behavioral_segment."""
    assigned = assign(model, rows)
    return assigned.join(F.broadcast(cluster_names(assigned)), "cluster_id")


def segments(s: Star, model: Segments | None = None) -> DataFrame:
    """customer_id, features, cluster_id, pca_x, pca_y, behavioral_segment."""
    rows = features(s)
    return named(model or fit(rows), rows)


def sizes(found: DataFrame) -> DataFrame:
    return share_of_total(found.groupBy("behavioral_segment").agg(n().alias("customers")), "customers", "share_pct")
