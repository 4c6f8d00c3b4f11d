"""Churn: random forest, scores and tiers for every customer, and what drives each score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import n, ratio, rounded
from ledgerline.functions.ranking import with_position

FEATURES = (
    "age", "customer_tenure_months", "total_products_held", "credit_utilization_ratio", "months_inactive_12m",
    "contacts_count_12m", "total_trans_amt_12m", "total_trans_ct_12m", "amt_change_q4_q1", "ct_change_q4_q1",
)
TREES, DEPTH, SEED = 100, 10, 42
TRAIN_SHARE = 0.8
#: Upper ends of the tiers; 0 is Low.
TIERS = ((0.3, "Low Risk"), (0.7, "Medium Risk"))
TOP_TIER = "High Risk"
DRIVERS = 3
#: Rows whose attributions are worked out at once.
ATTRIBUTION_ROWS = 8192


def features(customers: DataFrame) -> DataFrame:
    """customer_id, the ten features as doubles and the target, 1 for churned."""
    return customers.select(
        "customer_id", *(F.col(c).cast("double").alias(c) for c in FEATURES),
        (F.col("customer_status") == "Churned").cast("int").alias("target"),
    )


def split(rows: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """rows with is_train: in each class the share with the smallest hashes, the same rows in every run."""
    placed = with_position(
        rows.withColumn("__hash", F.xxhash64("customer_id")), [F.col("target"), F.col("__hash"), F.col("customer_id")], "__order"
    )
    sizes = placed.groupBy("target").agg(n().alias("__n"), F.min("__order").alias("__first"))  # two rows
    inside = F.col("__order") - F.col("__first") < F.floor(F.col("__n") * share)
    return placed.join(F.broadcast(sizes), "target").withColumn("is_train", inside).drop("__hash", "__order", "__n", "__first")


class Churn(NamedTuple):
    """Fitted stages: preparation (impute, assemble, scale) and the forest."""

    prepare: PipelineModel
    forest: RandomForestClassificationModel


def fit(train: DataFrame) -> Churn:
    """Class weights are n / (2 n_class), so both classes weigh the same."""
    filled = [f"{c}__filled" for c in FEATURES]
    prepare = Pipeline(stages=[
        Imputer(inputCols=list(FEATURES), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(train)
    sizes = train.groupBy("target").agg(n().alias("n"))
    total = train.agg(n().alias("total"))
    weights = sizes.crossJoin(total).select("target", (F.col("total") / (2.0 * F.col("n"))).alias("weight"))  # two rows
    weighted = prepare.transform(train).join(F.broadcast(weights), "target")
    forest = RandomForestClassifier(
        labelCol="target", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    ).fit(weighted)
    return Churn(prepare, forest)


def save(model: Churn, folder: str) -> None:
    """Write the fitted stages below folder, in place of what is there."""
    model.prepare.write().overwrite().save(f"{folder}/prepare")
    model.forest.write().overwrite().save(f"{folder}/forest")


def load(folder: str) -> Churn:
    return Churn(PipelineModel.load(f"{folder}/prepare"), RandomForestClassificationModel.load(f"{folder}/forest"))


def tier(p: F.Column) -> F.Column:
    out = F
    for edge, label in TIERS:
        out = out.when(p <= edge, F.lit(label))
    return out.otherwise(F.lit(TOP_TIER))


def score(model: Churn, rows: DataFrame, *more: str) -> DataFrame:
    """customer_id, target, features (vector), churn_probability, churn_risk_tier, and more columns of rows."""
    p = vector_to_array("probability")[1]
    return (
        model.forest.transform(model.prepare.transform(rows))
        .withColumn("churn_probability", p)
        .withColumn("churn_risk_tier", tier(F.col("churn_probability")))
        .select("customer_id", "target", "features", "probability", "rawPrediction", "prediction", "churn_probability", "churn_risk_tier", *more)
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """class, precision, recall, f1 and support, and the area under the curve on each row."""
    auc = BinaryClassificationEvaluator(labelCol="target").evaluate(scored)
    spark = scored.sparkSession
    classes = spark.createDataFrame([(0,), (1,)], "class int")  # both classes, whatever is predicted
    hits = scored.groupBy("target", F.col("prediction").cast("int").alias("predicted")).agg(n().alias("n"))
    of = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0))
    both = classes.crossJoin(F.broadcast(hits)).groupBy("class").agg(  # at most 2 x 4 rows
        of((F.col("target") == F.col("class")) & (F.col("predicted") == F.col("class"))).alias("tp"),
        of(F.col("predicted") == F.col("class")).alias("positive"),
        of(F.col("target") == F.col("class")).alias("support"),
    )
    precision, recall = ratio(F.col("tp"), F.col("positive")), ratio(F.col("tp"), F.col("support"))
    return both.select(
        "class", rounded(precision, 4).alias("precision"), rounded(recall, 4).alias("recall"),
        rounded(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), 4).alias("f1"), "support",
        F.lit(round(auc, 4)).alias("auc"),
    )


class Tree(NamedTuple):
    """A tree as arrays: feature (-1 in a leaf), threshold (left if not above), children, class 1 share, weight."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


def trees(model: Churn, folder: str) -> list[Tree]:
    """The forest's trees from its saved node table; a forest is small whatever it was fitted on."""
    spark = SparkSession.getActiveSession()
    model.forest.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()
    out = []
    for _, t in nodes.groupby("treeID"):
        stats = np.stack(t["impurityStats"].map(np.asarray))
        split_ = t["split"]
        leaf = (t["leftChild"] < 0).to_numpy()
        threshold = np.array([s["leftCategoriesOrThreshold"][0] if not is_leaf else 0.0 for s, is_leaf in zip(split_, leaf)])
        feature = np.array([s["featureIndex"] if not is_leaf else -1 for s, is_leaf in zip(split_, leaf)])
        cover = stats.sum(axis=1)
        out.append(Tree(feature, threshold, t["leftChild"].to_numpy(), t["rightChild"].to_numpy(), stats[:, 1] / cover, cover))
    return out


def path_shapley(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley values of the features on the way to a leaf of value 1, for patterns of rows.

    one (patterns x features): 1 where the row's own value leads to the leaf at all splits on the feature. zero: the share
    of the fitted weight that goes to the leaf there. A set S of known features has the worth of the product of one over
    S and zero over the others. The polynomial of zero + one * y over all features counts these products by the size of
    S; dividing a feature out leaves those of the sets without it, which are weighed by k! (d - 1 - k)! / d!.
    """
    d = len(zero)
    sizes = np.zeros((len(one), d + 1))
    sizes[:, 0] = 1.0
    for j in range(d):
        sizes[:, 1 : j + 2] = sizes[:, 1 : j + 2] * zero[j] + sizes[:, : j + 1] * one[:, j : j + 1]
        sizes[:, 0] *= zero[j]
    weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
    known = one > 0
    quotient, total = np.zeros(one.shape), np.zeros(one.shape)
    for k in range(d - 1, -1, -1):
        quotient = np.where(known, sizes[:, k + 1 : k + 2] - zero * quotient, sizes[:, k : k + 1] / zero)
        total += weight[k] * quotient
    return (one - zero) * total


def distinct_patterns(decisions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The patterns (decision k as bit k) that rows have, in order, and for each row the place of its own: marked in a table
    of all 2 ** len(decisions), which are few as a path has few features, so rows are not sorted."""
    code = np.zeros(len(decisions[0]), np.int64)
    for k, one in enumerate(decisions):
        code |= one.astype(np.int64) << k
    there = np.zeros(1 << len(decisions), bool)
    there[code] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[code]


def attributions(forest: list[Tree], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features Shapley values, base): the values and base add up to the probability.

    A feature that is not known goes both ways, by the weights the tree was fitted with. Each tree is walked once for
    all rows of x, with the rows' own decisions beside; rows that a leaf treats alike share one calculation.
    """
    columns = np.ascontiguousarray(x.T)  # a feature's values beside each other, as those of out
    out, base = np.zeros(columns.shape), 0.0
    for t in forest:
        base += t.value[0]
        todo: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(t.feature[node])
            if f < 0:
                if path and t.value[node]:
                    patterns, own = distinct_patterns([one for one, _ in path.values()])
                    one = (patterns[:, None] >> np.arange(len(path)) & 1).astype(float)
                    values = t.value[node] * path_shapley(one, np.array([zero for _, zero in path.values()]))
                    for f, value in zip(path, values.T):
                        out[f] += np.ascontiguousarray(value)[own]
                continue
            goes_left = columns[f] <= t.threshold[node]
            before, share = path.get(f, (True, 1.0))
            for child, goes in ((t.left[node], goes_left), (t.right[node], ~goes_left)):
                todo.append((child, path | {f: (goes & before, share * t.cover[child] / t.cover[node])}))
    return out.T / len(forest), base / len(forest)


def thresholds(forest: list[Tree], f: int) -> np.ndarray:
    """All values that a feature is compared with."""
    return np.unique(np.concatenate([t.threshold[t.feature == f] for t in forest]))


def bins(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """For each row and feature the number of thresholds below the value: rows of equal bins go the same way in all trees."""
    return np.stack([np.searchsorted(thresholds(forest, f), x[:, f], side="left") for f in range(x.shape[1])], axis=1)


def drivers(forest: list[Tree], scored: DataFrame) -> DataFrame:
    """customer_id, probability, tier, the features with the largest absolute Shapley values, and the gap between the
    probability and base plus all values. Customers of equal bins have equal values, which are worked out once."""
    shared = scored.sparkSession.sparkContext.broadcast(forest)
    names = np.array(FEATURES)

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                p["bins"] = [b.tobytes() for b in bins(shared.value, np.stack(p["x"])).astype(np.int32)]
                yield p

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for i in range(0, len(whole), ATTRIBUTION_ROWS):
                p = whole.iloc[i : i + ATTRIBUTION_ROWS]
                values, base = attributions(shared.value, np.stack(p["x"]))
                best = names[np.argsort(-np.abs(values), axis=1, kind="stable")[:, :DRIVERS]]
                found = p[["bins"]].copy()
                for k in range(DRIVERS):
                    found[f"top_risk_driver_{k + 1}"] = best[:, k]
                found["worth"] = values.sum(axis=1) + base
                yield found

    kept = "customer_id long, churn_probability double, churn_risk_tier string"
    rows = scored.select("customer_id", "churn_probability", "churn_risk_tier", vector_to_array("features").alias("x"))
    keyed = rows.mapInPandas(binned, kept + ", x array<double>, bins binary")
    tops = [f"top_risk_driver_{k + 1}" for k in range(DRIVERS)]
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = keyed.groupBy("bins").agg(F.min("x").alias("x")).repartition(tasks, "bins")  # few bytes and much work a row
    found = alike.mapInPandas(run, "bins binary, " + ", ".join(f"{c} string" for c in tops) + ", worth double")
    gap = F.abs(F.col("worth") - F.col("churn_probability")).alias("gap")
    return keyed.drop("x").join(found, "bins").select("customer_id", "churn_probability", "churn_risk_tier", *tops, gap)


def importance(model: Churn) -> DataFrame:
    values = model.forest.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(FEATURES, values), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")
