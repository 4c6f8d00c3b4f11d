"""The transforms as queries over the warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import n, rounded
from ledgerline.functions.ranking import with_percentile_rank
from ledgerline.operators import transforms as X
from ledgerline.plans.quality import orphans, rows_of, union
from ledgerline.plans.registry import query
from ledgerline.sources import files, profiles
from ledgerline.sources.adapter import INCOME_SCORE
from ledgerline.sources.storage import shared_dir
from ledgerline.sources.warehouse import Star

INCOME_LABELS = {"AUTOMOBILE": "Above", "BUILDING": "Upper", "FURNITURE": "Middle", "HOUSEHOLD": "Lower"}
#: Names of the pseudonym query.
POOL = ["Ada", "Ben", "Cleo", "Dov", "Eli", "Fay", "Gus"]


@query
def dim_date(s: Star) -> DataFrame:
    """Calendar days on which anything was sold."""
    return s.dim_date.join(s.fact_transactions.select("date_key"), "date_key", "left_semi")


@query
def dim_date_calendar(s: Star) -> DataFrame:
    """The whole calendar, day by day."""
    return s.dim_date


@query
def map_categories(s: Star) -> DataFrame:
    label = X.mapped("income_bracket", INCOME_LABELS, "Unmapped").alias("label")
    return s.dim_customer.groupBy("income_bracket", label).agg(n().alias("customers"))


@query
def sentinel_to_null(s: Star) -> DataFrame:
    bracket = X.sentinel_to_null("income_bracket", "MACHINERY").alias("income_bracket")
    return s.dim_customer.groupBy(bracket).agg(n().alias("customers"))


@query
def scale_money(s: Star) -> DataFrame:
    return s.dim_customer.select(
        "customer_id", X.scale_money("credit_limit").alias("scaled"), X.scale_money("credit_limit", digits=-2).alias("hundreds")
    )


@query
def customer_since(s: Star) -> DataFrame:
    months = F.col("customer_tenure_months")
    return s.dim_customer.select("customer_id", X.customer_since(F.lit(s.as_of).cast("date"), months).alias("since"))


@query
def risk_category(s: Star) -> DataFrame:
    return s.dim_customer.select("customer_id", X.risk_category().alias("risk"))


@query
def pct_rank_avg(s: Star) -> DataFrame:
    found = with_percentile_rank(s.dim_customer.select("customer_id", "customer_tenure_months"), "customer_tenure_months", "p")
    return found.select("customer_id", rounded(F.col("p"), 9).alias("pct_rank"))


def tiered(s: Star) -> DataFrame:
    base = s.dim_customer.select("customer_id", "income_bracket", "total_trans_amt_12m", "customer_tenure_months")
    return X.card_tier(base, X.mapped("income_bracket", INCOME_SCORE, 1))


@query
def card_tier(s: Star) -> DataFrame:
    return tiered(s).select("customer_id", rounded(F.col("card_score"), 6).alias("score"), "card_category")


@query
def products_held(s: Star) -> DataFrame:
    held = X.products_held(X.mapped("income_bracket", INCOME_SCORE, 1)).alias("held")
    return tiered(s).select("customer_id", held)


@query
def hash_name(s: Star) -> DataFrame:
    return s.dim_customer.select("customer_id", X.hash_name("customer_id", POOL).alias("name"))


@query
def campaign_audience(s: Star) -> DataFrame:
    return X.campaign_audience(s.dim_customer, ("AUTOMOBILE", "BUILDING"), ("FURNITURE",))


@query
def flag_high_value(s: Star) -> DataFrame:
    return X.flag_high_value(s.fact_transactions.drop("is_high_value")).groupBy("merchant_category").agg(
        n().alias("transactions"), F.count_if("is_high_value").alias("high_value")
    )


@query
def allocate_total(s: Star) -> DataFrame:
    """A quarter of each customer's total dealt onto the customer's sales by category."""
    rows = s.fact_transactions.groupBy("customer_id", "merchant_category").agg(F.sum("amount").alias("weight"))
    totals = s.dim_customer.select("customer_id", (F.col("total_trans_amt_12m") / 4).cast("decimal(15,2)").alias("budget"))
    found = X.allocate_total(rows.join(totals, "customer_id"), "customer_id", "weight", "budget", ["merchant_category"], "part")
    return found.select("customer_id", "merchant_category", "budget", "part")


@query
def reconcile_load(s: Star) -> DataFrame:
    return X.reconcile_load(s.dim_customer, s.fact_transactions)


@query
def profile_categories(s: Star) -> DataFrame:
    return X.profile_categories(s.fact_transactions)


@query
def profile_amounts(s: Star) -> DataFrame:
    return X.profile_amounts(s.fact_transactions)


@query
def profile_hour(s: Star) -> DataFrame:
    return X.profile_weights(s.timed(), F.hour("transaction_date"), "hour")


@query
def profile_dow(s: Star) -> DataFrame:
    return X.profile_weights(s.fact_transactions, F.weekday(F.to_date("transaction_date")), "weekday")


@query
def profile_month(s: Star) -> DataFrame:
    return X.profile_weights(s.fact_transactions, F.month(F.to_date("transaction_date")), "month")


@query
def profile_merchants(s: Star) -> DataFrame:
    return X.profile_merchants(s.fact_transactions)


def _two_batches(s: Star) -> DataFrame:
    """The profile that is stored for the transactions before 1995 and grows by those since."""
    early = F.to_date("transaction_date") < F.lit("1995-01-01").cast("date")
    folder = f"{shared_dir(s.spark)}/profile-{uuid.uuid4().hex}"
    for batch, rule in (("early", early), ("late", ~early | early.isNull())):
        profiles.add(profiles.profile(s.fact_transactions.where(rule)), folder, batch)
    return profiles.stored(s.spark, folder)


@query
def profile_batches(s: Star) -> DataFrame:
    """What the profiles of two batches, merged, say of the categories: shares, moments and quartiles within 1 %."""
    p = _two_batches(s)
    both = profiles.categories(p).withColumnRenamed("category", "__c")
    return both.join(profiles.amounts(p), F.col("__c").eqNullSafe(F.col("category"))).drop("__c")


@query
def profile_batch_calendar(s: Star) -> DataFrame:
    """What the profiles of two batches, merged, say of weekdays and months."""
    p = _two_batches(s)
    return union([
        profiles.weights(p, part).select(F.lit(part).alias("part"), F.col(part).alias("value"), "transactions", "weight")
        for part in ("weekday", "month")
    ])


@query
def orphan_counts_load(s: Star) -> DataFrame:
    """Rows of each fact and its orphans by customer."""
    facts = ("fact_transactions", "fact_service_logs", "fact_campaign_responses")
    return union([
        getattr(s, t).agg(n().alias("row_count"))
        .crossJoin(orphans(s, t, "customer_id", "dim_customer").agg(rows_of("n").alias("orphans")))  # one row each
        .withColumn("table_name", F.lit(t))
        for t in facts
    ])


@query
def seed_dims(s: Star) -> DataFrame:
    """The seeded products and campaigns, and how many facts refer to each: sales of a product, answers to a campaign."""
    kinds = {
        "dim_product": (files.seed_products(s.spark), "product", "launch_date", s.fact_transactions),
        "dim_campaign": (files.seed_campaigns(s.spark), "campaign", "start_date", s.fact_campaign_responses),
    }
    return union([
        seeds.join(facts.groupBy(f"{x}_id").agg(n().alias("facts")), f"{x}_id", "left").select(
            F.lit(t).alias("table_name"), F.col(f"{x}_id").cast("long").alias("id"), F.col(f"{x}_name").alias("name"),
            F.col(f"{x}_type").alias("kind"), F.col(since).cast("string").alias("since"), F.coalesce("facts", F.lit(0)).alias("facts"),
        )
        for t, (seeds, x, since, facts) in kinds.items()
    ])


@query
def export_dims(s: Star) -> DataFrame:
    """Rows, null keys and duplicate keys of the seeded dimensions."""
    keys = {"dim_product": "product_id", "dim_campaign": "campaign_id"}
    return union([
        getattr(s, t).groupBy(k).agg(n().alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col(k).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
            F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        )
        .withColumn("table_name", F.lit(t))
        for t, k in keys.items()
    ])


@query
def ml_churn_features(s: Star) -> DataFrame:
    from ledgerline.ml.churn import features

    return features(s.dim_customer)


@query
def ml_churn_split(s: Star) -> DataFrame:
    """Rows of each class in the training and test parts."""
    from ledgerline.ml.churn import features, split

    return split(features(s.dim_customer)).groupBy("target", "is_train").agg(n().alias("customers"))


@query
def ml_seg_features(s: Star) -> DataFrame:
    from ledgerline.ml.segmentation import features

    return features(s)
