"""Customer KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import (
    active, age_band, avg, churn_pct, churned, growth, n, pct, ratio, share_of_total,
)
from ledgerline.functions.ranking import with_tile
from ledgerline.plans.registry import query
from ledgerline.sources.warehouse import Star

SPEND, TENURE = "total_trans_amt_12m", "customer_tenure_months"


def by(df: DataFrame, key: str, *measures: Column) -> DataFrame:
    """customers by key, their share of all, and measures."""
    return share_of_total(df.groupBy(key).agg(n().alias("customers"), *measures), "customers", "share_pct")


def spend() -> Column:
    return avg(SPEND, 0).alias("avg_spend")


def churn() -> Column:
    return churn_pct().alias("churn_pct")


@query
def cust_overview(s: Star) -> DataFrame:
    return s.dim_customer.agg(
        n().alias("customers"), active().alias("active"), churned().alias("churned"), churn(),
        pct(active(), n()).alias("retention_pct"), avg(TENURE, 1).alias("avg_tenure"),
        avg("total_products_held", 2).alias("avg_products"),
    )


@query
def cust_by_gender(s: Star) -> DataFrame:
    return by(s.dim_customer, "gender", avg(TENURE, 1).alias("avg_tenure"), spend(), churn())


@query
def cust_by_income(s: Star) -> DataFrame:
    return by(s.dim_customer, "income_bracket", avg("credit_limit", 0).alias("avg_limit"), spend(), churn())


@query
def cust_by_age_band(s: Star) -> DataFrame:
    return by(s.dim_customer.withColumn("band", age_band()), "band", spend(), churn())


@query
def cust_tenure_quartile(s: Star) -> DataFrame:
    tiled = with_tile(s.dim_customer, [F.col(TENURE).asc_nulls_first(), F.col("customer_id")], 4, "quartile")
    return tiled.groupBy("quartile").agg(
        n().alias("customers"), F.min(TENURE).alias("min_tenure"), F.max(TENURE).alias("max_tenure"),
        avg(TENURE, 1).alias("avg_tenure"), spend(), churn(),
    )


@query
def cust_monthly_acquisition(s: Star) -> DataFrame:
    month = F.trunc("customer_since", "month").alias("month")
    monthly = growth(
        s.dim_customer.groupBy(month).agg(n().alias("new_customers")), "new_customers", "previous", "growth_pct", "month"
    )
    return monthly.withColumn("cumulative", F.sum("new_customers").over(Window.orderBy(F.col("month").asc_nulls_last())))


@query
def cust_churn_by_card(s: Star) -> DataFrame:
    rate = F.col("churned") / F.col("customers")
    return (
        s.dim_customer.groupBy("card_category").agg(n().alias("customers"), churned().alias("churned"), churn())
        .withColumn("churn_rank", F.rank().over(Window.orderBy(rate.desc())))
    )


@query
def cust_churn_by_inactivity(s: Star) -> DataFrame:
    return s.dim_customer.groupBy("months_inactive_12m").agg(
        n().alias("customers"), churned().alias("churned"), churn(), spend()
    )


@query
def cust_churn_by_contacts(s: Star) -> DataFrame:
    return s.dim_customer.groupBy("contacts_count_12m").agg(n().alias("customers"), churned().alias("churned"), churn())


@query
def cust_risk_distribution(s: Star) -> DataFrame:
    used = ratio(F.round(F.sum(F.col("credit_utilization_ratio").cast("decimal(9,4)")), 4), F.count("credit_utilization_ratio"))
    order = F.when(F.col("risk_category") == "High", 1).when(F.col("risk_category") == "Medium", 2).otherwise(3)
    found = by(
        s.dim_customer, "risk_category", spend(), (F.floor(used * 1e4 + 0.5) / 1e4).alias("avg_utilization"),
        avg("months_inactive_12m", 1).alias("avg_inactive"),
    )
    return found.orderBy(order)


@query
def cust_multi_product(s: Star) -> DataFrame:
    found = by(s.dim_customer, "total_products_held", spend(), churn(), churned().alias("churned"))
    rate = F.col("churned") / F.col("customers")
    return found.withColumn("retention_rank", F.dense_rank().over(Window.orderBy(rate))).drop("churned")


@query
def cust_by_state(s: Star) -> DataFrame:
    return by(s.dim_customer, "state", spend(), churn(), F.count_distinct("city").alias("cities"))


@query
def cust_by_channel(s: Star) -> DataFrame:
    return by(s.dim_customer, "preferred_channel", avg("age", 1).alias("avg_age"), spend(), churn())


@query
def cust_top20_value(s: Star) -> DataFrame:
    order = Window.orderBy(F.col(SPEND).desc(), "customer_id")
    top = s.dim_customer.orderBy(F.col(SPEND).desc(), "customer_id").limit(20)
    return top.select(
        F.row_number().over(order).alias("value_rank"), "customer_id",
        F.concat_ws(" ", "first_name", "last_name").alias("customer_name"),
        F.concat_ws(", ", "city", "state").alias("location"), "card_category", F.col(SPEND).alias("annual_spend"),
        F.col("total_trans_ct_12m").alias("annual_transactions"), F.col(TENURE).alias("tenure"), "customer_status",
    )
