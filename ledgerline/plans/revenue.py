"""Revenue KPIs. Facts are aggregated to the customer before they meet the customer dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.functions.bitsets import distinct
from ledgerline.functions.columns import avg, growth, n, ratio, rounded, share_of_total, tile_label
from ledgerline.functions.ranking import with_tile
from ledgerline.plans.registry import query
from ledgerline.sources.warehouse import Star


def dated(s: Star, *columns: str) -> DataFrame:
    """Transactions with calendar columns; the calendar is small by construction and broadcast."""
    return s.fact_transactions.join(F.broadcast(s.dim_date.select("date_key", *columns)), "date_key")


def per_customer(s: Star) -> DataFrame:
    return s.fact_transactions.groupBy("customer_id").agg(F.sum("amount").alias("revenue"), n().alias("transactions"))


def with_profile(s: Star, *columns: str) -> DataFrame:
    return per_customer(s).join(s.dim_customer.select("customer_id", *columns), "customer_id")


def per_head(value: str, heads: str) -> F.Column:
    return rounded(ratio(F.col(value), F.col(heads)), 0)


def ranked(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.rank().over(Window.orderBy(F.col("revenue").desc())))


def of_profile(s: Star, key: str, *extra: str) -> DataFrame:
    found = with_profile(s, key).groupBy(key).agg(
        n().alias("customers"), F.sum("revenue").alias("revenue"), F.sum("transactions").alias("transactions")
    )
    found = share_of_total(found, "revenue", "share_pct").withColumn("per_customer", per_head("revenue", "customers"))
    if "rank" in extra:
        found = ranked(found, "revenue_rank")
    if "avg" in extra:
        found = found.withColumn("avg_value", per_head("revenue", "transactions"))
    found = found if "transactions" in extra else found.drop("transactions")
    return found.withColumn("revenue", rounded(F.col("revenue").cast("double"), 0))


def with_customers(rows: DataFrame, *keys: str) -> DataFrame:
    """Transactions by keys: customers (distinct), transactions, exact (their amount) and valued (those with an amount)."""
    sums = {"transactions": n(), "exact": F.sum("amount"), "valued": F.count("amount")}
    return distinct(rows, keys, "customer_id", "customers", **sums)


def of_facts(s: Star, key: str) -> DataFrame:
    found = with_customers(s.fact_transactions, key).select(
        key, "transactions", F.col("exact").alias("revenue"), rounded(ratio(F.col("exact"), F.col("valued")), 0).alias("avg_value"), "customers"
    )
    return share_of_total(found, "revenue", "share_pct")


@query
def rev_monthly(s: Star) -> DataFrame:
    keys = ["year", "month_number", "month_name", "fiscal_year", "fiscal_quarter"]
    monthly = with_customers(dated(s, *keys), *keys).drop("valued")
    grown = growth(monthly, "exact", "previous", "growth_pct", "year", "month_number")
    ytd = Window.partitionBy("year").orderBy("month_number")
    return (
        grown.withColumn("ytd", F.sum("exact").over(ytd))
        .withColumn("revenue", rounded(F.col("exact").cast("double"), 0))
        .withColumn("per_customer", per_head("exact", "customers"))
        .drop("exact")
    )


@query
def rev_fiscal_quarter(s: Star) -> DataFrame:
    keys = ["fiscal_year", "fiscal_quarter"]
    found = with_customers(dated(s, *keys), *keys).drop("valued")
    return (
        growth(found, "exact", "previous", "growth_pct", *keys)
        .withColumn("revenue", rounded(F.col("exact").cast("double"), 0))
        .withColumn("per_customer", per_head("exact", "customers"))
        .drop("exact")
    )


@query
def rev_by_income(s: Star) -> DataFrame:
    return of_profile(s, "income_bracket", "rank", "avg")


@query
def rev_by_card(s: Star) -> DataFrame:
    return of_profile(s, "card_category", "avg", "transactions")


@query
def rev_by_channel(s: Star) -> DataFrame:
    found = ranked(of_facts(s, "transaction_channel"), "channel_rank")
    return found.withColumn("revenue", rounded(F.col("revenue").cast("double"), 0))


@query
def rev_by_merchant(s: Star) -> DataFrame:
    found = of_facts(s, "merchant_category").withColumn("per_customer", per_head("revenue", "customers"))
    return found.withColumn("revenue", rounded(F.col("revenue").cast("double"), 0))


@query
def rev_by_state(s: Star) -> DataFrame:
    return of_profile(s, "state", "rank")


@query
def rev_by_status(s: Star) -> DataFrame:
    return of_profile(s, "customer_status", "avg")


@query
def rev_top20_customers(s: Star) -> DataFrame:
    day = F.to_date("transaction_date")
    order = [F.col("revenue").desc(), F.col("customer_id")]
    top = (
        s.fact_transactions.groupBy("customer_id")
        .agg(
            F.sum("amount").alias("revenue"), n().alias("transactions"), avg("amount", 0).alias("avg_value"),
            F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        )
        .orderBy(*order).limit(20).withColumn("revenue_rank", F.row_number().over(Window.orderBy(*order)))
    )
    profile = s.dim_customer.select(
        "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"), "card_category",
        "income_bracket", F.concat_ws(", ", "city", "state").alias("location"), "customer_status",
    )
    return profile.join(F.broadcast(top), "customer_id")


@query
def rev_pareto(s: Star) -> DataFrame:
    tiled = with_tile(per_customer(s), [F.col("revenue").desc(), F.col("customer_id")], 5, "quintile")
    found = tiled.groupBy("quintile").agg(
        n().alias("customers"), F.sum("revenue").alias("exact"), avg("revenue", 0).alias("avg_revenue")
    )
    return (
        share_of_total(found, "exact", "share_pct")
        .withColumn("label", tile_label("quintile", labels.PARETO))
        .withColumn("revenue", rounded(F.col("exact").cast("double"), 0))
        .drop("exact")
    )

