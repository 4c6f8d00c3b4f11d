"""Transaction KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.functions.columns import avg, banded, growth, n, pct, ratio, rounded, share_of_total, tile_label, total
from ledgerline.functions.ranking import percentiles
from ledgerline.functions.tiles import with_tiles
from ledgerline.plans.registry import query
from ledgerline.plans.revenue import dated, with_customers
from ledgerline.sources.warehouse import Star

def volume(*more: F.Column) -> list[F.Column]:
    return [n().alias("transactions"), total("amount", 0).alias("volume"), avg("amount", 2).alias("avg_value"), *more]


def customers() -> F.Column:
    return F.count_distinct("customer_id").alias("customers")


def with_volume(rows: DataFrame, *keys: str, digits: int = 2) -> DataFrame:
    """By keys: transactions, volume, avg_value, customers and exact (the amount), without moving a row for each customer."""
    exact = F.col("exact")
    return with_customers(rows, *keys).select(
        *keys, "transactions", rounded(exact.cast("double"), 0).alias("volume"), rounded(ratio(exact, F.col("valued")), digits).alias("avg_value"),
        "customers", "exact",
    )


@query
def txn_overview(s: Star) -> DataFrame:
    high = F.count_if("is_high_value")
    middle = percentiles(s.fact_transactions, F.col("amount").cast("double"), {"median": 0.5})
    found = s.fact_transactions.agg(
        *volume(customers()),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        high.alias("high_value"), pct(high, n()).alias("high_value_pct"),
    )
    return found.crossJoin(middle.select(rounded(F.col("median"), 2).alias("median_value")))  # one row each


@query
def txn_quartiles(s: Star) -> DataFrame:
    """Ties at a quartile's edge do not matter: equal amounts are alike."""
    tiled = with_tiles(s.fact_transactions.select("amount", "transaction_id"), {"quartile": F.col("amount")}, "transaction_id", 4)
    found = tiled.groupBy("quartile").agg(
        *volume(F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.sum("amount").alias("exact"))
    )
    found = share_of_total(found, "exact", "share_pct").drop("exact")
    return found.withColumn("label", tile_label("quartile", labels.AMOUNT_QUARTILES))


@query
def txn_count_bands(s: Star) -> DataFrame:
    counts = s.fact_transactions.groupBy("customer_id").agg(n().alias("ct"))
    found = counts.groupBy(banded("ct", labels.TRANSACTION_COUNT, closed=True).alias("band")).agg(
        n().alias("customers"), avg("ct", 1).alias("avg_transactions")
    )
    return share_of_total(found, "customers", "share_pct")


@query
def txn_monthly(s: Star) -> DataFrame:
    keys = ["year", "month_number", "month_name"]
    exact = F.col("exact")
    monthly = with_customers(dated(s, *keys), *keys).select(
        *keys, "transactions", rounded(exact.cast("double"), 0).alias("volume"), rounded(ratio(exact, F.col("valued")), 2).alias("avg_value"), "customers"
    )
    monthly = monthly.withColumn("per_customer", rounded(ratio(F.col("transactions"), F.col("customers")), 1))
    return growth(monthly, "transactions", "previous", "growth_pct", "year", "month_number")


@query
def txn_by_weekday(s: Star) -> DataFrame:
    keys = ["day_of_week", "day_name"]
    return share_of_total(dated(s, *keys).groupBy(*keys).agg(*volume()), "transactions", "share_pct")


@query
def txn_weekend(s: Star) -> DataFrame:
    day = F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday")
    found = with_volume(dated(s, "is_weekend").withColumn("day_type", day), "day_type")
    return share_of_total(found, "exact", "share_pct").drop("exact")


@query
def txn_holiday(s: Star) -> DataFrame:
    period = (
        F.when(F.col("holiday_name") == "Diwali Season", "Diwali Season").when(F.col("is_holiday"), "Other Holiday")
        .otherwise("Regular Day")
    )
    return with_volume(dated(s, "holiday_name", "is_holiday").withColumn("period", period), "period").drop("exact")


@query
def txn_salary_week(s: Star) -> DataFrame:
    period = F.when(F.col("is_salary_week"), "Salary Week").otherwise("Non-Salary Week").alias("period")
    return dated(s, "is_salary_week").groupBy(period).agg(*volume())


@query
def txn_first_last(s: Star) -> DataFrame:
    """By status: mean span from each customer's first to last day, days since the last, and transactions."""
    day = F.to_date("transaction_date")
    mine = s.fact_transactions.groupBy("customer_id").agg(F.min(day).alias("first"), F.max(day).alias("last"), n().alias("ct"))
    since = F.datediff(F.lit(s.as_of).cast("date"), F.col("last"))
    return mine.join(s.dim_customer.select("customer_id", "customer_status"), "customer_id").groupBy("customer_status").agg(
        n().alias("customers"),
        avg(F.datediff("last", "first"), 0).alias("avg_span_days"),
        avg(since, 0).alias("avg_days_since_last"),
        avg("ct", 1).alias("avg_transactions"),
    )


@query
def txn_high_value(s: Star) -> DataFrame:
    found = with_volume(s.fact_transactions.where("is_high_value"), "merchant_category", digits=0).drop("exact")
    return share_of_total(found, "transactions", "share_pct")
