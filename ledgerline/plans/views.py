"""Wide tables and measures for dashboards, and the analyses that business reports ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import (
    active, age_band, avg, churn_pct, churned, longs, n, ratio, rounded, total,
)
from ledgerline.functions.ranking import percentiles
from ledgerline.plans.campaign import conversion, steps
from ledgerline.plans.registry import QUERIES, query
from ledgerline.plans.revenue import dated, per_customer, with_customers
from ledgerline.plans.service import escalation
from ledgerline.plans.value import rfm_customer, with_clv
from ledgerline.sources.warehouse import Star


def with_behaviour(s: Star) -> DataFrame:
    """Customers with complaints, csat and accepted campaigns; each fact is summed up first, so none multiplies."""
    tickets = s.fact_service_logs.groupBy("customer_id").agg(n().alias("complaints"), avg("csat_score", 4).alias("avg_csat"))
    answers = s.fact_campaign_responses.groupBy("customer_id").agg(F.count_if("was_accepted").alias("accepted"))
    joined = s.dim_customer.join(tickets, "customer_id", "left").join(answers, "customer_id", "left")
    return joined.fillna(0, ["complaints", "accepted"])


@query
def bi_customer_overview(s: Star) -> DataFrame:
    return with_behaviour(s).select(
        "customer_id", "age", age_band().alias("age_band"), "gender", "income_bracket", "state", "city", "card_category",
        "customer_status", "customer_tenure_months", "total_products_held", "credit_limit",
        F.col("total_trans_amt_12m").alias("annual_revenue"), F.col("total_trans_ct_12m").alias("annual_transactions"),
        "risk_category", "avg_csat", "complaints", "accepted",
    )


@query
def bi_transaction_timeline(s: Star) -> DataFrame:
    days = ["full_date", "year", "month_name", "day_name", "is_weekend", "is_holiday", "holiday_name"]
    cells = with_customers(s.fact_transactions, "date_key", "merchant_category", "transaction_channel")
    return cells.join(F.broadcast(s.dim_date.select("date_key", *days)), "date_key").select(
        *days, "merchant_category", "transaction_channel", "transactions", F.col("exact").cast("double").alias("revenue"), "customers"
    )


@query
def v_executive_kpis(s: Star) -> DataFrame:
    keys = ["year", "month_number", "month_name"]
    revenue = dated(s, *keys).groupBy(*keys).agg(total("amount").alias("revenue"), n().alias("transactions"))
    days = s.dim_date.select("date_key", "year", "month_number")
    csat = s.fact_service_logs.join(F.broadcast(days), "date_key").groupBy("year", "month_number").agg(
        avg("csat_score", 4).alias("avg_csat")
    )
    return revenue.join(csat, ["year", "month_number"], "left")


@query
def v_customer_360(s: Star) -> DataFrame:
    return with_behaviour(s).select(
        "customer_id", "age", "gender", "dependents", "income_bracket", "card_category", "customer_tenure_months",
        "customer_status", "credit_limit", "total_trans_amt_12m", "total_trans_ct_12m", "credit_utilization_ratio",
        "complaints", "avg_csat", "accepted",
    )


@query
def v_campaign_funnel(s: Star) -> DataFrame:
    sums = s.fact_campaign_responses.groupBy("campaign_id").agg(
        n().alias("targeted"), *steps(), total("conversion_value").alias("value")
    )
    names = s.dim_campaign.select("campaign_id", "campaign_name", "campaign_type", "target_segment")
    return names.join(sums, "campaign_id", "left").fillna(0, ["targeted", "contacted", "opened", "clicked", "accepted"])


@query
def v_transaction_heatmap(s: Star) -> DataFrame:
    """By the time of the transactions; the adapter's, whose days have no time, take the event stream's purchases."""
    day = F.to_date("transaction_date")
    return (
        s.timed().groupBy(F.weekday(day).alias("day_of_week"), F.date_format(day, "EEEE").alias("day_name"),
                          F.hour("transaction_date").alias("hour_of_day"), "merchant_category")
        .agg(n().alias("transactions"), total("amount").alias("volume"))
    )


@query
def bi_measures(s: Star) -> DataFrame:
    """One row; each fact is aggregated on its own."""
    sales = s.fact_transactions.agg(total("amount").alias("revenue"), n().alias("transactions"), avg("amount", 2).alias("avg_value"))
    people = s.dim_customer.agg(
        n().alias("customers"), active().alias("active"), churned().alias("churned"), churn_pct().alias("churn_pct"),
        avg("customer_tenure_months", 1).alias("avg_tenure"),
    )
    tickets = s.fact_service_logs.agg(avg("csat_score", 2).alias("avg_csat"), escalation())
    answers = s.fact_campaign_responses.agg(conversion())
    return sales.crossJoin(people).crossJoin(tickets).crossJoin(answers)  # one row each


@query
def bi_revenue_yoy(s: Star) -> DataFrame:
    monthly = dated(s, "year", "month_number").groupBy("year", "month_number").agg(F.sum("amount").alias("exact"))
    past = monthly.select((F.col("year") + 1).alias("year"), "month_number", F.col("exact").alias("past"))
    change = rounded((F.col("exact").cast("double") - F.col("past").cast("double")) * 100.0 / F.col("past").cast("double"), 2)
    return monthly.join(past, ["year", "month_number"], "left").select(
        "year", "month_number", F.col("exact").alias("revenue"), F.col("past").alias("last_year"), change.alias("yoy_pct")
    )


@query
def bi_rfm_spend_matrix(s: Star) -> DataFrame:
    spend = s.dim_customer.select("customer_id", "total_trans_amt_12m")
    return rfm_customer(s).join(spend, "customer_id").groupBy("segment").agg(
        n().alias("customers"), avg("total_trans_amt_12m", 0).alias("avg_spend")
    )


@query
def bi_utilization_histogram(s: Star) -> DataFrame:
    bucket = F.floor(F.col("credit_utilization_ratio") * 10).cast("bigint").alias("bucket")
    return s.dim_customer.groupBy(bucket).agg(n().alias("customers"))


@query
def bi_quarter_waterfall(s: Star) -> DataFrame:
    found = dated(s, "year", "quarter").groupBy("year", "quarter").agg(F.sum("amount").alias("exact"))
    past = F.lag("exact").over(Window.partitionBy("year").orderBy("quarter"))
    return found.select("year", "quarter", F.col("exact").alias("revenue"), (F.col("exact") - past).alias("delta"))


@query
def bi_roi_by_type(s: Star) -> DataFrame:
    """Each campaign's budget counts once."""
    won = s.fact_campaign_responses.groupBy("campaign_id").agg(F.sum("conversion_value").alias("value"))
    found = s.dim_campaign.join(won, "campaign_id", "left").groupBy("campaign_type").agg(
        F.sum("budget").alias("budget"), F.coalesce(F.sum("value"), F.lit(0)).alias("value")
    )
    roi = rounded((F.col("value").cast("double") - F.col("budget").cast("double")) / F.nullif(F.col("budget").cast("double"), F.lit(0.0)) * 100.0, 2)
    return found.withColumn("roi_pct", roi)


@query
def bi_csat_vs_resolution(s: Star) -> DataFrame:
    days = s.dim_date.select("date_key", "year", "month_number")
    return s.fact_service_logs.join(F.broadcast(days), "date_key").groupBy("year", "month_number").agg(
        avg("csat_score", 2).alias("avg_csat"), avg("resolution_time_hours", 1).alias("avg_hours")
    )


@query
def bi_priority_escalation(s: Star) -> DataFrame:
    return s.fact_service_logs.groupBy("priority").agg(n().alias("complaints"), escalation())


@query
def bi_state_city_drill(s: Star) -> DataFrame:
    places = s.dim_customer.select("customer_id", "state", "city")
    return per_customer(s).join(places, "customer_id").rollup("state", "city").agg(
        F.sum("revenue").cast("double").alias("revenue"), n().alias("customers")
    )


@query
def act_volume_drop(s: Star) -> DataFrame:
    """Customers whose last active day's volume is below the average active day of the 30 days before it."""
    day = F.to_date("transaction_date").alias("day")
    daily = s.fact_transactions.groupBy("customer_id", day).agg(F.sum("amount").alias("volume"))
    place = F.unix_date("day")
    mine = Window.partitionBy("customer_id")
    trail = mine.orderBy(place).rangeBetween(-30, -1)
    past = ratio(F.sum("volume").over(trail), F.count("volume").over(trail))
    found = daily.withColumn("past", past).withColumn("last", F.max("day").over(mine))
    return found.where((F.col("day") == F.col("last")) & (F.col("volume").cast("double") < F.col("past"))).select(
        "customer_id", "day", "volume", rounded(F.col("past"), 2).alias("trailing_avg")
    )


@query
def act_upgrade_candidates(s: Star) -> DataFrame:
    """Customers with an entry card and a value in the top quarter."""
    valued = with_clv(s.dim_customer)
    edge = percentiles(valued, F.col("estimated_clv").cast("double"), {"edge": 0.75})  # one row
    return valued.where("card_category = 'Blue'").crossJoin(F.broadcast(edge)).where(
        F.col("estimated_clv").cast("double") > F.col("edge")
    ).select("customer_id", "card_category", rounded(F.col("estimated_clv").cast("double"), 0).alias("clv"))


@query
def act_final6m_resolution(s: Star) -> DataFrame:
    """Resolution hours by status in the six months up to the last day of the events."""
    first = F.add_months(F.lit(s.events_as_of).cast("date"), -6)
    recent = s.fact_service_logs.where(F.to_date("complaint_date") >= first)
    status = s.dim_customer.select("customer_id", "customer_status")
    return recent.join(status, "customer_id").groupBy("customer_status").agg(
        n().alias("complaints"), avg("resolution_time_hours", 1).alias("avg_hours")
    )


def view_jobs(*names: str) -> dict[str, Callable[[Star], DataFrame]]:
    """The jobs that dashboards read, or those of them that are named."""
    found = {name: job for name, job in QUERIES.items() if name.startswith(("v_", "bi_"))}
    unknown = sorted(set(names) - set(found))
    if unknown:
        raise ValueError(f"no views: {', '.join(unknown)}")
    return {name: job for name, job in found.items() if name in names or not names}


def create_views(s: Star, *names: str) -> list[str]:
    """Make all views, or those that are named, temporary views of the session; their names."""
    jobs = view_jobs(*names)
    for name, job in jobs.items():
        longs(job(s)).createOrReplaceTempView(name)
    return list(jobs)


def save_views(s: Star, database: str, *names: str) -> list[str]:
    """Store all views, or those that are named, as tables of a database in place of what is there; their names."""
    jobs = view_jobs(*names)
    for name, job in jobs.items():
        longs(job(s)).write.mode("overwrite").saveAsTable(f"{database}.{name}")
    return list(jobs)
