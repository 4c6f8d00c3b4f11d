"""Campaign KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import avg, dbl, mean, n, pct, ratio, rounded, total
from ledgerline.plans.registry import query
from ledgerline.sources.warehouse import Star

STEPS = ("contacted", "opened", "clicked", "accepted")


def steps() -> list[F.Column]:
    return [F.count_if(f"was_{step}").alias(step) for step in STEPS]


def joined(s: Star, *columns: str) -> DataFrame:
    return s.fact_campaign_responses.join(F.broadcast(s.dim_campaign.select("campaign_id", *columns)), "campaign_id")


def conversion() -> F.Column:
    return pct(F.count_if("was_accepted"), n()).alias("conversion_pct")


@query
def camp_funnel(s: Star) -> DataFrame:
    return joined(s, "campaign_name", "campaign_type").groupBy("campaign_name", "campaign_type").agg(
        n().alias("targeted"), *steps(),
        pct(F.count_if("was_opened"), n()).alias("open_pct"),
        pct(F.count_if("was_clicked"), F.count_if("was_opened")).alias("click_to_open_pct"),
        conversion(),
    )


@query
def camp_roi(s: Star) -> DataFrame:
    budget = F.first("budget")
    won = F.count_if("was_accepted")
    return joined(s, "campaign_name", "budget").groupBy("campaign_id", "campaign_name").agg(
        budget.alias("budget"), n().alias("targeted"), won.alias("conversions"), total("conversion_value", 0).alias("revenue"),
        rounded((dbl(F.sum("conversion_value")) - dbl(budget)) / F.nullif(dbl(budget), F.lit(0.0)) * F.lit(100.0), 2).alias("roi_pct"),
        rounded(ratio(budget, won), 0).alias("cost_per_acquisition"),
    ).drop("campaign_id")


@query
def camp_channel(s: Star) -> DataFrame:
    value = F.when(F.col("was_accepted"), F.col("conversion_value"))
    return joined(s, "campaign_type").groupBy("campaign_type").agg(
        n().alias("volume"), pct(F.count_if("was_opened"), n()).alias("open_pct"), conversion(),
        rounded(mean(value), 0).alias("avg_value"),
    )


@query
def camp_time_to_response(s: Star) -> DataFrame:
    days = "days_to_response"
    return joined(s, "campaign_name").where("was_accepted").groupBy("campaign_name").agg(
        avg(days, 1).alias("avg_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"),
        F.count_if(F.col(days) <= 7).alias("within_week"),
    )


@query
def camp_by_income(s: Star) -> DataFrame:
    incomes = s.dim_customer.select("customer_id", "income_bracket")
    return s.fact_campaign_responses.join(incomes, "customer_id").groupBy("income_bracket").agg(
        n().alias("targeted"), conversion(), total("conversion_value", 0).alias("value")
    )
