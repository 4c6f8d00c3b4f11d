"""Service KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.functions.columns import avg, banded, n, pct, ratio, rounded, share_of_total
from ledgerline.plans.registry import query
from ledgerline.sources.warehouse import Star


MIN_COMPLAINTS = 50


def csat() -> F.Column:
    return avg("csat_score", 2).alias("avg_csat")


def hours() -> F.Column:
    return avg("resolution_time_hours", 1).alias("avg_hours")


def escalated() -> F.Column:
    return F.count_if("escalation_flag")


def escalation() -> F.Column:
    return pct(escalated(), n()).alias("escalation_pct")


def complaints() -> F.Column:
    return n().alias("complaints")


@query
def svc_overview(s: Star) -> DataFrame:
    resolved = F.count_if(F.col("status") == "Resolved")
    return s.fact_service_logs.agg(
        complaints(), F.count_distinct("customer_id").alias("customers"), csat(), hours(), escalated().alias("escalated"),
        escalation(), resolved.alias("resolved"), pct(resolved, n()).alias("resolution_pct"),
    )


@query
def svc_by_tier_category(s: Star) -> DataFrame:
    cards = s.dim_customer.select("customer_id", "card_category")
    found = s.fact_service_logs.join(cards, "customer_id").groupBy("card_category", "complaint_category").agg(
        complaints(), csat(), hours()
    )
    return share_of_total(found, "complaints", "share_of_tier_pct", "card_category")


@query
def svc_sla_buckets(s: Star) -> DataFrame:
    bucket = banded("resolution_time_hours", labels.RESOLUTION_HOURS, closed=True).alias("bucket")
    found = s.fact_service_logs.where("status = 'Resolved'").groupBy(bucket).agg(complaints())
    return share_of_total(found, "complaints", "share_pct")


@query
def svc_csat_histogram(s: Star) -> DataFrame:
    found = s.fact_service_logs.where("csat_score is not null").groupBy("csat_score").agg(complaints())
    return share_of_total(found, "complaints", "share_pct")


@query
def svc_escalation_drivers(s: Star) -> DataFrame:
    found = s.fact_service_logs.groupBy("complaint_category", "channel").agg(
        complaints(), escalated().alias("escalated"), escalation(), hours(), csat()
    )
    order = [F.col("escalation_pct").desc(), "complaint_category", "channel"]
    return found.where(F.col("complaints") > MIN_COMPLAINTS).orderBy(*order).limit(10)


@query
def svc_churn_link(s: Star) -> DataFrame:
    """Tickets are summed up by customer first; customers without tickets count with none."""
    mine = s.fact_service_logs.groupBy("customer_id").agg(
        n().alias("n"), F.sum("csat_score").alias("csat"), F.count("csat_score").alias("csat_n"),
        F.sum("resolution_time_hours").alias("hours"), F.count("resolution_time_hours").alias("hours_n"),
        escalated().alias("escalated"),
    )
    all_ = s.dim_customer.select("customer_id", "customer_status").join(mine, "customer_id", "left")
    of = lambda a, b, digits: rounded(ratio(F.sum(a), F.sum(b)), digits)
    return all_.groupBy("customer_status").agg(
        n().alias("customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("complaints"),
        rounded(ratio(F.coalesce(F.sum("n"), F.lit(0)), n()), 2).alias("per_customer"),
        of("csat", "csat_n", 2).alias("avg_csat"),
        of("hours", "hours_n", 1).alias("avg_hours"),
        pct(F.sum("escalated"), F.sum("n")).alias("escalation_pct"),
    )


@query
def svc_by_channel(s: Star) -> DataFrame:
    found = s.fact_service_logs.groupBy("channel").agg(complaints(), hours(), csat(), escalation())
    return share_of_total(found, "complaints", "share_pct")


@query
def svc_by_priority(s: Star) -> DataFrame:
    found = s.fact_service_logs.groupBy("priority").agg(complaints(), hours(), csat(), escalation())
    order = F.array_position(F.array(*map(F.lit, ("Critical", "High", "Medium", "Low"))), F.col("priority"))
    return share_of_total(found, "complaints", "share_pct").orderBy(order)
