"""Lifetime value, churn and RFM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.functions.columns import avg, banded, churn_pct, churned, dbl, mean, n, rounded, share_of_total, tile_label, total
from ledgerline.functions.ranking import with_tile
from ledgerline.functions.tiles import with_tiles
from ledgerline.plans.registry import query
from ledgerline.sources.storage import materialise
from ledgerline.sources.warehouse import Star

SPEND, TENURE = "total_trans_amt_12m", "customer_tenure_months"
#: Months that an active customer is expected to stay.
ACTIVE_MONTHS = 48


def clv_base(floor: int | None) -> Column:
    """Monthly revenue times months times the modifiers for tenure, products, frequency and utilization."""
    monthly = dbl(SPEND) / 12.0
    months = F.when(F.col("customer_status") == "Active", F.lit(float(ACTIVE_MONTHS))).otherwise(dbl(TENURE))
    tenure = F.greatest(F.col(TENURE), F.lit(floor)) if floor is not None else F.col(TENURE)
    return (
        monthly * months * F.pow(dbl(tenure) / 24.0, F.lit(1.5)) * (1.0 + dbl("total_products_held") * 0.1)
        * (1.0 + dbl("total_trans_ct_12m") / 100.0 * 0.1) * (1.0 - dbl("credit_utilization_ratio") * 0.2)
    )


def with_clv(customers: DataFrame) -> DataFrame:
    """customers with estimated_clv in cents, so that sums are exact."""
    return customers.withColumn("estimated_clv", rounded(clv_base(1), 2).cast("decimal(20,2)"))


@query
def clv_historical(s: Star) -> DataFrame:
    return s.dim_customer.groupBy("card_category").agg(
        n().alias("customers"), avg(TENURE, 1).alias("avg_tenure"), total(SPEND, 0).alias("revenue"),
        avg(SPEND, 0).alias("avg_revenue"),
    )


@query
def clv_estimated(s: Star) -> DataFrame:
    return with_clv(s.dim_customer).groupBy("customer_status").agg(
        n().alias("customers"),
        rounded(mean(SPEND) / 12.0, 0).alias("avg_monthly_revenue"),
        avg("estimated_clv", 0).alias("avg_clv"),
        total("estimated_clv", 0).alias("portfolio_value"),
    )


@query
def clv_tiers(s: Star) -> DataFrame:
    tiled = with_tile(s.dim_customer.select("customer_id", SPEND), [F.col(SPEND).desc(), F.col("customer_id")], 3, "tier")
    found = tiled.groupBy("tier").agg(
        n().alias("customers"), F.min(SPEND).alias("min_revenue"), F.max(SPEND).alias("max_revenue"),
        F.sum(SPEND).alias("exact"),
    )
    return share_of_total(found, "exact", "share_pct").select(
        tile_label("tier", labels.VALUE_TIERS).alias("tier"), "customers",
        *(rounded(dbl(c), 0).alias(c) for c in ("min_revenue", "max_revenue")),
        rounded(dbl("exact"), 0).alias("revenue"), "share_pct",
    )


@query
def clv_multi_product(s: Star) -> DataFrame:
    return s.dim_customer.groupBy("total_products_held").agg(
        n().alias("customers"), avg(SPEND, 0).alias("avg_revenue"), avg(TENURE, 1).alias("avg_tenure")
    )


def churn_by(s: Star, key: Column) -> DataFrame:
    return s.dim_customer.groupBy(key).agg(n().alias("customers"), churned().alias("churned"), churn_pct().alias("churn_pct"))


@query
def churn_overall(s: Star) -> DataFrame:
    lost = F.when(F.col("customer_status") == "Churned", F.col(SPEND))
    return s.dim_customer.agg(
        n().alias("customers"), churned().alias("churned"), churn_pct().alias("churn_pct"), total(lost, 0).alias("lost_revenue")
    )


@query
def churn_by_utilization(s: Star) -> DataFrame:
    return churn_by(s, banded("credit_utilization_ratio", labels.UTILIZATION).alias("band"))


@query
def churn_by_inactivity(s: Star) -> DataFrame:
    return churn_by(s, F.col("months_inactive_12m"))


@query
def churn_by_spend_trend(s: Star) -> DataFrame:
    return churn_by(s, banded("amt_change_q4_q1", labels.SPEND_TREND).alias("band"))


def rfm_segment(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> Column:
    found = F
    for label, *bounds in labels.RFM:
        inside = [F.col(c).between(*bound) for c, bound in zip((r, f, m), bounds)]
        found = found.when(inside[0] & inside[1] & inside[2], label)
    return found.otherwise(labels.RFM_OTHER)


@query
def rfm_customer(s: Star) -> DataFrame:
    """Recency, frequency and monetary scores of 1 to 5 for every customer with transactions."""
    known = s.fact_transactions.join(s.dim_customer.select("customer_id"), "customer_id", "left_semi")
    raw = known.groupBy("customer_id").agg(
        F.datediff(F.lit(s.as_of).cast("date"), F.max(F.to_date("transaction_date"))).alias("recency_days"),
        n().alias("frequency"), F.sum("amount").alias("monetary"),
    )
    raw = materialise(raw, "rfm")  # one row a customer, which the search for edges reads several times
    scored = with_tiles(
        raw, {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}, "customer_id", 5
    )
    return scored.withColumn(
        "rfm_cell", F.concat(*(F.col(f"{x}_score").cast("string") for x in "rfm"))
    ).withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score")).withColumn("segment", rfm_segment())


@query
def rfm_segments(s: Star) -> DataFrame:
    found = rfm_customer(s).groupBy("segment").agg(
        n().alias("customers"), avg("recency_days", 0).alias("avg_recency"), avg("frequency", 1).alias("avg_frequency"),
        avg("monetary", 0).alias("avg_monetary"),
    )
    return share_of_total(found, "customers", "share_pct")
