"""Business rules: what the data should show if it is true to life.

A single check reads what it needs. The suite sums up each fact by customer once, puts the sums beside the customers and
takes all measures from that one table; keys and row counts come from the data quality suite's one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import dbl, mean, n, ratio, rounded
from ledgerline.plans.quality import (
    FOREIGN_KEYS, PRIMARY_KEYS, broken_funnel, measured, result, rows_of, scored, suite_rows, union, unpivot,
)
from ledgerline.plans.registry import query
from ledgerline.plans.value import clv_base
from ledgerline.sources.warehouse import Star

#: What counts as a high income in the adapter's data.
HIGH_INCOMES = ("AUTOMOBILE", "BUILDING")
GATE = 90.0
CORRELATIONS = {"spend_limit": 0.1, "products_spend": 0.1, "tenure_products": 0.05, "utilization_churn": 0.05}
CLV_BOUNDS = {"clv_spend": (0.60, 0.85), "clv_tenure": (0.20, 0.50)}


def row(df: DataFrame, check: str, category: str, good: Column, bad: str = "FAIL", critical: bool = False) -> DataFrame:
    """df: one row with detail and what good needs; a null or NaN detail gives bad."""
    status = F.when(F.coalesce(good, F.lit(False)) & ~F.isnan(F.col("detail").cast("double")), "PASS").otherwise(bad)
    return result(df.withColumn("check", F.lit(check)), "business", category, F.lit(""), status, critical)


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation to 6 digits."""
    return rounded(F.corr(a.cast("double"), b.cast("double")), 6)


def churned() -> Column:
    return (F.col("customer_status") == "Churned").cast("int")


def reconciled(s: Star) -> DataFrame:
    actual = s.fact_transactions.groupBy("customer_id").agg(F.sum("amount").alias("sum_amount"), n().alias("count_trans"))
    return s.dim_customer.join(actual, "customer_id", "left").fillna(0, ["count_trans"]).withColumn(
        "sum_amount", F.coalesce("sum_amount", F.lit(0))
    )


@query
def bv_reconcile_amount(s: Star) -> DataFrame:
    """detail: customers whose amounts differ by over half a percent."""
    gap = F.abs(dbl("sum_amount") - dbl("total_trans_amt_12m")) / F.greatest(F.lit(1.0), dbl("total_trans_amt_12m"))
    found = reconciled(s).agg(F.count_if(gap > 0.005).alias("detail"))
    return row(found, "reconcile_amount", "reconciliation", F.col("detail") == 0, critical=True)


@query
def bv_reconcile_count(s: Star) -> DataFrame:
    found = reconciled(s).agg(F.count_if(F.col("count_trans") != F.col("total_trans_ct_12m")).alias("detail"))
    return row(found, "reconcile_count", "reconciliation", F.col("detail") == 0, critical=True)


@query
def bv_correlations(s: Star) -> DataFrame:
    c = F.col
    found = s.dim_customer.agg(
        corr(c("total_trans_amt_12m"), c("credit_limit")).alias("spend_limit"),
        corr(c("total_products_held"), c("total_trans_amt_12m")).alias("products_spend"),
        corr(c("customer_tenure_months"), c("total_products_held")).alias("tenure_products"),
        corr(c("credit_utilization_ratio"), churned()).alias("utilization_churn"),
    )
    rows = unpivot(found, list(CORRELATIONS))
    least = F.create_map(*(F.lit(x) for p in CORRELATIONS.items() for x in p))
    good = F.coalesce(F.col("detail") > F.element_at(least, F.col("check")), F.lit(False))
    status = F.when(good & ~F.isnan("detail"), "PASS").otherwise("WARN")
    found = result(rows, "business", "behaviour", F.lit(""), status)
    return found.withColumn("is_critical", F.col("check") == "utilization_churn")


@query
def bv_csat_complaints(s: Star) -> DataFrame:
    mine = s.fact_service_logs.groupBy("customer_id").agg(mean("csat_score").alias("csat"), n().alias("ct"))
    found = mine.agg(corr(F.col("csat"), F.col("ct")).alias("detail"))
    return row(found, "csat_complaints", "behaviour", F.col("detail") < -0.1, "WARN")


@query
def bv_campaign_retention(s: Star) -> DataFrame:
    mine = s.fact_campaign_responses.groupBy("customer_id").agg(F.count_if("was_accepted").alias("accepted"))
    all_ = s.dim_customer.join(mine, "customer_id", "left").fillna(0, ["accepted"])
    found = all_.agg(corr(F.col("accepted"), 1 - churned()).alias("detail"))
    return row(found, "campaign_retention", "behaviour", F.col("detail") > 0.01, "WARN")


@query
def bv_churn_means(s: Star) -> DataFrame:
    """detail: churned customers' mean less that of active ones."""
    of = lambda c, status: mean(F.when(F.col("customer_status") == status, F.col(c)))
    gap = lambda c: rounded(of(c, "Churned") - of(c, "Active"), 4).alias("detail")
    spend = s.dim_customer.agg(gap("total_trans_amt_12m"))
    idle = s.dim_customer.agg(gap("months_inactive_12m"))
    return row(spend, "declining_spend", "churn", F.col("detail") < 0).unionByName(
        row(idle, "higher_inactivity", "churn", F.col("detail") > 0, critical=True)
    )


@query
def bv_premium_income(s: Star) -> DataFrame:
    premium = s.dim_customer.where(F.col("card_category").isin("Gold", "Platinum"))
    found = premium.agg(rounded(ratio(F.count_if(F.col("income_bracket").isin(*HIGH_INCOMES)), n()), 6).alias("detail"))
    return row(found, "premium_income", "products", F.col("detail") > 0.4, "WARN")


@query
def bv_campaign2_targeting(s: Star) -> DataFrame:
    incomes = s.dim_customer.select("customer_id", "income_bracket")
    second = s.fact_campaign_responses.where("campaign_id = 2").join(incomes, "customer_id")
    found = second.agg(rounded(ratio(F.count_if(F.col("income_bracket").isin(*HIGH_INCOMES)), n()), 6).alias("detail"))
    return row(found, "campaign2_targeting", "campaigns", F.col("detail") > 0.9)


@query
def bv_funnel(s: Star) -> DataFrame:
    found = s.fact_campaign_responses.agg(F.count_if(broken_funnel()).alias("detail"))
    return row(found, "funnel", "campaigns", F.col("detail") == 0, critical=True)


@query
def bv_service_metrics(s: Star) -> DataFrame:
    """Reported, not judged: mean hours and mean csat."""
    found = s.fact_service_logs.agg(
        rounded(mean("resolution_time_hours"), 4).alias("avg_hours"), rounded(mean("csat_score"), 4).alias("avg_csat")
    )
    return result(unpivot(found, ["avg_hours", "avg_csat"]), "business", "service", F.lit(""), F.lit("PASS"))


@query
def bv_csat_churn(s: Star) -> DataFrame:
    status = s.dim_customer.select("customer_id", "customer_status")
    of = lambda x: mean(F.when(F.col("customer_status") == x, F.col("csat_score")))
    found = s.fact_service_logs.join(status, "customer_id").agg(rounded(of("Churned") - of("Active"), 4).alias("detail"))
    return row(found, "csat_churn", "service", F.col("detail") < 0, critical=True)


@query
def bv_revenue_total(s: Star) -> DataFrame:
    """detail: stored totals less the sum of the facts."""
    stored = s.dim_customer.agg(F.sum("total_trans_amt_12m").alias("a"))
    facts = s.fact_transactions.agg(F.sum("amount").alias("b"))
    found = stored.crossJoin(facts).select((F.col("a") - F.col("b")).cast("double").alias("detail"))  # one row each
    return row(found, "revenue_total", "revenue", F.abs("detail") <= 1.0, critical=True)


@query
def bv_clv_correlation(s: Star) -> DataFrame:
    """The lifetime value of this check has no floor on the tenure and a factor of average csat over 3."""
    csat = s.fact_service_logs.groupBy("customer_id").agg(mean("csat_score").alias("csat"))
    valued = s.dim_customer.join(csat, "customer_id", "left").withColumn(
        "clv", clv_base(None) * F.coalesce("csat", F.lit(3.0)) / 3.0
    )
    found = valued.agg(
        corr(F.col("total_trans_amt_12m"), F.col("clv")).alias("clv_spend"),
        corr(F.col("customer_tenure_months"), F.col("clv")).alias("clv_tenure"),
    )
    inside = [F.col(c).between(*bounds) & ~F.isnan(c) for c, bounds in CLV_BOUNDS.items()]
    both = found.withColumn("inside", inside[0] & inside[1])
    rows = both.unpivot(["inside"], list(CLV_BOUNDS), "check", "detail")
    return result(rows, "business", "clv", F.lit(""), F.when(F.col("inside"), "PASS").otherwise("FAIL"))


@query
def bv_warehouse_integrity(s: Star) -> DataFrame:
    """Orphans and duplicate keys, from the data quality suite. detail: failed checks."""
    failed = suite_rows(s, "foreign_key", "primary_key").where("status = 'FAIL'")
    of = lambda category: F.count_if(F.col("category") == category).cast("double")
    found = failed.agg(of("foreign_key").alias("star_schema"), of("primary_key").alias("duplicate_keys"))
    rows = unpivot(found, ["star_schema", "duplicate_keys"])
    status = F.when(F.col("detail") == 0, "PASS").otherwise("FAIL")
    return result(rows, "business", "warehouse", F.lit(""), status).withColumn("is_critical", F.col("check") == "star_schema")


#: The tables that dashboards need.
READY = ("dim_customer", "dim_product", "dim_campaign", "dim_date", "fact_transactions")


@query
def bv_tables_ready(s: Star) -> DataFrame:
    """The tables that dashboards need have rows. detail: rows."""
    s.derive(*READY)
    return union([
        row(getattr(s, t).agg(n().alias("detail")), f"ready_{t}", "dashboards", F.col("detail") > 0, critical=True) for t in READY
    ])


def beside(s: Star) -> DataFrame:
    """The customers with what each fact says of them, and the facts' customers that there are not (known is null)."""
    sales = s.fact_transactions.groupBy("customer_id").agg(F.sum("amount").alias("sum_amount"), n().alias("count_trans"))
    tickets = s.fact_service_logs.groupBy("customer_id").agg(
        F.sum("csat_score").alias("csat_sum"), F.count("csat_score").alias("csat_ct"), n().alias("tickets"),
        F.sum("resolution_time_hours").alias("hours_sum"), F.count("resolution_time_hours").alias("hours_ct"),
    )
    answers = s.fact_campaign_responses.groupBy("customer_id").agg(
        F.count_if("was_accepted").alias("accepted"), F.count_if(F.col("campaign_id") == 2).alias("second"),
        F.count_if(broken_funnel()).alias("broken"),
    )
    people = s.dim_customer.withColumn("known", F.lit(True))
    return people.join(sales, "customer_id", "full").join(tickets, "customer_id", "full").join(answers, "customer_id", "full")


def judged(s: Star) -> DataFrame:
    """One row with the detail of every check but those on keys and rows, from one pass over beside."""
    c, known = F.col, F.col("known")
    of = lambda x: F.when(known, x)
    amount, count = F.coalesce("sum_amount", F.lit(0)), F.coalesce("count_trans", F.lit(0))
    gap = F.abs(amount.cast("double") - dbl("total_trans_amt_12m")) / F.greatest(F.lit(1.0), dbl("total_trans_amt_12m"))
    gone, csat = of(churned()), ratio(c("csat_sum"), c("csat_ct"))
    clv = of(clv_base(None) * F.coalesce(csat, F.lit(3.0)) / 3.0)
    part = lambda name, status: mean(F.when(known & (c("customer_status") == status), c(name)))
    less = lambda name: rounded(part(name, "Churned") - part(name, "Active"), 4)
    rich, premium = c("income_bracket").isin(*HIGH_INCOMES), c("card_category").isin("Gold", "Platinum")
    score = lambda status: ratio(*(F.sum(F.when(known & (c("customer_status") == status), c(x))) for x in ("csat_sum", "csat_ct")))
    return beside(s).agg(
        F.count_if(known & (gap > 0.005)).alias("reconcile_amount"),
        F.count_if(known & (count != c("total_trans_ct_12m"))).alias("reconcile_count"),
        corr(of(c("total_trans_amt_12m")), c("credit_limit")).alias("spend_limit"),
        corr(of(c("total_products_held")), c("total_trans_amt_12m")).alias("products_spend"),
        corr(of(c("customer_tenure_months")), c("total_products_held")).alias("tenure_products"),
        corr(of(c("credit_utilization_ratio")), churned()).alias("utilization_churn"),
        corr(F.when(c("tickets").isNotNull(), csat), c("tickets")).alias("csat_complaints"),
        corr(of(F.coalesce("accepted", F.lit(0))), 1 - gone).alias("campaign_retention"),
        less("total_trans_amt_12m").alias("declining_spend"),
        less("months_inactive_12m").alias("higher_inactivity"),
        rounded(ratio(F.count_if(known & premium & rich), F.count_if(known & premium)), 6).alias("premium_income"),
        rounded(ratio(F.sum(F.when(known & rich, c("second"))), F.sum(of(c("second")))), 6).alias("campaign2_targeting"),
        rows_of("broken").alias("funnel"),
        rounded(ratio(F.sum("hours_sum"), F.sum("hours_ct")), 4).alias("avg_hours"),
        rounded(ratio(F.sum("csat_sum"), F.sum("csat_ct")), 4).alias("avg_csat"),
        rounded(score("Churned") - score("Active"), 4).alias("csat_churn"),
        (F.sum(of(c("total_trans_amt_12m"))) - F.sum("sum_amount")).cast("double").alias("revenue_total"),
        corr(of(c("total_trans_amt_12m")), clv).alias("clv_spend"),
        corr(of(c("customer_tenure_months")), clv).alias("clv_tenure"),
    )


def business_suite(s: Star) -> DataFrame:
    """All checks, from two one-row tables."""
    keys = measured(s).select(
        sum((F.col(f"fk__{i}") > 0).cast("long") for i in range(len(FOREIGN_KEYS))).alias("star_schema"),
        sum((F.col(f"dup__{t}") > 0).cast("long") for t in PRIMARY_KEYS).alias("duplicate_keys"),
        *(F.col(f"{t}__rows").alias(f"ready_{t}") for t in READY),
    )
    c = F.col
    over = lambda name, least: c(name) > least
    inside = c("clv_spend").between(*CLV_BOUNDS["clv_spend"]) & c("clv_tenure").between(*CLV_BOUNDS["clv_tenure"])
    inside &= ~F.isnan("clv_spend") & ~F.isnan("clv_tenure")
    rules = [
        ("reconcile_amount", "reconciliation", c("reconcile_amount") == 0, "FAIL", True),
        ("reconcile_count", "reconciliation", c("reconcile_count") == 0, "FAIL", True),
        *((name, "behaviour", over(name, least), "WARN", name == "utilization_churn") for name, least in CORRELATIONS.items()),
        ("csat_complaints", "behaviour", c("csat_complaints") < -0.1, "WARN", False),
        ("campaign_retention", "behaviour", over("campaign_retention", 0.01), "WARN", False),
        ("declining_spend", "churn", c("declining_spend") < 0, "FAIL", False),
        ("higher_inactivity", "churn", over("higher_inactivity", 0), "FAIL", True),
        ("premium_income", "products", over("premium_income", 0.4), "WARN", False),
        ("campaign2_targeting", "campaigns", over("campaign2_targeting", 0.9), "FAIL", False),
        ("funnel", "campaigns", c("funnel") == 0, "FAIL", True),
        ("avg_hours", "service", F.lit(True), "PASS", False), ("avg_csat", "service", F.lit(True), "PASS", False),
        ("csat_churn", "service", c("csat_churn") < 0, "FAIL", True),
        ("revenue_total", "revenue", F.abs("revenue_total") <= 1.0, "FAIL", True),
        ("clv_spend", "clv", inside, "FAIL", False), ("clv_tenure", "clv", inside, "FAIL", False),
        ("star_schema", "warehouse", c("star_schema") == 0, "FAIL", True),
        ("duplicate_keys", "warehouse", c("duplicate_keys") == 0, "FAIL", False),
        *((f"ready_{t}", "dashboards", over(f"ready_{t}", 0), "FAIL", True) for t in READY),
    ]

    def one(name: str, category: str, good: Column, bad: str, critical: bool) -> Column:
        holds = F.coalesce(good, F.lit(False)) & ~F.isnan(F.coalesce(c(name).cast("double"), F.lit(0.0)))
        return F.struct(
            F.lit("business").alias("suite"), F.lit(category).alias("category"), F.lit("").alias("table"), F.lit(name).alias("check"),
            F.when(holds, "PASS").otherwise(bad).alias("status"), c(name).cast("double").alias("detail"),
            F.lit(critical).alias("is_critical"),
        )

    return judged(s).crossJoin(keys).select(F.inline(F.array(*(one(*rule) for rule in rules))))  # one row each


#: The checks as single queries.
JOBS = (
    bv_reconcile_amount, bv_reconcile_count, bv_correlations, bv_csat_complaints, bv_campaign_retention, bv_churn_means,
    bv_premium_income, bv_campaign2_targeting, bv_funnel, bv_service_metrics, bv_csat_churn, bv_revenue_total,
    bv_clv_correlation, bv_warehouse_integrity, bv_tables_ready,
)


@query
def bv_summary(s: Star) -> DataFrame:
    return scored(business_suite(s), GATE)


@query
def bv_categories(s: Star) -> DataFrame:
    """Each category's worst status."""
    worst = F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "WARN"), "WARN")
    return business_suite(s).groupBy("category").agg(n().alias("checks"), worst.otherwise("PASS").alias("status"))
