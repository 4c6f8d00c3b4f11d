"""Transforms in SQL."""

from __future__ import annotations

from ledgerline.oracle.checks import UNION, orphan
from ledgerline.oracle.star import d, mean, r

POOL = ("Ada", "Ben", "Cleo", "Dov", "Eli", "Fay", "Gus")
WEIGHT = r("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()", 6)
FEATURES = (
    "age", "customer_tenure_months", "total_products_held", "credit_utilization_ratio", "months_inactive_12m",
    "contacts_count_12m", "total_trans_amt_12m", "total_trans_ct_12m", "amt_change_q4_q1", "ct_change_q4_q1",
)
SEGMENT = (
    "total_trans_amt_12m", "total_trans_ct_12m", "customer_tenure_months", "credit_utilization_ratio",
    "total_products_held", "avg_csat", "campaign_engagements",
)


def quartile(share: float) -> str:
    """Interpolated between the amounts at two whole places, each by its place within its bin."""
    place = f"((total - 1) * {share})"

    def at(k: str) -> str:
        inside = f"CAST({k} - before AS DOUBLE) / greatest(k - 1, 1)"
        return f"max(CASE WHEN before <= {k} AND {k} < before + k THEN lo + (hi - lo) * {inside} END)"

    low, high = at(f"floor({place})"), at(f"ceil({place})")
    return r(f"{low} + ({high} - {low}) * max({place} - floor({place}))", 6)


def weights(part: str, name: str, source: str) -> str:
    return f"SELECT {part} AS {name}, count(*) AS transactions, {WEIGHT} AS weight FROM {source} GROUP BY 1"


BODIES: dict[str, str] = {
    "dim_date": "SELECT * FROM dim_date WHERE date_key IN (SELECT date_key FROM fact_transactions)",
    "dim_date_calendar": "SELECT * FROM dim_date",
    "map_categories": """SELECT income_bracket, CASE income_bracket WHEN 'AUTOMOBILE' THEN 'Above' WHEN 'BUILDING' THEN 'Upper'
 WHEN 'FURNITURE' THEN 'Middle' WHEN 'HOUSEHOLD' THEN 'Lower' ELSE 'Unmapped' END AS label, count(*) AS customers
 FROM dim_customer GROUP BY 1, 2""",
    "sentinel_to_null": "SELECT nullif(income_bracket, 'MACHINERY') AS income_bracket, count(*) AS customers FROM dim_customer GROUP BY 1",
    "scale_money": """SELECT customer_id, CAST(credit_limit * 83 AS DOUBLE) AS scaled,
 CAST(floor((credit_limit * 83 + 50) / 100) * 100 AS DOUBLE) AS hundreds FROM dim_customer""",
    "customer_since": """SELECT customer_id, CAST(DATE '2001-11-04' - to_months(CAST(customer_tenure_months AS INT)) AS DATE) AS since
 FROM dim_customer""",
    "risk_category": """SELECT customer_id, CASE
 WHEN customer_status = 'Churned' OR (credit_utilization_ratio > 0.8 AND months_inactive_12m > 3) THEN 'High'
 WHEN credit_utilization_ratio > 0.5 OR months_inactive_12m > 2 THEN 'Medium' ELSE 'Low' END AS risk FROM dim_customer""",
    "pct_rank_avg": f"""SELECT customer_id, CASE WHEN customer_tenure_months IS NOT NULL THEN
 {r('(rank() OVER (ORDER BY customer_tenure_months) + (count(*) OVER (PARTITION BY customer_tenure_months) - 1) / 2.0) / count(customer_tenure_months) OVER ()', 9)}
 END AS pct_rank FROM dim_customer""",
    "card_tier": f"SELECT customer_id, {r('card_score', 6)} AS score, card_category FROM dim_customer",
    "products_held": """SELECT customer_id, least(6, 1 + CAST(income_bracket IN ('AUTOMOBILE', 'BUILDING') AS INT)
 + coalesce(CAST(spend_pct > 0.6 AS INT), 0) + coalesce(CAST(spend_pct > 0.9 AS INT), 0)
 + coalesce(CAST(tenure_pct > 0.6 AS INT), 0) + CAST(card_category IN ('Gold', 'Platinum') AS INT)) AS held FROM dim_customer""",
    "hash_name": f"""SELECT customer_id, ([{', '.join(f"'{p}'" for p in POOL)}])[1 + CAST(CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8) AS BIGINT) % {len(POOL)} AS INT)] AS name
 FROM dim_customer""",
    "campaign_audience": UNION.join(
        f"SELECT {i} AS campaign_id, customer_id, {r(score, 4)} AS base_score FROM dim_customer WHERE {rule}"
        for i, rule, score in (
            (1, "credit_utilization_ratio > 0.7", "greatest(0.05, 0.40 - months_inactive_12m * 0.05)"),
            (2, "card_category = 'Blue' AND income_bracket IN ('AUTOMOBILE', 'BUILDING')", "0.25"),
            (3, "months_inactive_12m >= 3", "greatest(0.05, 0.30 - months_inactive_12m * 0.03)"),
            (4, "total_products_held <= 2 AND income_bracket NOT IN ('FURNITURE')", "0.15"),
            (5, "customer_tenure_months >= 36 AND customer_status = 'Active'", "0.35"),
        )
    ),
    "flag_high_value": """SELECT merchant_category, count(*) AS transactions, count(*) FILTER (WHERE is_high_value) AS high_value
 FROM fact_transactions GROUP BY 1""",
    "reconcile_load": f"""SELECT count(*) AS customers, count(*) FILTER (WHERE abs(total_trans_amt_12m - coalesce(a, 0)) <= 1) AS reconciled,
 count(*) FILTER (WHERE total_trans_ct_12m = coalesce(k, 0)) AS counts_equal,
 {r("CAST(count(*) FILTER (WHERE abs(total_trans_amt_12m - coalesce(a, 0)) <= 1) AS DOUBLE) * 100.0 / count(*)")} AS reconciled_pct
 FROM dim_customer LEFT JOIN (SELECT customer_id, sum(amount) AS a, count(*) AS k FROM fact_transactions GROUP BY 1)
 USING (customer_id)""",
    "profile_categories": f"SELECT merchant_category, count(*) AS transactions, {WEIGHT} AS proportion FROM fact_transactions GROUP BY 1",
    "profile_amounts": f"""SELECT merchant_category, {r(mean('amount'), 6)} AS mean, {r('stddev_samp(CAST(amount AS DOUBLE))', 4)} AS std,
 {d('min(amount)')} AS min, {r(f"quantile_cont({d('amount')}, 0.25)", 6)} AS p25, {r(f"quantile_cont({d('amount')}, 0.5)", 6)} AS median,
 {r(f"quantile_cont({d('amount')}, 0.75)", 6)} AS p75, {d('max(amount)')} AS max FROM fact_transactions GROUP BY 1""",
    "profile_hour": weights("hour(ts)", "hour", "events WHERE event_type = 'purchase'"),
    "profile_dow": weights("isodow(transaction_day) - 1", "weekday", "fact_transactions"),
    "profile_month": weights("month(transaction_day)", "month", "fact_transactions"),
    "profile_merchants": """SELECT merchant_category, string_agg(merchant_name, '|' ORDER BY merchant_name) AS merchants, count(*) AS n_merchants
 FROM (SELECT DISTINCT merchant_category, merchant_name FROM fact_transactions
   QUALIFY dense_rank() OVER (PARTITION BY merchant_category ORDER BY merchant_name) <= 10) GROUP BY 1""",
    "profile_batches": f"""SELECT * FROM (WITH bins AS (SELECT merchant_category, {d('min(amount)')} AS lo, {d('max(amount)')} AS hi, count(*) AS k,
   CASE WHEN amount = 0 THEN 0 ELSE sign(amount) * (ceil(ln({d('abs(amount)')}) / ln(1.01)) + 500) END AS bin
   FROM fact_transactions WHERE amount IS NOT NULL GROUP BY 1, 5),
 placed AS (SELECT *, sum(k) OVER (PARTITION BY merchant_category) AS total,
   sum(k) OVER (PARTITION BY merchant_category ORDER BY bin) - k AS before FROM bins),
 quartiles AS (SELECT merchant_category, {quartile(0.25)} AS p25, {quartile(0.5)} AS median, {quartile(0.75)} AS p75 FROM placed GROUP BY 1),
 plain AS (SELECT merchant_category, count(*) AS transactions, {WEIGHT} AS proportion, {r(mean('amount'), 6)} AS mean,
   {r('stddev_samp(CAST(amount AS DOUBLE))', 4)} AS std, {d('min(amount)')} AS min, {d('max(amount)')} AS max
   FROM fact_transactions GROUP BY 1)
 SELECT p.merchant_category AS category, p.* EXCLUDE (merchant_category), p25, median, p75
 FROM plain p LEFT JOIN quartiles q ON p.merchant_category IS NOT DISTINCT FROM q.merchant_category)""",
    "profile_batch_calendar": UNION.join(
        f"SELECT '{name}' AS part, {part} AS value, count(*) AS transactions, {WEIGHT} AS weight FROM fact_transactions GROUP BY 2"
        for name, part in (("weekday", "isodow(transaction_day) - 1"), ("month", "month(transaction_day)"))
    ),
    "orphan_counts_load": UNION.join(
        f"SELECT (SELECT count(*) FROM {t}) AS row_count, {orphan(t, 'customer_id', 'dim_customer')} AS orphans, '{t}' AS table_name"
        for t in ("fact_transactions", "fact_service_logs", "fact_campaign_responses")
    ),
    "export_dims": UNION.join(
        f"""SELECT count(*) AS row_count, count(*) FILTER (WHERE {k} IS NULL) AS null_keys,
 (SELECT count(*) FROM (SELECT {k} FROM {t} GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, '{t}' AS table_name FROM {t}"""
        for t, k in (("dim_product", "product_id"), ("dim_campaign", "campaign_id"))
    ),
    "allocate_total": f"""SELECT customer_id, merchant_category, {d('budget')} AS budget,
 {d("part + CASE WHEN last THEN budget - sum(part) OVER (PARTITION BY customer_id) ELSE 0 END")} AS part FROM (
 SELECT *, CAST({r('CAST(w AS DOUBLE) * (CAST(budget AS DOUBLE) / ws)')} AS DECIMAL(15,2)) AS part FROM (
 SELECT customer_id, merchant_category, w, budget, CAST(sum(w) OVER (PARTITION BY customer_id) AS DOUBLE) AS ws,
   row_number() OVER (PARTITION BY customer_id ORDER BY merchant_category DESC) = 1 AS last
 FROM (SELECT customer_id, merchant_category, sum(amount) AS w FROM fact_transactions GROUP BY 1, 2)
 JOIN (SELECT customer_id, CAST(floor(total_trans_amt_12m * 25 + 0.5) / 100 AS DECIMAL(15,2)) AS budget FROM dim_customer)
 USING (customer_id)))""",
    "ml_churn_features": f"""SELECT customer_id, {', '.join(f'{d(c)} AS {c}' for c in FEATURES)},
 CAST(customer_status = 'Churned' AS INT) AS target FROM dim_customer""",
    "ml_churn_split": """SELECT target, is_train, count(*) AS customers FROM (
 SELECT target, row_number() OVER (PARTITION BY target) <= floor(count(*) OVER (PARTITION BY target) * 0.8) AS is_train
 FROM (SELECT CAST(customer_status = 'Churned' AS INT) AS target FROM dim_customer)) GROUP BY 1, 2""",
    "ml_seg_features": f"""SELECT customer_id, {', '.join(f'{d(c)} AS {c}' for c in SEGMENT)} FROM (
 SELECT c.*, coalesce(csat, 3) AS avg_csat, coalesce(won, 0) AS campaign_engagements FROM dim_customer c
 LEFT JOIN (SELECT customer_id, {mean('csat_score')} AS csat FROM fact_service_logs GROUP BY 1) USING (customer_id)
 LEFT JOIN (SELECT customer_id, count(*) AS won FROM fact_campaign_responses WHERE was_accepted GROUP BY 1) USING (customer_id))""",
}
# The seeded products and campaigns (table, id, name, type, first day).
BODIES["seed_dims"] = """SELECT table_name, id, name, kind, since, coalesce(facts, 0) AS facts FROM (VALUES
 ('dim_product', 1, 'Savings Account', 'Savings', '2010-01-01'), ('dim_product', 2, 'Current Account', 'Current', '2010-01-01'),
 ('dim_product', 3, 'Fixed Deposit', 'Term Deposit', '2010-01-01'), ('dim_product', 4, 'Credit Card - Blue', 'Basic', '2012-01-01'),
 ('dim_product', 5, 'Credit Card - Silver', 'Silver', '2012-06-01'), ('dim_product', 6, 'Credit Card - Gold', 'Gold', '2013-01-01'),
 ('dim_product', 7, 'Credit Card - Platinum', 'Platinum', '2014-01-01'), ('dim_product', 8, 'Personal Loan', 'Unsecured', '2011-01-01'),
 ('dim_product', 9, 'Home Loan', 'Secured', '2010-01-01'), ('dim_product', 10, 'Vehicle Loan', 'Secured', '2011-06-01'),
 ('dim_product', 11, 'Health Insurance', 'Health', '2015-01-01'), ('dim_product', 12, 'Mutual Fund SIP', 'Equity', '2016-01-01'),
 ('dim_campaign', 1, 'Credit Limit Upgrade', 'Email', '2024-01-15'), ('dim_campaign', 2, 'Premium Card Upgrade', 'Outbound Call', '2024-04-01'),
 ('dim_campaign', 3, 'Re-engagement Offer', 'SMS', '2024-07-01'), ('dim_campaign', 4, 'Cross-sell Insurance', 'Push Notification', '2024-09-01'),
 ('dim_campaign', 5, 'Loyalty Rewards Program', 'Email', '2024-10-01')) seeds(table_name, id, name, kind, since)
 LEFT JOIN (SELECT 'dim_product' AS t, product_id AS k, count(*) AS facts FROM fact_transactions GROUP BY 2
  UNION ALL SELECT 'dim_campaign', campaign_id, count(*) FROM fact_campaign_responses GROUP BY 2) ON t = table_name AND k = id"""
BODIES["ml_seg_impute_scale"] = UNION.join(
    f"""SELECT '{c}' AS feature, {r(f'avg({c})', 4)} AS mean,
 {r(f'stddev_samp(coalesce({c}, (SELECT avg({c}) FROM ({BODIES["ml_seg_features"]}))))', 4)} AS std
 FROM ({BODIES["ml_seg_features"]})"""
    for c in SEGMENT
)
