"""Data-quality and business checks in SQL."""

from __future__ import annotations

from ledgerline.oracle.kpi import COUNT_IF, SHARE
from ledgerline.oracle.star import d, mean, r

TABLES = (
    "dim_date", "dim_customer", "dim_product", "dim_campaign", "fact_transactions", "fact_service_logs",
    "fact_campaign_responses",
)
UNION = "\nUNION ALL\n"
FUNNEL = "(was_accepted AND NOT was_clicked) OR (was_clicked AND NOT was_opened) OR (was_opened AND NOT was_contacted)"
HIGH = "income_bracket IN ('AUTOMOBILE', 'BUILDING')"


def orphan(child: str, key: str, parent: str) -> str:
    return f"(SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key}))"


def duplicate(table: str, key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY 1 HAVING count(*) > 1))"


def count(table: str, rule: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {rule})"


def rows(suite: str, checks: list[tuple], columns: str = "*") -> str:
    """checks: category, table, name, scalar, status given detail, critical"""
    parts = [
        f"""SELECT '{suite}' AS suite, '{category}' AS category, '{table}' AS "table", '{name}' AS "check",
 {status} AS status, detail, {critical} AS is_critical FROM (SELECT CAST({value} AS DOUBLE) AS detail)"""
        for category, table, name, value, status, critical in checks
    ]
    return UNION.join(parts)


def judged(good: str, bad: str = "FAIL") -> str:
    return f"CASE WHEN {good} THEN 'PASS' ELSE '{bad}' END"


ZERO, ZERO_WARN = judged("detail = 0"), judged("detail = 0", "WARN")
# Least rows of a table, keys, columns without nulls, and references (table, key, parent).
MINIMUM = {
    "dim_customer": 10000, "dim_product": 10, "dim_campaign": 5, "dim_date": 2000, "fact_transactions": 100000,
    "fact_service_logs": 5000, "fact_campaign_responses": 1000,
}
KEYS = {"dim_customer": "customer_id", "dim_product": "product_id", "dim_campaign": "campaign_id", "dim_date": "date_key"}
NULLS = {
    "dim_customer": (
        "customer_id", "customer_status", "age", "gender", "income_bracket", "card_category", "credit_limit", "total_trans_amt_12m",
    ),
    "fact_transactions": ("customer_id", "amount", "transaction_day:transaction_date", "merchant_category"),
    "fact_service_logs": ("customer_id", "complaint_date", "complaint_category", "priority"),
    "fact_campaign_responses": ("campaign_id", "customer_id", "was_contacted"),
}
FOREIGN = (
    ("fact_transactions", "customer_id", "dim_customer"), ("fact_transactions", "product_id", "dim_product"),
    ("fact_transactions", "date_key", "dim_date"), ("fact_service_logs", "customer_id", "dim_customer"),
    ("fact_service_logs", "date_key", "dim_date"), ("fact_campaign_responses", "customer_id", "dim_customer"),
    ("fact_campaign_responses", "campaign_id", "dim_campaign"), ("fact_campaign_responses", "date_key", "dim_date"),
)


def null_checks() -> list[tuple]:
    status = "CASE WHEN detail = 0 THEN 'PASS' WHEN detail < 5 THEN 'WARN' ELSE 'FAIL' END"
    found = []
    for table, columns in NULLS.items():
        for c in columns:
            real, _, name = c.partition(":")
            share = f"(SELECT coalesce(count(*) FILTER (WHERE {real} IS NULL) * 100.0 / nullif(count(*), 0), 0) FROM {table})"
            found.append(("nulls", table, f"null_{name or real}", r(share, 4), status, "false"))
    return found


DQ = {
    "tables": [("table", t, "table_exists", "0", ZERO, "true") for t in TABLES],
    "minimum": [("row_count", t, "row_count", f"(SELECT count(*) FROM {t})", judged(f"detail >= {m}", "WARN"), "false") for t, m in MINIMUM.items()],
    "keys": [("primary_key", t, f"pk_{k}", duplicate(t, k), ZERO, "false") for t, k in KEYS.items()],
    "nulls": null_checks(),
    "foreign": [("foreign_key", c, f"fk_{k}", orphan(c, k, p), ZERO, "false") for c, k, p in FOREIGN],
    "ranges": [
        ("range", "dim_customer", "age_range", count("dim_customer", "age NOT BETWEEN 18 AND 100"), ZERO, "false"),
        ("range", "dim_customer", "valid_status", count("dim_customer", "customer_status NOT IN ('Active', 'Churned')"), ZERO, "false"),
        ("range", "fact_service_logs", "csat_range", count("fact_service_logs", "csat_score NOT BETWEEN 1 AND 5"), ZERO, "false"),
        ("range", "fact_transactions", "positive_amounts", count("fact_transactions", "amount <= 0"), ZERO, "false"),
    ],
    "funnel": [("business_rule", "fact_campaign_responses", "funnel_logic", count("fact_campaign_responses", FUNNEL), ZERO, "false")],
    "future": [("temporal", "fact_transactions", "no_future_dates", count("fact_transactions", "transaction_day > DATE '2001-11-04'"), ZERO_WARN, "false")],
}


def summary(checks: str, gate: int) -> str:
    return f"""SELECT *, score >= {gate} AND critical_failures = 0 AS ready FROM (
 SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'FAIL') AS passed,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARN') AS warnings,
 count(*) FILTER (WHERE status = 'FAIL' AND is_critical) AS critical_failures,
 {r("CAST(count(*) FILTER (WHERE status <> 'FAIL') AS DOUBLE) * 100.0 / nullif(count(*), 0)")} AS score FROM ({checks}))"""


def scalar(expression: str, source: str) -> str:
    return f"(SELECT {expression} FROM {source})"


def corr(a: str, b: str, source: str) -> str:
    return scalar(r(f"corr({d(a)}, {d(b)})", 6), source)


def status_gap(c: str, digits: int, source: str) -> str:
    of = lambda s: mean(f"CASE WHEN customer_status = '{s}' THEN {c} END")
    return scalar(r(f"{of('Churned')} - {of('Active')}", digits), source)


GONE = "CAST(customer_status = 'Churned' AS INT)"
RECONCILED = """(SELECT c.*, coalesce(a, 0) AS sum_amount, coalesce(n, 0) AS count_trans FROM dim_customer c LEFT JOIN
 (SELECT customer_id, sum(amount) AS a, count(*) AS n FROM fact_transactions GROUP BY 1) USING (customer_id))"""
TICKETS = f"(SELECT customer_id, {mean('csat_score')} AS csat, count(*) AS ct FROM fact_service_logs GROUP BY 1)"
ACCEPTED = f"""(SELECT c.*, coalesce(accepted, 0) AS accepted FROM dim_customer c LEFT JOIN
 (SELECT customer_id, {COUNT_IF('accepted')} AS accepted FROM fact_campaign_responses GROUP BY 1) USING (customer_id))"""
CLV = """CAST(total_trans_amt_12m AS DOUBLE) / CAST(12 AS DOUBLE)
 * CASE WHEN customer_status = 'Active' THEN 48 ELSE customer_tenure_months END
 * power(CAST(customer_tenure_months AS DOUBLE) / 24, 1.5) * (1 + total_products_held * CAST(0.1 AS DOUBLE))
 * (1 + CAST(total_trans_ct_12m AS DOUBLE) / 100 * CAST(0.1 AS DOUBLE))
 * (1 - credit_utilization_ratio * CAST(0.2 AS DOUBLE)) * coalesce(csat, 3) / 3"""
VALUED = f"(SELECT c.*, {CLV} AS clv FROM dim_customer c LEFT JOIN {TICKETS} USING (customer_id))"
IN_CAMPAIGN_2 = "(SELECT * FROM fact_campaign_responses JOIN dim_customer USING (customer_id) WHERE campaign_id = 2)"
PREMIUM = "(SELECT * FROM dim_customer WHERE card_category IN ('Gold', 'Platinum'))"
HIGH_SHARE = r(f"CAST(count(*) FILTER (WHERE {HIGH}) AS DOUBLE) / nullif(count(*), 0)", 6)
CLV_SPEND, CLV_TENURE = (corr(c, "clv", VALUED) for c in ("total_trans_amt_12m", "customer_tenure_months"))
CLV_INSIDE = judged(f"{CLV_SPEND} BETWEEN 0.60 AND 0.85 AND {CLV_TENURE} BETWEEN 0.20 AND 0.50")
FAILED = lambda key: f"(SELECT count(*) FROM ({rows('dq', DQ[key])}) WHERE status = 'FAIL')"
READY = ("dim_customer", "dim_product", "dim_campaign", "dim_date", "fact_transactions")

#: name -> rows: category, table, check, value, status, critical
BUSINESS: dict[str, list[tuple]] = {
    "bv_reconcile_amount": [("reconciliation", "", "reconcile_amount", count(RECONCILED, f"abs({d('sum_amount')} - {d('total_trans_amt_12m')}) / greatest(1.0, {d('total_trans_amt_12m')}) > 0.005"), ZERO, "true")],
    "bv_reconcile_count": [("reconciliation", "", "reconcile_count", count(RECONCILED, "count_trans <> total_trans_ct_12m"), ZERO, "true")],
    "bv_correlations": [
        ("behaviour", "", "spend_limit", corr("total_trans_amt_12m", "credit_limit", "dim_customer"), judged("detail > 0.1", "WARN"), "false"),
        ("behaviour", "", "products_spend", corr("total_products_held", "total_trans_amt_12m", "dim_customer"), judged("detail > 0.1", "WARN"), "false"),
        ("behaviour", "", "tenure_products", corr("customer_tenure_months", "total_products_held", "dim_customer"), judged("detail > 0.05", "WARN"), "false"),
        ("behaviour", "", "utilization_churn", corr("credit_utilization_ratio", GONE, "dim_customer"), judged("detail > 0.05", "WARN"), "true"),
    ],
    "bv_csat_complaints": [("behaviour", "", "csat_complaints", corr("csat", "ct", TICKETS), judged("detail < -0.1", "WARN"), "false")],
    "bv_campaign_retention": [("behaviour", "", "campaign_retention", corr("accepted", f"1 - {GONE}", ACCEPTED), judged("detail > 0.01", "WARN"), "false")],
    "bv_churn_means": [
        ("churn", "", "declining_spend", status_gap("total_trans_amt_12m", 4, "dim_customer"), judged("detail < 0"), "false"),
        ("churn", "", "higher_inactivity", status_gap("months_inactive_12m", 4, "dim_customer"), judged("detail > 0"), "true"),
    ],
    "bv_premium_income": [("products", "", "premium_income", scalar(HIGH_SHARE, PREMIUM), judged("detail > 0.4", "WARN"), "false")],
    "bv_campaign2_targeting": [("campaigns", "", "campaign2_targeting", scalar(HIGH_SHARE, IN_CAMPAIGN_2), judged("detail > 0.9"), "false")],
    "bv_funnel": [("campaigns", "", "funnel", count("fact_campaign_responses", FUNNEL), ZERO, "true")],
    "bv_service_metrics": [
        ("service", "", "avg_hours", scalar(r(mean("resolution_time_hours"), 4), "fact_service_logs"), "'PASS'", "false"),
        ("service", "", "avg_csat", scalar(r(mean("csat_score"), 4), "fact_service_logs"), "'PASS'", "false"),
    ],
    "bv_csat_churn": [("service", "", "csat_churn", status_gap("csat_score", 4, "fact_service_logs JOIN dim_customer USING (customer_id)"), judged("detail < 0"), "true")],
    "bv_revenue_total": [("revenue", "", "revenue_total", "((SELECT sum(total_trans_amt_12m) FROM dim_customer) - (SELECT sum(amount) FROM fact_transactions))", judged("abs(detail) <= 1.0"), "true")],
    "bv_clv_correlation": [("clv", "", "clv_spend", CLV_SPEND, CLV_INSIDE, "false"), ("clv", "", "clv_tenure", CLV_TENURE, CLV_INSIDE, "false")],
    "bv_warehouse_integrity": [
        ("warehouse", "", "star_schema", FAILED("foreign"), ZERO, "true"), ("warehouse", "", "duplicate_keys", FAILED("keys"), ZERO, "false"),
    ],
    "bv_tables_ready": [("dashboards", "", f"ready_{t}", f"(SELECT count(*) FROM {t})", judged("detail > 0"), "true") for t in READY],
}
ALL_BUSINESS = rows("business", [c for checks in BUSINESS.values() for c in checks])


def value_range(table: str, c: str, digits: int, bad: str, median: bool = True) -> str:
    middle = f"{r(f'quantile_cont({d(c)}, 0.5)', 4)} AS median_val," if median else ""
    return f"""SELECT CAST(min({c}) AS DOUBLE) AS min_val, CAST(max({c}) AS DOUBLE) AS max_val,
 {r(mean(c), digits)} AS avg_val, {middle} count(*) FILTER (WHERE {bad}) AS invalid FROM {table}"""


def duplicates(table: str, key: str) -> str:
    return f"SELECT {key}, count(*) AS occurrences FROM {table} GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10"


NULL_COLUMNS = (
    "customer_id", "age", "gender", "income_bracket", "customer_status", "card_category", "credit_limit", "total_trans_amt_12m",
)
GAP = "abs(total_trans_amt_12m - sum_amount)"

BODIES: dict[str, str] = {
    "dq_row_counts": UNION.join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    "dq_null_counts": "SELECT count(*) AS total, count(*) AS null_education_level, count(*) AS null_marital_status, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in NULL_COLUMNS) + " FROM dim_customer",
    "dq_dup_customer": duplicates("dim_customer", "customer_id"),
    "dq_dup_product": duplicates("dim_product", "product_id"),
    "dq_fk_txn_customer": f"SELECT {orphan('fact_transactions', 'customer_id', 'dim_customer')} AS orphan_records",
    "dq_fk_txn_product": f"SELECT {orphan('fact_transactions', 'product_id', 'dim_product')} AS orphan_records",
    "dq_fk_txn_date": f"SELECT {orphan('fact_transactions', 'date_key', 'dim_date')} AS orphan_records",
    "dq_fk_service_customer": f"SELECT {orphan('fact_service_logs', 'customer_id', 'dim_customer')} AS orphan_records",
    "dq_fk_response_campaign": f"SELECT {orphan('fact_campaign_responses', 'campaign_id', 'dim_campaign')} AS orphan_records",
    "dq_range_age": value_range("dim_customer", "age", 1, "age < 18 OR age > 100"),
    "dq_range_credit_limit": value_range("dim_customer", "credit_limit", 0, "credit_limit <= 0"),
    "dq_range_amount": value_range("fact_transactions", "amount", 2, "amount <= 0"),
    "dq_range_csat": value_range("fact_service_logs", "csat_score", 2, "csat_score NOT BETWEEN 1 AND 5", False)
    + " WHERE csat_score IS NOT NULL",
    "dq_dist_status": f"SELECT customer_status, count(*) AS customers, {SHARE} AS share_pct FROM dim_customer GROUP BY 1",
    "dq_dist_card": f"SELECT card_category, count(*) AS customers, {SHARE} AS share_pct FROM dim_customer GROUP BY 1",
    "dq_funnel_violations": f"SELECT count(*) AS invalid_count FROM fact_campaign_responses WHERE {FUNNEL}",
    "dq_reconciliation": f"""SELECT count(*) AS customers, count(*) FILTER (WHERE {GAP} <= 1) AS within,
 count(*) FILTER (WHERE {GAP} > 1) AS outside, {r(mean(GAP))} AS avg_gap, {d(f'max({GAP})')} AS max_gap FROM {RECONCILED}""",
    "dq_summary": UNION.join(
        f"SELECT '{name}' AS check_name, CASE WHEN {value} = 0 THEN 'PASS' ELSE 'FAIL' END AS status"
        for name, value in (
            ("No duplicate customer IDs", duplicate("dim_customer", "customer_id")),
            ("No orphan transactions", orphan("fact_transactions", "customer_id", "dim_customer")),
            ("No negative transaction amounts", count("fact_transactions", "amount <= 0")),
            ("Valid CSAT scores (1-5)", count("fact_service_logs", "csat_score < 1 OR csat_score > 5")),
            ("Valid customer statuses", count("dim_customer", "customer_status NOT IN ('Active', 'Churned')")),
            (
                "Campaign funnel integrity",
                count("fact_campaign_responses", "(was_accepted AND NOT was_clicked) OR (was_clicked AND NOT was_opened)"),
            ),
        )
    ),
    "dqv_tables_present": rows("dq", DQ["tables"]),
    "dqv_row_minimum": rows("dq", DQ["minimum"]),
    "dqv_pk_unique": rows("dq", DQ["keys"]),
    "dqv_nulls": rows("dq", DQ["nulls"]),
    "dqv_foreign_keys": rows("dq", DQ["foreign"]),
    "dqv_ranges": rows("dq", DQ["ranges"]),
    "dqv_funnel": rows("dq", DQ["funnel"]),
    "dqv_future_dates": rows("dq", DQ["future"]),
    "dqv_summary": summary(rows("dq", [c for checks in DQ.values() for c in checks]), 95),
    **{name: rows("business", checks) for name, checks in BUSINESS.items()},
    "bv_summary": summary(ALL_BUSINESS, 90),
    "bv_categories": f"""SELECT category, count(*) AS checks, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL'
 WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM ({ALL_BUSINESS}) GROUP BY 1""",
}
