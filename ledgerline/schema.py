"""Types of the star schema: four dimensions and three facts."""

from __future__ import annotations

import re

from pyspark.sql import types as T


KINDS = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def struct(text: str) -> T.StructType:
    """The type that "name type, name type" says; needs no session, unlike DDL strings."""
    fields = []
    for field in re.split(r",(?![0-9])", text):
        name, kind = field.split()
        digits = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
        fields.append(T.StructField(name, T.DecimalType(*map(int, digits.groups())) if digits else KINDS[kind]))
    return T.StructType(fields)


DIM_DATE = struct(
    "date_key int, full_date date, day_of_week int, day_name string, day_of_month int, week_of_year int,"
    " month_number int, month_name string, quarter int, quarter_name string, year int, is_weekend boolean,"
    " is_holiday boolean, holiday_name string, fiscal_year int, fiscal_quarter int, fiscal_quarter_name string,"
    " is_month_start boolean, is_month_end boolean, is_salary_week boolean"
)
DIM_CUSTOMER = struct(
    "customer_id bigint, first_name string, last_name string, age int, gender string, dependents int,"
    " education_level string, marital_status string, income_bracket string, city string, state string,"
    " customer_since date, customer_tenure_months int, customer_status string, credit_limit decimal(15,2),"
    " total_revolving_bal decimal(15,2), avg_open_to_buy decimal(15,2), credit_utilization_ratio double,"
    " card_category string, total_products_held int, months_inactive_12m int, contacts_count_12m int,"
    " total_trans_amt_12m decimal(15,2), total_trans_ct_12m bigint, amt_change_q4_q1 double,"
    " ct_change_q4_q1 double, risk_category string, preferred_channel string"
)
DIM_PRODUCT = struct(
    "product_id bigint, product_name string, product_category string, product_type string,"
    " annual_fee decimal(10,2), interest_rate decimal(5,2), min_balance decimal(12,2), launch_date date,"
    " is_active boolean"
)
DIM_CAMPAIGN = struct(
    "campaign_id int, campaign_name string, campaign_type string, campaign_channel string, target_segment string,"
    " start_date date, end_date date, budget decimal(12,2), objective string, status string"
)
FACT_TRANSACTIONS = struct(
    "transaction_id bigint, customer_id bigint, product_id bigint, date_key int, transaction_date timestamp,"
    " transaction_type string, transaction_channel string, merchant_category string, merchant_name string,"
    " amount decimal(15,2), is_high_value boolean"
)
FACT_SERVICE_LOGS = struct(
    "service_id bigint, customer_id bigint, date_key int, complaint_date timestamp, complaint_category string,"
    " priority string, channel string, resolution_time_hours decimal(8,2), status string, escalation_flag boolean,"
    " csat_score int"
)
FACT_CAMPAIGN_RESPONSES = struct(
    "response_id bigint, campaign_id int, customer_id bigint, date_key int, response_date timestamp,"
    " was_contacted boolean, was_opened boolean, was_clicked boolean, was_accepted boolean,"
    " conversion_value decimal(12,2), days_to_response int"
)

TABLES = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_product": DIM_PRODUCT,
    "dim_campaign": DIM_CAMPAIGN,
    "fact_transactions": FACT_TRANSACTIONS,
    "fact_service_logs": FACT_SERVICE_LOGS,
    "fact_campaign_responses": FACT_CAMPAIGN_RESPONSES,
}
