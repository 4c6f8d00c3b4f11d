"""Files in and out: raw CSV inputs, CSV and JSON outputs, tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schema
from ledgerline.operators import transforms as X
from ledgerline.sources.checked import QUOTE, Checked, check

# Columns of the raw customer file, and their types.
CUSTOMER_COLUMNS = {
    "CLIENTNUM": "long", "Attrition_Flag": "string", "Customer_Age": "int", "Gender": "string", "Dependent_count": "int",
    "Education_Level": "string", "Marital_Status": "string", "Income_Category": "string", "Card_Category": "string",
    "Months_on_book": "int", "Total_Relationship_Count": "int", "Months_Inactive_12_mon": "int",
    "Contacts_Count_12_mon": "int", "Credit_Limit": "double", "Total_Revolving_Bal": "double", "Avg_Open_To_Buy": "double",
    "Total_Amt_Chng_Q4_Q1": "double", "Total_Trans_Amt": "double", "Total_Trans_Ct": "int",
    "Total_Ct_Chng_Q4_Q1": "double", "Avg_Utilization_Ratio": "double",
}
#: Columns whose names hold one of these are dropped.
DROPPED = ("Naive", "Bayes")
TRANSACTION_COLUMNS = {"trans_date_trans_time": "timestamp", "category": "string", "amt": "double", "merchant": "string"}


def check_customers(spark: SparkSession, path: str) -> Checked:
    """The raw customer file as typed rows and rejected lines; model columns are dropped, a missing column is an error,
    extra ones stay. A line without a customer number is rejected."""
    return check(spark, path, CUSTOMER_COLUMNS, required=("CLIENTNUM",), dropped=DROPPED)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """The rows of check_customers, with a warning if there are rejects."""
    return check_customers(spark, path).warn(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds files at path."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def check_transactions(spark: SparkSession, paths: list[str]) -> Checked:
    """All raw transaction files that exist, one after another, as typed rows with merchant_category and rejected lines; no
    file is an error. A line without a time or an amount is rejected."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"no transaction file among {', '.join(paths)}")
    found = [check(spark, p, TRANSACTION_COLUMNS, required=("trans_date_trans_time", "amt")) for p in there]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.rows for f in found))
    rejects = reduce(DataFrame.unionByName, (f.rejects for f in found))
    return Checked(rows.withColumn("merchant_category", X.mapped("category", X.MERCHANT_CATEGORY, X.UNMAPPED_CATEGORY)), rejects)


def read_transactions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of check_transactions, with a warning if there are rejects."""
    return check_transactions(spark, paths).warn(", ".join(paths))


def write_rejects(rejects: DataFrame, folder: str) -> None:
    """Add rejected lines to those that folder has, as JSON lines."""
    rejects.write.mode("append").json(folder)


def localise(raw: DataFrame, as_of: str) -> DataFrame:
    """dim_customer rows from the raw customer file; what the file does not say (names, places) is null."""
    money = lambda c: X.scale_money(c)
    rows = raw.select(
        F.col("CLIENTNUM").alias("customer_id"),
        F.col("Customer_Age").alias("age"),
        X.mapped("Gender", X.GENDER).alias("gender"),
        F.col("Dependent_count").alias("dependents"),
        X.sentinel_to_null("Education_Level").alias("education_level"),
        X.sentinel_to_null("Marital_Status").alias("marital_status"),
        X.mapped("Income_Category", X.INCOME).alias("income_bracket"),
        X.customer_since(F.lit(as_of).cast("date"), F.col("Months_on_book")).alias("customer_since"),
        F.col("Months_on_book").alias("customer_tenure_months"),
        X.mapped("Attrition_Flag", X.STATUS).alias("customer_status"),
        X.scale_money("Credit_Limit", digits=-2).alias("credit_limit"),
        money("Total_Revolving_Bal").alias("total_revolving_bal"),
        money("Avg_Open_To_Buy").alias("avg_open_to_buy"),
        F.round("Avg_Utilization_Ratio", 4).alias("credit_utilization_ratio"),
        F.col("Months_Inactive_12_mon").alias("months_inactive_12m"),
        F.col("Contacts_Count_12_mon").alias("contacts_count_12m"),
        money("Total_Trans_Amt").alias("total_trans_amt_12m"),
        F.col("Total_Trans_Ct").alias("total_trans_ct_12m"),
        F.round("Total_Amt_Chng_Q4_Q1", 4).alias("amt_change_q4_q1"),
        F.round("Total_Ct_Chng_Q4_Q1", 4).alias("ct_change_q4_q1"),
    )
    score = X.mapped("income_bracket", {"Above ₹15L": 4, "₹8L - ₹15L": 3}, 1)
    tiered = X.card_tier(rows, score).withColumn("total_products_held", X.products_held(score))
    tiered = tiered.withColumn("risk_category", X.risk_category())
    return tiered.select(
        *(
            (F.col(f.name) if f.name in tiered.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.DIM_CUSTOMER
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape=QUOTE)


def write_profile(profiles: dict[str, DataFrame], path: str) -> None:
    """Profile tables as JSON lines, one folder for each."""
    for name, df in profiles.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_profile(spark: SparkSession, path: str, name: str, kind: T.StructType) -> DataFrame:
    return spark.read.schema(kind).json(f"{path}/{name}")


def load_table(df: DataFrame, table: str, surrogate: str | None = None) -> int:
    """Replace the table of the catalog by df; the number of rows in it afterwards.

    surrogate: a key column that the store numbers itself, left out. The rows are written to a table beside and counted
    there; only if no row is missing do the two change places. If anything fails before, or the exchange itself, the old
    table is there as it was; a load that was cut off during the exchange is mended by the next one. df may read the table.
    """
    spark = df.sparkSession
    beside, before = f"{table}__{uuid.uuid4().hex}", f"{table}__before"
    has = spark.catalog.tableExists
    if not has(table) and has(before):
        spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    written = Observation()
    rows = df.drop(surrogate) if surrogate else df
    try:
        rows.observe(written, F.count(F.lit(1)).alias("n")).write.saveAsTable(beside)
        n = spark.table(beside).count()
        if n != written.get["n"]:
            raise RuntimeError(f"{beside} has {n} rows of {written.get['n']}; {table} was left as it was")
        _exchange(spark, table, beside, before)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {beside}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    return n


def _exchange(spark: SparkSession, table: str, beside: str, before: str) -> None:
    """table becomes before, if it is there, and beside becomes table."""
    old = spark.catalog.tableExists(table)
    if old:
        spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
    try:
        spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")
    except Exception:
        if old:
            spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
        raise


def missing_tables(spark: SparkSession, names: tuple[str, ...] = tuple(schema.TABLES)) -> list[str]:
    return [name for name in names if not spark.catalog.tableExists(name)]


def write_star(tables: dict[str, DataFrame], folder: str) -> None:
    """Store tables of the model below folder, in the model's columns and types; columns that a table lacks are null.

    A table of the model that is not given, or has no row, is stored without rows."""
    unknown = sorted(set(tables) - set(schema.TABLES))
    if unknown:
        raise ValueError(f"no tables of the model: {', '.join(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    for name, kind in schema.TABLES.items():
        df = tables.get(name, spark.createDataFrame([], kind))
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]
        df.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}")


# The seeded products (id, name, category, type, fee, interest, minimum balance, launch).
PRODUCTS = (
    (1, "Savings Account", "Deposits", "Savings", 0, "3.50", "1000.00", "2010-01-01"),
    (2, "Current Account", "Deposits", "Current", 0, "0.00", "10000.00", "2010-01-01"),
    (3, "Fixed Deposit", "Deposits", "Term Deposit", 0, "7.10", "25000.00", "2010-01-01"),
    (4, "Credit Card - Blue", "Cards", "Basic", 499, "36.00", None, "2012-01-01"),
    (5, "Credit Card - Silver", "Cards", "Silver", 999, "30.00", None, "2012-06-01"),
    (6, "Credit Card - Gold", "Cards", "Gold", 2499, "24.00", None, "2013-01-01"),
    (7, "Credit Card - Platinum", "Cards", "Platinum", 4999, "18.00", None, "2014-01-01"),
    (8, "Personal Loan", "Loans", "Unsecured", 0, "12.50", None, "2011-01-01"),
    (9, "Home Loan", "Loans", "Secured", 0, "8.50", None, "2010-01-01"),
    (10, "Vehicle Loan", "Loans", "Secured", 0, "9.75", None, "2011-06-01"),
    (11, "Health Insurance", "Insurance", "Health", 0, None, "500000.00", "2015-01-01"),
    (12, "Mutual Fund SIP", "Investments", "Equity", 0, None, "500.00", "2016-01-01"),
)


# The seeded campaigns (id, name, type, channel, segment, start, end, budget, objective).
CAMPAIGNS = (
    (1, "Credit Limit Upgrade", "Email", "Digital", "High Utilization", "2024-01-15", "2024-03-15", 500000, "Cross-sell"),
    (2, "Premium Card Upgrade", "Outbound Call", "Direct", "Affluent", "2024-04-01", "2024-06-30", 800000, "Upsell"),
    (3, "Re-engagement Offer", "SMS", "Digital", "At Risk", "2024-07-01", "2024-08-31", 300000, "Retention"),
    (4, "Cross-sell Insurance", "Push Notification", "Digital", "Mass", "2024-09-01", "2024-11-30", 450000, "Cross-sell"),
    (5, "Loyalty Rewards Program", "Email", "Digital", "Loyal", "2024-10-01", "2024-12-31", 600000, "Engagement"),
)


def seed_campaigns(spark: SparkSession) -> DataFrame:
    names = [f.name for f in schema.DIM_CAMPAIGN][:-1]
    raw = spark.createDataFrame(CAMPAIGNS, T.StructType([
        T.StructField(c, T.IntegerType() if c in ("campaign_id", "budget") else T.StringType()) for c in names
    ])).withColumn("status", F.lit("Completed"))
    return raw.select(*(F.col(f.name).cast(f.dataType) for f in schema.DIM_CAMPAIGN))


def seed_products(spark: SparkSession) -> DataFrame:
    names = [f.name for f in schema.DIM_PRODUCT][:-1]
    raw = spark.createDataFrame(PRODUCTS, T.StructType([
        T.StructField(c, T.IntegerType() if c in ("product_id", "annual_fee") else T.StringType()) for c in names
    ])).withColumn("is_active", F.lit(True))
    return raw.select(*(F.col(f.name).cast(f.dataType) for f in schema.DIM_PRODUCT))
