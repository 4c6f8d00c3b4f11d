"""Star tables derived from an order-processing schema with an event stream.

Sales come from lineitem, orders and part, customers from customer and what they did, tickets and campaign responses
from events. All rules are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import schema
from ledgerline.functions.bitsets import bits_set, few_distinct, few_values, unique_key_set, value_bit, with_lost, with_values
from ledgerline.functions.columns import n, ratio, rounded
from ledgerline.operators.calendar import date_key, dim_date
from ledgerline.operators.transforms import card_tier, flag_high_value, mapped, risk_category
from ledgerline.sources.storage import materialise

#: The day that ages count up to: sales, and events.
AS_OF = "2001-11-04"
EVENTS_AS_OF = "2024-01-31"
DATES = ("1995-01-01", "2024-12-31")
CHURN_DAYS = 120
#: Campaign windows: this many days each, from this day on.
WINDOW_START, WINDOW_DAYS = "2024-01-01", 6
INCOME_SCORE = {"AUTOMOBILE": 4, "BUILDING": 3}
PRIORITIES = ("Low", "Medium", "High", "Critical")

# Campaigns (name, type, channel, segment, budget, objective).
CAMPAIGNS = (
    ("Credit Limit Upgrade", "Email", "Digital", "High Utilization", 500000, "Cross-sell"),
    ("Premium Card Upgrade", "Outbound Call", "Direct", "Affluent", 800000, "Upsell"),
    ("Re-engagement Offer", "SMS", "Digital", "At Risk", 300000, "Retention"),
    ("Cross-sell Insurance", "Push Notification", "Digital", "Mass", 450000, "Cross-sell"),
    ("Loyalty Rewards Program", "Email", "Digital", "Loyal", 600000, "Engagement"),
)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order and type; columns that df lacks are null."""
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.TABLES[table]
        )
    )


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_key() -> F.Column:
    """The number k in an event's properties."""
    return F.get_json_object("props", "$.k").cast("int")


#: What a packed line holds, and bits for each; beyond them a line moves as it is.
PACKED = {"cents": 30, "day": 16, "l_linenumber": 8, "returned": 1}


def packed(line: DataFrame) -> DataFrame:
    """line (l_orderkey, l_partkey, l_linenumber, l_shipdate, amount, returned, never null) with all but the keys in one long, where
    the values fit: null elsewhere, and where it is not null the others are."""
    day = F.to_date("l_shipdate")
    kind = line.schema["l_shipdate"].dataType
    whole = {"cents": cents(F.col("amount")), "day": F.unix_date(day), "l_linenumber": F.col("l_linenumber"), "returned": F.col("returned").cast("int")}
    fits, code = day.cast(kind) == F.col("l_shipdate"), F.lit(0).cast("long")
    for name, bits in PACKED.items():
        fits &= whole[name].between(0, (1 << bits) - 1)
        code = F.shiftleft(code, bits).bitwiseOR(whole[name].cast("long"))
    fits = F.coalesce(fits, F.lit(False))
    return line.select(
        "l_orderkey", F.when(fits, code).alias("__line"), "l_partkey",
        *(F.when(~fits, F.col(c)).alias(c) for c in ("l_linenumber", "l_shipdate", "amount", "returned")),
    )


def unpacked(line: DataFrame) -> DataFrame:
    """The columns that packed took, as they were."""
    part, low = {}, 0
    for name, bits in reversed(PACKED.items()):
        part[name] = F.shiftright("__line", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        low += bits
    values = {
        "l_linenumber": part["l_linenumber"], "l_shipdate": F.date_from_unix_date(part["day"].cast("int")),
        "amount": part["cents"].cast("decimal(20,0)") * F.lit(Decimal("0.01")), "returned": part["returned"] == 1,
    }
    there = F.col("__line").isNotNull()
    return line.withColumns({
        c: F.when(there, x.cast(line.schema[c].dataType)).otherwise(F.col(c)) for c, x in values.items()
    }).drop("__line")


def fact_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line; transaction_id is not unique, as (order, line) is not.

    Lines move once, to their orders, packed to as few bytes as will do; what parts say comes by broadcast codes. The quartiles
    by category need an order to be there, not its columns: sets of its keys tell, where keys are unique and not too many.
    """
    line = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("returned"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("amount"),
    )
    order = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    sold = unpacked(packed(line).join(order, "l_orderkey"))
    rows = with_values(sold, "l_partkey", part, ["p_type", "p_brand"]).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        date_key(F.to_date("l_shipdate")).alias("date_key"),
        F.col("l_shipdate").alias("transaction_date"),
        F.when(F.col("returned"), "Refund").otherwise("Purchase").alias("transaction_type"),
        F.col("o_orderpriority").alias("transaction_channel"),
        F.col("p_type").alias("merchant_category"),
        F.col("p_brand").alias("merchant_name"),
        "amount",
    )
    priced, orders = None, unique_key_set(order, "l_orderkey")
    if orders is not None:
        typed = with_values(line.select("l_orderkey", "l_partkey", "amount"), "l_partkey", part.drop("p_brand"), ["p_type"])
        priced = with_lost(typed, "l_orderkey", orders, "lost").where(F.col("l_orderkey").isNotNull() & ~F.col("lost"))
        priced = priced.select(F.col("p_type").alias("merchant_category"), "amount")
    return conform(flag_high_value(rows, priced=priced), "fact_transactions")


def months_to(day: F.Column) -> F.Column:
    """Calendar months from day to AS_OF."""
    year, month = (int(x) for x in AS_OF.split("-")[:2])
    return (year - F.year(day)) * 12 + (month - F.month(day))


def cents(amount: Column) -> Column:
    """An amount of two decimals as a whole number, whose sums take a third of the room."""
    return (amount * 100).cast("long")


def money(c: str) -> Column:
    """The exact amount of cents."""
    return F.col(c).cast("decimal(20,0)") * F.lit(Decimal("0.01"))


#: What is known of a group's sales, and how the groups' values make that of all.
SUMS = {
    "amount_cents": F.sum, "sales": F.sum, "last_day": F.max, "cents_q4": F.sum, "cents_q1": F.sum, "count_q4": F.sum, "count_q1": F.sum,
    "type_bits": F.bit_or,
}


def sales_sums(sales: DataFrame, key: str, kinds: list) -> DataFrame:
    """SUMS of sales (amount, transaction_date, merchant_category) for each key. kinds: the categories, at most 64."""
    day = F.to_date("transaction_date")
    in_quarter = lambda q, x: F.sum(F.when(F.quarter(day) == q, x))
    amount = cents(F.col("amount"))
    return sales.groupBy(key).agg(
        F.sum(amount).alias("amount_cents"), n().alias("sales"), F.max(day).alias("last_day"),
        in_quarter(4, amount).alias("cents_q4"), in_quarter(1, amount).alias("cents_q1"),
        in_quarter(4, F.lit(1)).alias("count_q4"), in_quarter(1, F.lit(1)).alias("count_q1"),
        F.bit_or(F.when(_recent(day), value_bit(kinds, "merchant_category"))).alias("type_bits"),
    )


def _recent(day: Column) -> Column:
    return day > F.date_sub(F.lit(AS_OF).cast("date"), 365)


def _of_customers(sums: DataFrame) -> DataFrame:
    """What dim_customer says of SUMS by customer."""
    return sums.select(
        "customer_id", money("amount_cents").alias("total_trans_amt_12m"), F.col("sales").alias("total_trans_ct_12m"), "last_day",
        rounded(ratio(money("cents_q4"), money("cents_q1")), 4).alias("amt_change_q4_q1"),
        rounded(ratio(F.col("count_q4"), F.col("count_q1")), 4).alias("ct_change_q4_q1"),
        bits_set(F.col("type_bits")).alias("recent_types"),
    )


def sales_of_transactions(transactions: DataFrame) -> DataFrame:
    """What the stored transactions say of each customer."""
    kinds = few_values(transactions, "merchant_category")
    if kinds is not None:
        return _of_customers(sales_sums(transactions, "customer_id", kinds))
    day = F.to_date("transaction_date")
    in_quarter = lambda q, x: F.sum(F.when(F.quarter(day) == q, x))
    return transactions.groupBy("customer_id").agg(
        F.sum("amount").alias("total_trans_amt_12m"),
        n().alias("total_trans_ct_12m"),
        F.max(day).alias("last_day"),
        rounded(ratio(in_quarter(4, F.col("amount")), in_quarter(1, F.col("amount"))), 4).alias("amt_change_q4_q1"),
        rounded(ratio(in_quarter(4, F.lit(1)), in_quarter(1, F.lit(1))), 4).alias("ct_change_q4_q1"),
        few_distinct(transactions, "merchant_category", _recent(day)).alias("recent_types"),
    )


def sales_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The same from order lines, which are summed up by order before they move; None where there are many categories. Lines
    count as in fact_transactions: their order and part are there, and the part has a category."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("merchant_category"))
    kinds = few_values(part, "merchant_category")
    if kinds is None:
        return None
    line = _read(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(
        "l_orderkey", "l_partkey", F.col("l_shipdate").alias("transaction_date"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("amount"),
    )
    typed = with_values(line, "l_partkey", part, ["merchant_category"]).where("merchant_category is not null")
    order = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
    sums = sales_sums(typed, "l_orderkey", kinds).join(order, "l_orderkey")
    return _of_customers(sums.groupBy("customer_id").agg(*(merged(c).alias(c) for c, merged in SUMS.items())))


#: Of so many priorities a customer's orders are counted side by side.
CHANNELS = 16


def order_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders say of each customer: the first day, the share of open amounts, and the most frequent priority, of
    equally frequent ones the first by name. Orders meet once where there are few priorities."""
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), "o_orderdate", "o_orderstatus", "o_orderpriority",
        cents(F.col("o_totalprice").cast("decimal(15,2)")).alias("price"),
    )
    kinds = few_values(orders, "o_orderpriority", CHANNELS)
    counts = [] if kinds is None else [(F.lit(None), F.col("o_orderpriority").isNull()), *((F.lit(k), F.col("o_orderpriority") == k) for k in kinds)]
    found = orders.groupBy("customer_id").agg(
        F.min("o_orderdate").alias("first_order"), F.sum("price").alias("price"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("price")).otherwise(F.lit(0))).alias("open_price"),
        *(F.count_if(has).alias(f"__n{i}") for i, (_, has) in enumerate(counts)),
    )
    by_order = found.withColumn("customer_since", F.to_date("first_order")).withColumn(
        "credit_utilization_ratio", rounded(ratio(money("open_price"), money("price")), 4)
    )
    known = ["customer_id", "customer_since", "credit_utilization_ratio"]
    if kinds is None:
        often = Window.partitionBy("customer_id").orderBy(F.col("n").desc(), "preferred_channel")
        channel = (
            orders.groupBy("customer_id", F.col("o_orderpriority").alias("preferred_channel"))
            .agg(n().alias("n")).withColumn("place", F.row_number().over(often)).where("place = 1")
            .select("customer_id", "preferred_channel")
        )
        return by_order.select(*known).join(channel, "customer_id")
    each = F.array(*(
        F.struct((-F.col(f"__n{i}")).alias("n"), value.cast("string").alias("channel")) for i, (value, _) in enumerate(counts)
    ))
    return by_order.select(*known, F.array_min(each)["channel"].alias("preferred_channel"))


def dim_customer(spark: SparkSession, sf_dir: str, transactions: Callable[[], DataFrame], there: bool = True) -> DataFrame:
    """One row for each customer, with aggregates over orders, transactions and error events. there: whether transactions
    are stored already; if not, they are only asked for where order lines do not do."""
    as_of = F.lit(AS_OF).cast("date")
    key = F.col("customer_id")
    place = (
        _read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"), "n_regionkey")
        .join(_read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("state")), "n_regionkey")
    )
    by_txn = None if there else sales_of_lines(spark, sf_dir)
    if by_txn is None:
        by_txn = sales_of_transactions(transactions())
    contacts = (
        _read(spark, sf_dir, "events").where("event_type = 'error'")
        .groupBy(F.col("user_id").alias("customer_id")).agg(n().alias("contacts"))
    )
    base = (
        _read(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("customer_id"), "c_name", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("income_bracket"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(order_sums(spark, sf_dir), "customer_id", "left")
        .join(by_txn, "customer_id", "left").join(contacts, "customer_id", "left")
    )
    limit = F.col("c_acctbal").cast("decimal(15,2)") + F.lit(1000)
    inactive = F.least(F.lit(12), F.coalesce(months_to(F.col("last_day")), F.lit(12)))
    gone = F.coalesce(F.datediff(as_of, F.col("last_day")) > CHURN_DAYS, F.lit(True))
    rows = base.select(
        "customer_id",
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        (F.pmod(key * 37, F.lit(63)) + 18).alias("age"),
        F.when(F.pmod(key, F.lit(2)) == 0, "Female").otherwise("Male").alias("gender"),
        F.pmod(key, F.lit(6)).alias("dependents"),
        "income_bracket", "city", "state", "customer_since",
        months_to(F.col("customer_since")).alias("customer_tenure_months"),
        F.when(gone, "Churned").otherwise("Active").alias("customer_status"),
        limit.alias("credit_limit"),
        "credit_utilization_ratio",
        F.least(F.greatest(F.coalesce("recent_types", F.lit(0)), F.lit(1)), F.lit(6)).alias("total_products_held"),
        inactive.cast("int").alias("months_inactive_12m"),
        F.coalesce("contacts", F.lit(0)).alias("contacts_count_12m"),
        F.coalesce("total_trans_amt_12m", F.lit(0)).cast("decimal(15,2)").alias("total_trans_amt_12m"),
        F.coalesce("total_trans_ct_12m", F.lit(0)).alias("total_trans_ct_12m"),
        "amt_change_q4_q1", "ct_change_q4_q1", "preferred_channel",
    )
    tiered = card_tier(materialise(rows, "customers"), mapped("income_bracket", INCOME_SCORE, 1))
    return conform(tiered.withColumn("risk_category", risk_category()), "dim_customer")


def fact_service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", event_key())
    hours = F.col("value").cast("decimal(8,2)")
    done = F.col("value") <= 100
    return conform(
        e.select(
            F.col("event_id").alias("service_id"),
            F.col("user_id").alias("customer_id"),
            date_key(F.to_date("ts")).alias("date_key"),
            F.col("ts").alias("complaint_date"),
            F.concat(F.lit("C"), F.col("k") % 6).alias("complaint_category"),
            F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.col("k") % 4 + 1).cast("int")).alias("priority"),
            F.concat(F.lit("CH"), F.col("event_id") % 5).alias("channel"),
            F.when(done, hours).alias("resolution_time_hours"),
            F.when(done, "Resolved").otherwise("Escalated").alias("status"),
            (F.col("value") > 75).alias("escalation_flag"),
            (F.col("k") % 5 + 1).alias("csat_score"),
        ),
        "fact_service_logs",
    )


def fact_campaign_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and campaign window with an event; each step of the funnel needs the one before."""
    start = F.lit(WINDOW_START).cast("date")
    e = _read(spark, sf_dir, "events").withColumn("w", F.floor(F.datediff(F.to_date("ts"), start) / WINDOW_DAYS).cast("int"))
    is_a = lambda kind: F.col("event_type") == kind
    seen = e.where(F.col("w").between(0, len(CAMPAIGNS) - 1)).groupBy("user_id", "w").agg(
        F.max(is_a("view")).alias("view"), F.max(is_a("click")).alias("click"), F.max(is_a("purchase")).alias("purchase"),
        F.sum(F.when(is_a("purchase"), F.col("value").cast("decimal(12,2)"))).alias("bought"),
        F.coalesce(F.min(F.when(is_a("purchase"), F.col("ts"))), F.min("ts")).alias("response_date"),
    )
    opened = F.col("view")
    clicked = opened & F.col("click")
    accepted = clicked & F.col("purchase")
    day = F.to_date("response_date")
    return conform(
        seen.select(
            (F.col("user_id") * 10 + F.col("w")).alias("response_id"),
            (F.col("w") + 1).alias("campaign_id"),
            F.col("user_id").alias("customer_id"),
            date_key(day).alias("date_key"),
            "response_date",
            F.lit(True).alias("was_contacted"),
            opened.alias("was_opened"), clicked.alias("was_clicked"), accepted.alias("was_accepted"),
            F.when(accepted, F.col("bought")).alias("conversion_value"),
            F.datediff(day, F.date_add(start, F.col("w") * WINDOW_DAYS)).alias("days_to_response"),
        ),
        "fact_campaign_responses",
    )


def timed_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the event stream as transactions, which have a time of day; the shipping days of the others have none."""
    e = _read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return conform(
        e.select(
            F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"),
            date_key(F.to_date("ts")).alias("date_key"), F.col("ts").alias("transaction_date"),
            F.concat(F.lit("C"), event_key() % 6).alias("merchant_category"), F.col("value").alias("amount"),
        ),
        "fact_transactions",
    )


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return conform(
        part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"), F.col("p_brand").alias("product_type"),
        ),
        "dim_product",
    )


def dim_campaign(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CAMPAIGNS, 1)]
    names = "campaign_id int, campaign_name string, campaign_type string, campaign_channel string, target_segment string, budget int, objective string"
    start = F.date_add(F.lit(WINDOW_START).cast("date"), (F.col("campaign_id") - 1) * WINDOW_DAYS)
    return conform(
        spark.createDataFrame(rows, names)
        .withColumn("start_date", start)
        .withColumn("end_date", F.date_add(start, WINDOW_DAYS - 1))
        .withColumn("status", F.lit("Completed")),
        "dim_campaign",
    )


#: The tables that read no other table of the model; dim_customer reads the transactions.
INDEPENDENT = {
    "dim_date": lambda spark, sf_dir: dim_date(spark, *DATES),
    "fact_transactions": fact_transactions,
    "fact_service_logs": fact_service_logs,
    "fact_campaign_responses": fact_campaign_responses,
    "dim_product": dim_product,
    "dim_campaign": lambda spark, sf_dir: dim_campaign(spark),
}
