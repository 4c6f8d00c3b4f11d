"""Data quality: single checks with their measures, and a suite of pass, warn or fail results with a score.

A single check reads what it needs. The suite reads each table once: every row is counted under its own key or the keys
it refers to, with what is wrong with it, so that one grouping by key tells duplicates, orphans and all other measures.
A check that fails to run fails; it does not vanish from the score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schema
from ledgerline.functions import bitsets
from ledgerline.functions.columns import avg, dbl, n, pct, ratio, rounded, share_of_total
from ledgerline.functions.ranking import percentiles
from ledgerline.plans.registry import query
from ledgerline.sources.warehouse import Star

# Least numbers of rows, keys, critical columns, foreign keys.
MINIMUM_ROWS = {
    "dim_customer": 10000, "dim_product": 10, "dim_campaign": 5, "dim_date": 2000, "fact_transactions": 100000,
    "fact_service_logs": 5000, "fact_campaign_responses": 1000,
}
PRIMARY_KEYS = {
    "dim_customer": "customer_id", "dim_product": "product_id", "dim_campaign": "campaign_id", "dim_date": "date_key",
}
CRITICAL = {
    "dim_customer": (
        "customer_id", "customer_status", "age", "gender", "income_bracket", "card_category", "credit_limit",
        "total_trans_amt_12m",
    ),
    "fact_transactions": ("customer_id", "amount", "transaction_date", "merchant_category"),
    "fact_service_logs": ("customer_id", "complaint_date", "complaint_category", "priority"),
    "fact_campaign_responses": ("campaign_id", "customer_id", "was_contacted"),
}
FOREIGN_KEYS = (
    ("fact_transactions", "customer_id", "dim_customer"), ("fact_transactions", "product_id", "dim_product"),
    ("fact_transactions", "date_key", "dim_date"), ("fact_service_logs", "customer_id", "dim_customer"),
    ("fact_service_logs", "date_key", "dim_date"), ("fact_campaign_responses", "customer_id", "dim_customer"),
    ("fact_campaign_responses", "campaign_id", "dim_campaign"), ("fact_campaign_responses", "date_key", "dim_date"),
)
NULL_WARN_PCT = 5.0
DQ_GATE = 95.0
STATUSES = ("Active", "Churned")
RESULT = ("suite", "category", "table", "check", "status", "detail", "is_critical")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broken_funnel(all_steps: bool = True) -> Column:
    c = F.col
    rule = (c("was_accepted") & ~c("was_clicked")) | (c("was_clicked") & ~c("was_opened"))
    return rule | (c("was_opened") & ~c("was_contacted")) if all_steps else rule


def unpivot(row: DataFrame, names: list[str], label: str = "check", value: str = "detail") -> DataFrame:
    """One row's columns as rows (label, value)."""
    return row.unpivot([], [dbl(c).alias(c) for c in names], label, value)


def orphans(s: Star, child: str, key: str, parent: str) -> DataFrame:
    """The keys of child that parent lacks, and how many rows (n) each has; rows are counted before keys meet."""
    left = getattr(s, child).where(F.col(key).isNotNull()).groupBy(key).agg(n().alias("n"))
    return left.join(getattr(s, parent).select(key), key, "left_anti")


def rows_of(counts: str) -> Column:
    return F.coalesce(F.sum(counts), F.lit(0))


def result(df: DataFrame, suite: str, category: str, table: Column, status: Column, critical: bool = False) -> DataFrame:
    return df.select(
        F.lit(suite).alias("suite"), F.lit(category).alias("category"), table.alias("table"), "check",
        status.alias("status"), F.col("detail").cast("double").alias("detail"), F.lit(critical).alias("is_critical"),
    )


def zero_or(bad: str) -> Column:
    return F.when(F.col("detail") == 0, "PASS").otherwise(bad)


# Single checks.


@query
def dq_row_counts(s: Star) -> DataFrame:
    return union([getattr(s, t).agg(n().alias("row_count")).withColumn("table_name", F.lit(t)) for t in schema.TABLES])


@query
def dq_null_counts(s: Star) -> DataFrame:
    names = (
        "customer_id", "age", "gender", "income_bracket", "education_level", "marital_status", "customer_status",
        "card_category", "credit_limit", "total_trans_amt_12m",
    )
    return s.dim_customer.agg(n().alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(n().alias("occurrences")).where("occurrences > 1").orderBy(F.col("occurrences").desc(), key).limit(10)


@query
def dq_dup_customer(s: Star) -> DataFrame:
    return duplicates(s.dim_customer, "customer_id")


@query
def dq_dup_product(s: Star) -> DataFrame:
    return duplicates(s.dim_product, "product_id")


def orphan_counts(s: Star, child: str, links: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: under each name of links (name to key and parent), how many rows of child have a key that parent lacks.

    child is read once and none of its rows moves: the parents' keys are sets of words, which are broadcast where they are
    few enough. Else the child's keys are counted and meet the parent's in a join, a read for each such key."""
    rows, counted, apart = getattr(s, child), [], []
    for name, (key, parent) in links.items():
        keys = bitsets.key_set(getattr(s, parent), key)
        if keys is None:
            apart.append(orphans(s, child, key, parent).agg(rows_of("n").alias(name)))
        else:
            rows = bitsets.with_lost(rows, key, keys, f"__{name}")
            counted.append(F.count_if(f"__{name}").alias(name))
    parts = ([rows.agg(*counted)] if counted else []) + apart
    return reduce(DataFrame.crossJoin, parts).select(*links)  # one row each


def orphan_count(s: Star, child: str, key: str, parent: str) -> DataFrame:
    return orphan_counts(s, child, {"orphan_records": (key, parent)})


@query
def dq_fk_txn_customer(s: Star) -> DataFrame:
    return orphan_count(s, "fact_transactions", "customer_id", "dim_customer")


@query
def dq_fk_txn_product(s: Star) -> DataFrame:
    return orphan_count(s, "fact_transactions", "product_id", "dim_product")


@query
def dq_fk_txn_date(s: Star) -> DataFrame:
    return orphan_count(s, "fact_transactions", "date_key", "dim_date")


@query
def dq_fk_service_customer(s: Star) -> DataFrame:
    return orphan_count(s, "fact_service_logs", "customer_id", "dim_customer")


@query
def dq_fk_response_campaign(s: Star) -> DataFrame:
    return orphan_count(s, "fact_campaign_responses", "campaign_id", "dim_campaign")


def value_range(df: DataFrame, c: str, digits: int, bad: Column, median: bool = True) -> DataFrame:
    found = df.agg(
        F.min(c).alias("min_val"), F.max(c).alias("max_val"), avg(c, digits).alias("avg_val"), F.count_if(bad).alias("invalid")
    )
    if not median:
        return found
    middle = percentiles(df, dbl(c), {"median": 0.5}).select(rounded(F.col("median"), 4).alias("median_val"))
    return found.crossJoin(middle)  # one row each


@query
def dq_range_age(s: Star) -> DataFrame:
    return value_range(s.dim_customer, "age", 1, (F.col("age") < 18) | (F.col("age") > 100))


@query
def dq_range_credit_limit(s: Star) -> DataFrame:
    return value_range(s.dim_customer, "credit_limit", 0, F.col("credit_limit") <= 0)


@query
def dq_range_amount(s: Star) -> DataFrame:
    return value_range(s.fact_transactions, "amount", 2, F.col("amount") <= 0)


@query
def dq_range_csat(s: Star) -> DataFrame:
    known = s.fact_service_logs.where("csat_score is not null")
    return value_range(known, "csat_score", 2, ~F.col("csat_score").between(1, 5), median=False)


def distribution(df: DataFrame, key: str) -> DataFrame:
    return share_of_total(df.groupBy(key).agg(n().alias("customers")), "customers", "share_pct")


@query
def dq_dist_status(s: Star) -> DataFrame:
    return distribution(s.dim_customer, "customer_status")


@query
def dq_dist_card(s: Star) -> DataFrame:
    return distribution(s.dim_customer, "card_category")


@query
def dq_funnel_violations(s: Star) -> DataFrame:
    return s.fact_campaign_responses.agg(F.count_if(broken_funnel()).alias("invalid_count"))


@query
def dq_reconciliation(s: Star) -> DataFrame:
    actual = s.fact_transactions.groupBy("customer_id").agg(F.sum("amount").alias("actual"))
    both = s.dim_customer.select("customer_id", "total_trans_amt_12m").join(actual, "customer_id", "left")
    gap = F.abs(F.col("total_trans_amt_12m") - F.coalesce("actual", F.lit(0))).alias("gap")
    return both.select(gap).agg(
        n().alias("customers"), F.count_if(F.col("gap") <= 1).alias("within"),
        F.count_if(F.col("gap") > 1).alias("outside"), avg("gap", 2).alias("avg_gap"), F.max("gap").alias("max_gap"),
    )


@query
def dq_summary(s: Star) -> DataFrame:
    """Six named checks; the funnel check here leaves out the step from contacted to opened."""
    # The names of the checks, and where each is counted.
    bad = {
        "No duplicate customer IDs": "dup__dim_customer",
        "No orphan transactions": "fk__0",
        "No negative transaction amounts": "fact_transactions__positive_amounts",
        "Valid CSAT scores (1-5)": "fact_service_logs__csat_range",
        "Valid customer statuses": "dim_customer__valid_status",
        "Campaign funnel integrity": "fact_campaign_responses__funnel_steps",
    }
    rows = F.array(*(
        F.struct(F.lit(name).alias("check_name"), F.when(F.col(c) == 0, "PASS").otherwise("FAIL").alias("status"))
        for name, c in bad.items()
    ))
    tables = ("dim_customer", "fact_transactions", "fact_service_logs", "fact_campaign_responses")
    return measured(s, tables).select(F.inline(rows))


# The suite.


@query
def dqv_row_minimum(s: Star) -> DataFrame:
    rows = [(t, m) for t, m in MINIMUM_ROWS.items()]
    least = s.spark.createDataFrame(rows, "table_name string, least long")
    found = dq_row_counts(s).join(F.broadcast(least), "table_name").select(
        F.lit("row_count").alias("check"), F.col("row_count").alias("detail"), "table_name", "least"
    )
    return result(found, "dq", "row_count", F.col("table_name"), F.when(F.col("detail") >= F.col("least"), "PASS").otherwise("WARN"))


@query
def dqv_pk_unique(s: Star) -> DataFrame:
    return union([
        result(
            getattr(s, t).groupBy(k).agg(n().alias("n")).where("n > 1").agg(n().alias("detail")).withColumn("check", F.lit(f"pk_{k}")),
            "dq", "primary_key", F.lit(t), zero_or("FAIL"),
        )
        for t, k in PRIMARY_KEYS.items()
    ])


@query
def dqv_nulls(s: Star) -> DataFrame:
    """detail: percentage of nulls."""
    found = []
    for t, columns in CRITICAL.items():
        shares = getattr(s, t).agg(*(F.coalesce(ratio(F.count_if(F.col(c).isNull()) * 100.0, n()), F.lit(0.0)).alias(f"null_{c}") for c in columns))
        rows = unpivot(shares, [f"null_{c}" for c in columns])
        status = F.when(F.col("detail") == 0, "PASS").when(F.col("detail") < NULL_WARN_PCT, "WARN").otherwise("FAIL")
        found.append(result(rows.withColumn("detail", rounded(F.col("detail"), 4)), "dq", "nulls", F.lit(t), status))
    return union(found)


@query
def dqv_foreign_keys(s: Star) -> DataFrame:
    found = []
    for child in dict.fromkeys(child for child, _, _ in FOREIGN_KEYS):
        links = {f"fk_{key}": (key, parent) for t, key, parent in FOREIGN_KEYS if t == child}
        rows = unpivot(orphan_counts(s, child, links), list(links))
        found.append(result(rows, "dq", "foreign_key", F.lit(child), zero_or("FAIL")))
    return union(found)


@query
def dqv_ranges(s: Star) -> DataFrame:
    people = s.dim_customer.agg(
        F.count_if(~F.col("age").between(18, 100)).alias("age_range"),
        F.count_if(~F.col("customer_status").isin(*STATUSES)).alias("valid_status"),
    )
    tickets = s.fact_service_logs.agg(F.count_if(~F.col("csat_score").between(1, 5)).alias("csat_range"))
    sales = s.fact_transactions.agg(F.count_if(F.col("amount") <= 0).alias("positive_amounts"))
    return union([
        result(unpivot(people, ["age_range", "valid_status"]), "dq", "range", F.lit("dim_customer"), zero_or("FAIL")),
        result(unpivot(tickets, ["csat_range"]), "dq", "range", F.lit("fact_service_logs"), zero_or("FAIL")),
        result(unpivot(sales, ["positive_amounts"]), "dq", "range", F.lit("fact_transactions"), zero_or("FAIL")),
    ])


@query
def dqv_funnel(s: Star) -> DataFrame:
    found = s.fact_campaign_responses.agg(F.count_if(broken_funnel()).alias("funnel_logic"))
    return result(unpivot(found, ["funnel_logic"]), "dq", "business_rule", F.lit("fact_campaign_responses"), zero_or("FAIL"))


@query
def dqv_future_dates(s: Star) -> DataFrame:
    later = F.to_date("transaction_date") > F.lit(s.as_of).cast("date")
    found = s.fact_transactions.agg(F.count_if(later).alias("no_future_dates"))
    return result(unpivot(found, ["no_future_dates"]), "dq", "temporal", F.lit("fact_transactions"), zero_or("WARN"))


@query
def dqv_tables_present(s: Star) -> DataFrame:
    """Every table of the model against those that the warehouse's store has."""
    there = s.stored()
    rows = [(t, 0.0 if t in there else 1.0) for t in schema.TABLES]
    found = s.spark.createDataFrame(rows, "t string, detail double").withColumn("check", F.lit("table_exists"))
    return result(found, "dq", "table", F.col("t"), zero_or("FAIL"), critical=True)


def wrong(s: Star) -> dict[str, dict[str, Column]]:
    """What is counted in the rows of each table, by the name of the check."""
    c = F.col
    found = {t: {f"null_{x}": c(x).isNull() for x in CRITICAL.get(t, ())} for t in schema.TABLES}
    found["dim_customer"] |= {"age_range": ~c("age").between(18, 100), "valid_status": ~c("customer_status").isin(*STATUSES)}
    found["fact_service_logs"]["csat_range"] = ~c("csat_score").between(1, 5)
    found["fact_transactions"] |= {
        "positive_amounts": c("amount") <= 0,
        "no_future_dates": F.to_date("transaction_date") > F.lit(s.as_of).cast("date"),
    }
    found["fact_campaign_responses"] |= {"funnel_logic": broken_funnel(), "funnel_steps": broken_funnel(False)}
    return found


def measured(s: Star, tables: tuple[str, ...] = tuple(schema.TABLES)) -> DataFrame:
    """One row with, for each of tables, <table>__rows and <table>__<check>, dup__<table> (keys that repeat) and
    fk__<number> (rows whose key the parent lacks, where both are of tables). Each table is read once."""
    counted, frames = [], []
    links = {i: fk for i, fk in enumerate(FOREIGN_KEYS) if fk[0] in tables and fk[2] in tables}
    for t, conditions in wrong(s).items():
        if t not in tables:
            continue
        names = [f"{t}__rows", *(f"{t}__{name}" for name in conditions)]
        flags = [F.lit(1).cast("long"), *(F.coalesce(rule.cast("long"), F.lit(0).cast("long")) for rule in conditions.values())]
        counted += names
        keys = [(f"fk__{i}", parent, key) for i, (child, key, parent) in links.items() if child == t]
        keys += [(f"dim__{t}", t, PRIMARY_KEYS[t])] if t in PRIMARY_KEYS else []
        # A row stands once under each of its keys; what is wrong with it counts under the first.
        places = [
            F.struct(
                F.lit(parent).alias("parent"), F.col(key).cast("long").alias("key"), F.lit(role).alias("role"),
                *((flag if first else F.lit(0).cast("long")).alias(name) for flag, name in zip(flags, names)),
            )
            for first, (role, parent, key) in zip([True] + [False] * len(keys), keys)
        ]
        rows = getattr(s, t).select(F.inline(F.array(*places)))
        roles = [F.count_if(F.col("role") == role).alias(role) for role, _, _ in keys]
        frames.append(rows.groupBy("parent", "key").agg(*(F.sum(name).alias(name) for name in names), *roles))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    dims, fks = [f"dim__{t}" for t in PRIMARY_KEYS if t in tables], [f"fk__{i}" for i in links]
    by_key = every.groupBy("parent", "key").agg(*(rows_of(name).alias(name) for name in [*counted, *dims, *fks]))
    there = lambda parent: F.col(f"dim__{parent}") > 0
    lost = [F.when(F.col("key").isNotNull() & ~there(parent), F.col(f"fk__{i}")) for i, (_, _, parent) in links.items()]
    return by_key.agg(
        *(rows_of(name).alias(name) for name in counted),
        *(F.count_if(F.col(name) > 1).alias(name.replace("dim__", "dup__", 1)) for name in dims),
        *(F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in zip(fks, lost)),
    )


def checks(s: Star) -> list[tuple[str, str, str, Column, Column]]:
    """(category, table, check, detail, status) of the suite, over the columns of measured."""
    c = F.col
    zero = lambda x, bad: F.when(x == 0, "PASS").otherwise(bad)
    found = []
    for t, least in MINIMUM_ROWS.items():
        found.append(("row_count", t, "row_count", c(f"{t}__rows"), F.when(c(f"{t}__rows") >= least, "PASS").otherwise("WARN")))
    for t, key in PRIMARY_KEYS.items():
        found.append(("primary_key", t, f"pk_{key}", c(f"dup__{t}"), zero(c(f"dup__{t}"), "FAIL")))
    for t, names in CRITICAL.items():
        for name in names:
            share = rounded(F.coalesce(ratio(c(f"{t}__null_{name}") * 100.0, c(f"{t}__rows")), F.lit(0.0)), 4)
            status = F.when(share == 0, "PASS").when(share < NULL_WARN_PCT, "WARN").otherwise("FAIL")
            found.append(("nulls", t, f"null_{name}", share, status))
    for i, (child, key, _) in enumerate(FOREIGN_KEYS):
        found.append(("foreign_key", child, f"fk_{key}", c(f"fk__{i}"), zero(c(f"fk__{i}"), "FAIL")))
    rules = (
        ("range", "dim_customer", "age_range", "FAIL"), ("range", "dim_customer", "valid_status", "FAIL"),
        ("range", "fact_service_logs", "csat_range", "FAIL"), ("range", "fact_transactions", "positive_amounts", "FAIL"),
        ("business_rule", "fact_campaign_responses", "funnel_logic", "FAIL"),
        ("temporal", "fact_transactions", "no_future_dates", "WARN"),
    )
    found += [(category, t, name, c(f"{t}__{name}"), zero(c(f"{t}__{name}"), bad)) for category, t, name, bad in rules]
    return found


def suite_rows(s: Star, *categories: str) -> DataFrame:
    """The checks of the categories, or of all, but for that of the tables themselves."""
    rows = F.array(*(
        F.struct(
            F.lit("dq").alias("suite"), F.lit(category).alias("category"), F.lit(table).alias("table"), F.lit(name).alias("check"),
            status.alias("status"), detail.cast("double").alias("detail"), F.lit(False).alias("is_critical"),
        )
        for category, table, name, detail, status in checks(s)
        if category in categories or not categories
    ))
    return measured(s).select(F.inline(rows))


def dq_suite(s: Star) -> DataFrame:
    return dqv_tables_present(s).unionByName(suite_rows(s))


def scored(results: DataFrame, gate: float) -> DataFrame:
    """Score (WARN counts as passed), totals and whether the score reaches the gate without a critical failure."""
    fails = F.count_if(F.col("status") == "FAIL")
    critical = F.count_if((F.col("status") == "FAIL") & F.col("is_critical"))
    return results.agg(
        n().alias("total"), F.count_if(F.col("status") != "FAIL").alias("passed"), fails.alias("failed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"), critical.alias("critical_failures"),
        pct(F.count_if(F.col("status") != "FAIL"), n()).alias("score"),
    ).withColumn("ready", (F.col("score") >= gate) & (F.col("critical_failures") == 0))


@query
def dqv_summary(s: Star) -> DataFrame:
    return scored(dq_suite(s), DQ_GATE)
