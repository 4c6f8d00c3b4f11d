"""Customer and transaction transforms: mapping, scaling, scores, flags, allocation, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import col, n, pct, ratio, rounded
from ledgerline.functions.ranking import GROUPS, percentiles, with_percentile_rank

# Codes of the raw files and their labels.
STATUS = {"Existing Customer": "Active", "Attrited Customer": "Churned"}
GENDER = {"M": "Male", "F": "Female"}
INCOME = {
    "Less than $40K": "Below ₹3L", "$40K - $60K": "₹3L - ₹5L", "$60K - $80K": "₹5L - ₹8L",
    "$80K - $120K": "₹8L - ₹15L", "$120K +": "Above ₹15L", "Unknown": "Unknown",
}
TIER_PRODUCT = {"Blue": 4, "Silver": 5, "Gold": 6, "Platinum": 7}
MERCHANT_CATEGORY = {
    "grocery_pos": "Groceries", "grocery_net": "Online Groceries", "shopping_pos": "Retail Shopping",
    "shopping_net": "Online Shopping", "food_dining": "Food & Dining", "entertainment": "Entertainment",
    "gas_transport": "Fuel & Transport", "health_fitness": "Health & Fitness", "home": "Home & Living",
    "kids_pets": "Kids & Pets", "misc_net": "Online Services", "misc_pos": "Miscellaneous",
    "personal_care": "Personal Care", "travel": "Travel",
}
UNMAPPED_CATEGORY = "Miscellaneous"
MONEY_FACTOR = "83.0"
HIGH_INCOMES = ("₹8L - ₹15L", "Above ₹15L")


def mapped(c: str | Column, table: dict, default: object = None) -> Column:
    """table[c], else default."""
    pairs = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    out = F.try_element_at(pairs, col(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def sentinel_to_null(c: str | Column, sentinel: str = "Unknown") -> Column:
    return F.nullif(col(c), F.lit(sentinel))


def scale_money(c: str | Column, factor: str = MONEY_FACTOR, digits: int = 2) -> Column:
    """c times factor, rounded half up to digits (negative: to tens, hundreds) as exact decimal."""
    product = col(c).cast("decimal(15,2)") * F.lit(factor).cast("decimal(10,4)")
    return F.round(product, digits).cast("decimal(15,2)")


def customer_since(as_of: Column, months: Column) -> Column:
    """as_of less a number of months; a day the month lacks becomes its last."""
    return F.add_months(as_of, -months)


def risk_category(status: str = "customer_status", utilization: str = "credit_utilization_ratio", inactive: str = "months_inactive_12m") -> Column:
    u, m = F.col(utilization), F.col(inactive)
    high = (F.col(status) == "Churned") | ((u > 0.8) & (m > 3))
    return F.when(high, "High").when((u > 0.5) | (m > 2), "Medium").otherwise("Low")


def card_tier(customers: DataFrame, income_score: Column, spend: str = "total_trans_amt_12m", tenure: str = "customer_tenure_months") -> DataFrame:
    """customers with spend_pct, tenure_pct, card_score and card_category (percentile of 1.4 income score +
    2.5 spend + 2.0 tenure percentile rank: .95 Platinum, .85 Gold, .40 Silver, else Blue)."""
    ranked = with_percentile_rank(with_percentile_rank(customers, spend, "spend_pct"), tenure, "tenure_pct")
    scored = ranked.withColumn(
        "card_score", income_score.cast("double") * 1.4 + F.col("spend_pct") * 2.5 + F.col("tenure_pct") * 2.0
    )
    place = F.col("card_pct")
    tier = F.when(place >= 0.95, "Platinum").when(place >= 0.85, "Gold").when(place >= 0.40, "Silver").otherwise("Blue")
    return with_percentile_rank(scored, "card_score", "card_pct").withColumn("card_category", tier)


def products_held(income_score: Column, spend_pct: str = "spend_pct", tenure_pct: str = "tenure_pct", card: str = "card_category") -> Column:
    """1 and one more for each of: income score of 3 or more, spend above .6, above .9, tenure above .6, Gold or
    Platinum card; at most 6."""
    rules = [
        income_score >= 3, F.col(spend_pct) > 0.6, F.col(spend_pct) > 0.9, F.col(tenure_pct) > 0.6,
        F.col(card).isin("Gold", "Platinum"),
    ]
    held = F.lit(1)
    for rule in rules:
        held = held + F.coalesce(rule, F.lit(False)).cast("int")
    return F.least(F.greatest(held, F.lit(1)), F.lit(6))


def hash_name(key: str | Column, pool: list[str]) -> Column:
    """A name that depends on the key alone: the first 8 hexadecimal digits of its MD5 modulo the pool's size."""
    place = F.conv(F.substring(F.md5(col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.element_at(F.array(*map(F.lit, pool)), (place % len(pool) + 1).cast("int"))


def flag_high_value(
    transactions: DataFrame, amount: str = "amount", group: str = "merchant_category", priced: DataFrame | None = None
) -> DataFrame:
    """transactions with is_high_value: amount above the exact third quartile of its group. One row a group is
    joined back, by broadcast up to GROUPS groups, so that a group's rows stay where they are; rows without a group are
    left out. priced: the same groups and amounts where they are cheaper to read."""
    source = transactions if priced is None else priced
    p75 = percentiles(source, F.col(amount).cast("double"), {"__p75": 0.75}, group)
    few = p75.limit(GROUPS + 1).collect()
    if len(few) <= GROUPS:
        p75 = F.broadcast(p75.sparkSession.createDataFrame(few, p75.schema))
    return (
        transactions.join(p75, group)
        .withColumn("is_high_value", F.col(amount).cast("double") > F.col("__p75"))
        .drop("__p75")
    )


def allocate_total(rows: DataFrame, group: str, weight: str, total: str, order: list[str], name: str) -> DataFrame:
    """rows with name: their part of the group's total in proportion to weight, in cents, such that a group's parts
    sum to its total exactly; the last row by order takes the residue. order must be unique within a group.

    Weights are summed up by group, then the rounded parts and the last row; rows meet these sums in joins, so a group
    that has most rows is spread over tasks. A null group is a group.
    """
    place = F.struct(*order)

    def beside(rows: DataFrame, sums: DataFrame) -> DataFrame:
        return rows.join(sums, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")

    by_group = lambda df: df.groupBy(F.col(group).alias("__group"))
    weighed = beside(rows, by_group(rows).agg(F.sum(weight).alias("__weight")))
    part = rounded(F.col(weight).cast("double") * ratio(F.col(total), F.col("__weight")), 2).cast("decimal(15,2)")
    parted = weighed.withColumn("__part", part)
    ends = by_group(parted).agg(F.sum("__part").alias("__parts"), F.max(place).alias("__last"))
    residue = F.when(place.eqNullSafe(F.col("__last")), F.col(total).cast("decimal(15,2)") - F.col("__parts")).otherwise(0)
    whole = beside(parted, ends).withColumn(name, (F.col("__part") + residue).cast("decimal(15,2)"))
    return whole.drop("__weight", "__part", "__parts", "__last")


def campaign_audience(customers: DataFrame, high_incomes: tuple[str, ...] = HIGH_INCOMES, low_incomes: tuple[str, ...] = ("Below ₹3L", "Unknown")) -> DataFrame:
    """(campaign_id, customer_id, base_score) of the five targeting rules; a customer may meet several."""
    inactive = F.col("months_inactive_12m")
    floor = lambda x: F.greatest(F.lit(0.05), x)
    rules = [
        (1, F.col("credit_utilization_ratio") > 0.7, floor(F.lit(0.40) - inactive * 0.05)),
        (2, (F.col("card_category") == "Blue") & F.col("income_bracket").isin(*high_incomes), F.lit(0.25)),
        (3, inactive >= 3, floor(F.lit(0.30) - inactive * 0.03)),
        (4, (F.col("total_products_held") <= 2) & ~F.col("income_bracket").isin(*low_incomes), F.lit(0.15)),
        (5, (F.col("customer_tenure_months") >= 36) & (F.col("customer_status") == "Active"), F.lit(0.35)),
    ]
    hits = F.filter(
        F.array(*(F.struct(F.lit(i).alias("campaign_id"), F.when(rule, rounded(score, 4)).alias("base_score")) for i, rule, score in rules)),
        lambda x: x["base_score"].isNotNull(),
    )
    return customers.select("customer_id", F.inline(hits))


def profile_categories(t: DataFrame, c: str = "merchant_category") -> DataFrame:
    w = Window.partitionBy()
    return t.groupBy(c).agg(n().alias("transactions")).withColumn(
        "proportion", rounded(ratio(F.col("transactions"), F.sum("transactions").over(w)), 6)
    )


def profile_amounts(t: DataFrame, c: str = "merchant_category", amount: str = "amount") -> DataFrame:
    """mean, sample standard deviation, minimum, quartiles and maximum of amounts in each category."""
    x = F.col(amount).cast("double")
    quartiles = percentiles(t, x, {"p25": 0.25, "median": 0.5, "p75": 0.75}, c)
    moments = t.groupBy(F.col(c).alias("__c")).agg(
        rounded(ratio(F.sum(amount), F.count(amount)), 6).alias("mean"),
        rounded(F.stddev_samp(x), 4).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    both = quartiles.join(moments, F.col(c).eqNullSafe(F.col("__c")))
    return both.select(c, "mean", "std", "min", *(rounded(F.col(q), 6).alias(q) for q in ("p25", "median", "p75")), "max")


def profile_weights(t: DataFrame, part: Column, name: str) -> DataFrame:
    """Share of rows for each value of part (hour, weekday, month)."""
    w = Window.partitionBy()
    return (
        t.groupBy(part.cast("bigint").alias(name)).agg(n().alias("transactions"))
        .withColumn("weight", rounded(ratio(F.col("transactions"), F.sum("transactions").over(w)), 6))
    )


def profile_merchants(t: DataFrame, c: str = "merchant_category", merchant: str = "merchant_name", most: int = 10) -> DataFrame:
    """The first `most` distinct merchants of a category in order, joined by "|"."""
    distinct = t.where(F.col(merchant).isNotNull()).groupBy(c, merchant).agg(F.lit(1))
    ranked = distinct.withColumn("__n", F.row_number().over(Window.partitionBy(c).orderBy(merchant))).where(F.col("__n") <= most)
    return ranked.groupBy(c).agg(F.array_join(F.array_sort(F.collect_list(merchant)), "|").alias("merchants"), n().alias("n_merchants"))


def reconcile_load(customers: DataFrame, transactions: DataFrame, tolerance: str = "1.00") -> DataFrame:
    """How many customers' stored totals match the sum of their transactions."""
    actual = transactions.groupBy("customer_id").agg(F.sum("amount").alias("actual"), n().alias("actual_ct"))
    both = customers.select("customer_id", "total_trans_amt_12m", "total_trans_ct_12m").join(actual, "customer_id", "left")
    gap = F.abs(F.col("total_trans_amt_12m") - F.coalesce("actual", F.lit(0)))
    near = gap <= F.lit(tolerance).cast("decimal(15,2)")
    return both.agg(
        n().alias("customers"),
        F.count_if(near).alias("reconciled"),
        F.count_if(F.col("total_trans_ct_12m") == F.coalesce("actual_ct", F.lit(0))).alias("counts_equal"),
        pct(F.count_if(near), n()).alias("reconciled_pct"),
    )
