"""Stored profiles of transactions that grow by batches: a new file is profiled alone, no old one is read again.

A profile is a table of partial results, of four parts: counts and exact sums of amounts by category and bin, counts by
hour, weekday and month, the first merchants of each category, and one row with the number of rows. Parts of several
batches merge by adding, and least, greatest and first values by comparing, so a merged profile equals that of all rows.

Amounts are cents. A bin holds the amounts whose logarithms to base GROWTH have one ceiling (zero has its own), so the
values of a bin lie within a factor of GROWTH, decimals of 15 digits meet at most 6,946 bins a category, and the amounts
that a quartile is interpolated between are known within 1 %. Means, deviations, extremes, shares and weights are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.columns import n, ratio, rounded

GROWTH = 1.01
#: No amount of a cent or more has a bin below this number, without its sign.
LOWEST = 500
#: Merchants that are kept of a category.
MERCHANTS = 10
KEYS = ("part", "category", "bin", "merchant", "hour", "weekday", "month")
KIND = T.StructType([
    T.StructField(name, kind)
    for kind, names in (
        (T.StringType(), ("part", "category", "merchant")), (T.IntegerType(), ("bin", "hour", "weekday", "month")),
        (T.LongType(), ("n",)), (T.DecimalType(38, 2), ("total",)), (T.DecimalType(38, 4), ("squares",)),
        (T.DecimalType(15, 2), ("least", "greatest")),
    )
    for name in names
])


def bin_of(amount: Column) -> Column:
    """The number of amount's bin; numbers have the order of the amounts. Null for null."""
    size = F.ceil(F.log(F.abs(amount).cast("double")) / F.lit(math.log(GROWTH))) + LOWEST
    return F.when(amount == 0, 0).otherwise(F.signum(amount.cast("double")) * size).cast("int")


def profile(
    t: DataFrame, category: str = "merchant_category", amount: str = "amount", merchant: str = "merchant_name",
    at: str = "transaction_date",
) -> DataFrame:
    """The profile of t, in columns of KIND. Null categories, amounts and times are counted as null, null merchants left
    out; an amount that is no decimal of 15 digits counts as null. A table without rows has the row of part "rows" alone."""
    cents = F.col(amount).try_cast("decimal(15,2)")
    of = F.col(category).cast("string").alias("category")
    amounts = t.select(of, cents.alias("x")).groupBy("category", bin_of(F.col("x")).alias("bin")).agg(
        n().alias("n"), F.sum("x").cast("decimal(38,2)").alias("total"),
        F.sum(F.col("x") * F.col("x")).cast("decimal(38,4)").alias("squares"),
        F.min("x").alias("least"), F.max("x").alias("greatest"),
    )
    times = t.groupBy(
        F.hour(at).alias("hour"), F.weekday(F.to_date(at)).alias("weekday"), F.month(F.to_date(at)).alias("month")
    ).agg(n().alias("n"))
    merchants = _first(t.select(of, F.col(merchant).cast("string").alias("merchant")).where("merchant IS NOT NULL").distinct())
    parts = {"amounts": amounts, "times": times, "merchants": merchants, "rows": t.agg(n().alias("n"))}
    found = None
    for name, df in parts.items():
        df = df.withColumn("part", F.lit(name))
        row = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in KIND))
        found = row if found is None else found.unionByName(row)
    return found


def _first(merchants: DataFrame) -> DataFrame:
    """The first MERCHANTS of each category; merchants are distinct."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("merchant"))
    return merchants.withColumn("__place", place).where(F.col("__place") <= MERCHANTS).drop("__place")


def merged(profiles: DataFrame) -> DataFrame:
    """One profile of the rows of several, which may come in any order and in any grouping."""
    sums = (F.sum(c).cast(KIND[c].dataType).alias(c) for c in ("n", "total", "squares"))
    named = profiles.where("part = 'merchants'").select("category", "merchant").distinct()
    added = profiles.where("part <> 'merchants'").groupBy(*KEYS).agg(*sums, F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return added.unionByName(_first(named).withColumn("part", F.lit("merchants")), allowMissingColumns=True)


def add(found: DataFrame, folder: str, batch: str) -> None:
    """Store a batch's profile (of profile) below folder, as JSON lines; a batch of that name is replaced, others stay.

    The batch is written aside and put in place when it is whole, so a job that fails leaves what was there, and one that
    runs twice counts once. An empty batch is stored as its row of part "rows"."""
    named = found.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The merged profile of all batches below folder."""
    kind = T.StructType([*KIND.fields, T.StructField("batch", T.StringType())])
    return merged(spark.read.schema(kind).json(folder))


# What a profile says.


def categories(p: DataFrame) -> DataFrame:
    """Rows of each category and its share of all."""
    by = p.where("part = 'amounts'").groupBy("category").agg(F.sum("n").alias("transactions"))
    all_rows = F.sum("transactions").over(Window.partitionBy())  # one row a category
    return by.withColumn("proportion", rounded(ratio(F.col("transactions"), all_rows), 6))


def amounts(p: DataFrame) -> DataFrame:
    """mean, sample standard deviation, minimum, quartiles and maximum of each category, null if it has no amount.

    A quartile is interpolated between the amounts at the two places about it; each is taken to lie between the least and
    the greatest amount of its bin in proportion to its place among them, so it misses by less than its bin is wide."""
    by = Window.partitionBy("category")
    upto = F.sum("k").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    c = lambda name: F.col(name).cast("double")
    bins = p.where("part = 'amounts'").select(
        "category", "bin", "least", "greatest", "total", F.when(F.col("bin").isNotNull(), F.col("n")).alias("k"),
        F.when(F.col("bin").isNotNull(), c("squares") - c("total") * c("total") / c("n")).alias("within"),
    ).withColumn("__all", F.sum("k").over(by)).withColumn("__mean", F.sum("total").over(by).cast("double") / F.nullif(c("__all"), F.lit(0.0)))
    bins = bins.withColumn("__before", upto - F.col("k"))
    # Squares about the mean: those about each bin's own, and the bins' about the whole.
    spread = F.sum(F.greatest(F.col("within"), F.lit(0.0)) + c("k") * F.pow(c("total") / c("k") - F.col("__mean"), 2))

    def at(place: Column) -> Column:
        """The amount at a whole place (from 0)."""
        here = (F.col("__before") <= place) & (place < F.col("__before") + F.col("k"))
        part = (place - F.col("__before")) / F.greatest(F.col("k") - 1, F.lit(1))
        return F.max(F.when(here, c("least") + (c("greatest") - c("least")) * part))

    def quartile(share: float) -> Column:
        place = (F.col("__all") - 1) * F.lit(share)
        low, high, past = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return rounded(low + (high - low) * past, 6)

    return bins.groupBy("category").agg(
        rounded(F.max("__mean"), 6).alias("mean"),
        rounded(F.sqrt(spread / F.nullif(F.max("__all") - 1, F.lit(0))), 4).alias("std"),
        F.min("least").cast("double").alias("min"),
        *(quartile(share).alias(name) for name, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))),
        F.max("greatest").cast("double").alias("max"),
    )


def weights(p: DataFrame, part: str) -> DataFrame:
    """Rows of each hour, weekday or month and their share of all."""
    by = p.where("part = 'times'").groupBy(F.col(part).cast("bigint").alias(part)).agg(F.sum("n").alias("transactions"))
    all_rows = F.sum("transactions").over(Window.partitionBy())  # at most 25 rows
    return by.withColumn("weight", rounded(ratio(F.col("transactions"), all_rows), 6))


def merchants(p: DataFrame) -> DataFrame:
    """The first merchants of each category in order, joined by "|"."""
    kept = _first(p.where("part = 'merchants'").select("category", "merchant"))
    return kept.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("merchant")), "|").alias("merchants"), n().alias("n_merchants"))
