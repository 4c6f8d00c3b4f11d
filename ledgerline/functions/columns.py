"""Column helpers whose results do not depend on the engine that evaluates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import labels


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up on the double itself: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = 10.0**digits
    return (F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return dbl(a) / F.nullif(dbl(b), F.lit(0.0))


def pct(a: Column, b: Column) -> Column:
    return rounded(ratio(dbl(a) * F.lit(100.0), b), 2)


def n() -> Column:
    return F.count(F.lit(1))


def mean(c: str | Column) -> Column:
    """Average of exact values: their exact sum as a double over their number."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def avg(c: str | Column, digits: int) -> Column:
    return rounded(mean(c), digits)


def total(c: str | Column, digits: int | None = None) -> Column:
    x = dbl(F.sum(col(c)))
    return x if digits is None else rounded(x, digits)


def share_of_total(df: DataFrame, value: str, name: str, *partition: str) -> DataFrame:
    """df (an aggregate, so small) with value as a percentage of its sum over all rows or those of the partition."""
    w = Window.partitionBy(*partition)
    return df.withColumn(name, pct(F.col(value), F.sum(value).over(w)))


def growth(df: DataFrame, value: str, previous: str, name: str, *order: str) -> DataFrame:
    """df (an aggregate by period) with the previous period's value and the change in percent; rows without a period last."""
    w = Window.orderBy(*(F.col(c).asc_nulls_last() for c in order))
    df = df.withColumn(previous, F.lag(value).over(w))
    change = rounded((dbl(value) - dbl(previous)) * F.lit(100.0) / dbl(previous), 2)
    return df.withColumn(name, F.when(F.col(previous) > 0, change))


def band(c: str | Column, *edges: tuple[float, str], otherwise: str, closed: bool = False) -> Column:
    """The label of the first edge that c lies below (or at, if closed); null lies below none."""
    out = F
    for edge, label in edges:
        test = col(c) <= edge if closed else col(c) < edge
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def banded(c: str | Column, bands: tuple, closed: bool = False) -> Column:
    """band with a list of labels.py."""
    edges, otherwise = bands
    return band(c, *edges, otherwise=otherwise, closed=closed)


def tile_label(tile: str, labels: tuple[str, ...]) -> Column:
    """The label of a tile, numbered from 1."""
    return F.element_at(F.array(*map(F.lit, labels)), F.col(tile).cast("int"))


def longs(df: DataFrame) -> DataFrame:
    """df with all integer columns as bigint and decimals as double, as every query returns them."""
    return df.select(
        *(
            F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint")
            else F.col(name).cast("double").alias(name) if kind.startswith("decimal")
            else F.col(name)
            for name, kind in df.dtypes
        )
    )


def age_band(c: str = "age") -> Column:
    return banded(c, labels.AGE)


def churned() -> Column:
    return F.count_if(F.col("customer_status") == "Churned")


def active() -> Column:
    return F.count_if(F.col("customer_status") == "Active")


def churn_pct() -> Column:
    return pct(churned(), n())
