"""Calendar dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schema

# Holidays by month and day.
FIXED_HOLIDAYS = {(1, 26): "Republic Day", (8, 15): "Independence Day", (10, 2): "Gandhi Jayanti"}
#: The festival season, from and to (month, day).
SEASON = "Diwali Season"
SEASON_FROM, SEASON_TO = (10, 20), (11, 5)
FISCAL_FIRST_MONTH = 4
#: Days of a month up to and from which salaries are paid.
SALARY_TO, SALARY_FROM = 7, 25


def holiday_name(day: Column) -> Column:
    """A fixed holiday's name, else the season's name within the season, else null."""
    place = F.month(day) * 100 + F.dayofmonth(day)
    out = F
    for (m, d), name in FIXED_HOLIDAYS.items():
        out = out.when(place == m * 100 + d, F.lit(name))
    first, last = (m * 100 + d for m, d in (SEASON_FROM, SEASON_TO))
    return out.when(place.between(first, last), F.lit(SEASON))


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for each day from start to end, both included."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    d = F.col("full_date")
    fiscal_year = F.year(d) + (F.month(d) >= FISCAL_FIRST_MONTH).cast("int")
    fiscal_quarter = F.floor(F.pmod(F.month(d) - FISCAL_FIRST_MONTH, F.lit(12)) / 3) + 1
    rows = days.select(
        date_key(d).alias("date_key"),
        d,
        F.weekday(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.concat(F.lit("Q"), F.quarter(d)).alias("quarter_name"),
        F.year(d).alias("year"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        holiday_name(d).isNotNull().alias("is_holiday"),
        holiday_name(d).alias("holiday_name"),
        fiscal_year.alias("fiscal_year"),
        fiscal_quarter.cast("int").alias("fiscal_quarter"),
        F.concat(F.lit("FY"), fiscal_year, F.lit("-Q"), fiscal_quarter).alias("fiscal_quarter_name"),
        (F.dayofmonth(d) == 1).alias("is_month_start"),
        (d == F.last_day(d)).alias("is_month_end"),
        ((F.dayofmonth(d) <= SALARY_TO) | (F.dayofmonth(d) >= SALARY_FROM)).alias("is_salary_week"),
    )
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.DIM_DATE))
