"""Small hand-made cases for transforms, ranking, files and bands."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import schema
from ledgerline.functions.columns import age_band, band, rounded
from ledgerline.functions.ranking import with_percentile_rank, with_position, with_tile
from ledgerline.operators import transforms as X
from ledgerline.operators.calendar import dim_date
from ledgerline.plans.quality import broken_funnel
from ledgerline.plans.value import rfm_segment
from ledgerline.sources import files


def values(df, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()]


def test_position_and_tiles_equal_windows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(257)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = dict(values(with_position(df, [F.col("v"), F.col("id")]), "id", "position"))
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    df.createOrReplaceTempView("tiles")
    for k in (1, 3, 4, 5, 300):
        want = dict(values(spark.sql(f"SELECT id, ntile({k}) OVER (ORDER BY v, id) AS t FROM tiles"), "id", "t"))
        assert dict(values(with_tile(df, [F.col("v"), F.col("id")], k, "t"), "id", "t")) == want


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None)], "id int, v int")
    got = dict(values(with_percentile_rank(df, "v", "p"), "id", "p"))
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_rounding_is_half_up_on_the_double(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,)], "x double")
    assert values(df, rounded(F.col("x"), 2).alias("r")) == [1.0, 2.5, -2.5]
    assert values(df, rounded(F.col("x"), 0).alias("r")) == [1.0, 3.0, -2.0]


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(29,), (30,), (59,), (60,)], "age int")
    assert values(df, age_band().alias("b")) == ["18-29", "30-39", "50-59", "60+"]
    df = spark.createDataFrame([(12.0,), (12.01,), (None,)], "h double")
    assert values(df, band("h", (12, "a"), otherwise="b", closed=True).alias("x")) == ["a", "b", "b"]


def test_allocation_is_exact(spark):
    rows = [("a", i, 1.0, Decimal("100.00")) for i in range(3)] + [("b", 0, 0.0, Decimal("5.00"))]
    df = spark.createDataFrame(rows, "g string, i int, w double, t decimal(15,2)")
    out = X.allocate_total(df, "g", "w", "t", ["i"], "part")
    got = {(r.g, r.i): r.part for r in out.collect()}
    assert [got["a", i] for i in range(3)] == [Decimal("33.33"), Decimal("33.33"), Decimal("33.34")]


def test_high_value_is_strictly_above_the_quartile(spark):
    df = spark.createDataFrame([("c", float(i)) for i in range(1, 6)], "merchant_category string, amount double")
    assert sorted(values(X.flag_high_value(df), "amount", "is_high_value")) == [(1, False), (2, False), (3, False), (4, False), (5, True)]


def test_risk_tiers(spark):
    rows = [("Churned", 0.1, 0), ("Active", 0.9, 4), ("Active", 0.6, 0), ("Active", 0.5, 3), ("Active", 0.5, 2)]
    df = spark.createDataFrame(rows, "customer_status string, credit_utilization_ratio double, months_inactive_12m int")
    assert values(df, X.risk_category().alias("r")) == ["High", "High", "Medium", "Medium", "Low"]


def test_month_ends_are_clipped(spark):
    df = spark.sql("SELECT DATE '2024-03-31' AS d, 1 AS m")
    assert str(values(df, X.customer_since(F.col("d"), F.col("m")).alias("s"))[0]) == "2024-02-29"


def test_funnel_order(spark):
    rows = [(True, True, True, True), (True, False, True, False), (False, True, False, False)]
    df = spark.createDataFrame(rows, "was_contacted boolean, was_opened boolean, was_clicked boolean, was_accepted boolean")
    assert values(df, broken_funnel().alias("b")) == [False, True, True]
    assert values(df, broken_funnel(False).alias("b")) == [False, True, False]


def test_rfm_segments(spark):
    df = spark.createDataFrame([(5, 5, 5), (3, 3, 3), (5, 1, 5), (1, 5, 1), (1, 1, 5), (1, 1, 1), (3, 1, 3)], "r_score int, f_score int, m_score int")
    assert [v[0] for v in values(df, rfm_segment().alias("s"))] == list("1234567")


def test_calendar(spark):
    days = {str(r.full_date): r for r in dim_date(spark, "2023-12-31", "2024-11-06").collect()}
    assert len(days) == 312
    d = days["2024-01-26"]
    assert (d.date_key, d.day_of_week, d.holiday_name, d.fiscal_year, d.fiscal_quarter, d.is_salary_week) == (20240126, 4, "Republic Day", 2024, 4, True)
    assert days["2024-04-01"].fiscal_year == 2025 and days["2024-04-01"].fiscal_quarter == 1
    assert days["2024-11-05"].is_holiday and not days["2024-11-06"].is_holiday
    assert days["2024-02-29"].is_month_end and days["2023-12-31"].is_weekend


def test_files(spark, tmp_path):
    one = {c: 1 for c in files.CUSTOMER_COLUMNS} | {
        "Gender": "F", "Attrition_Flag": "Attrited Customer", "Income_Category": "$120K +", "Education_Level": "Unknown",
        "Marital_Status": "Single", "Card_Category": "Blue", "Credit_Limit": 100.25, "Months_on_book": 12,
    }
    spark.createDataFrame([one]).withColumn("Naive_x", F.lit(1)).write.csv(f"{tmp_path}/c", header=True)
    raw = files.read_customers(spark, f"{tmp_path}/c")
    assert "Naive_x" not in raw.columns
    row = files.localise(raw, "2024-12-31").collect()[0]
    assert (row.gender, row.customer_status, row.income_bracket, row.education_level) == ("Female", "Churned", "Above ₹15L", None)
    assert row.credit_limit == Decimal("8300.00") and row.total_trans_amt_12m == Decimal("83.00")
    assert str(row.customer_since) == "2023-12-31" and row.risk_category == "High"
    spark.createDataFrame([(1,)], "CLIENTNUM int").write.csv(f"{tmp_path}/bad", header=True)
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_customers(spark, f"{tmp_path}/bad")
    lines = spark.createDataFrame([("2024-01-01 10:00:00", "travel", 5.0, "m"), ("2024-01-01 11:00:00", "odd", 5.0, "m")], list(files.TRANSACTION_COLUMNS))
    lines.write.csv(f"{tmp_path}/t", header=True)
    got = files.read_transactions(spark, [f"{tmp_path}/t", f"{tmp_path}/none"])
    assert sorted(values(got, "merchant_category")) == ["Miscellaneous", "Travel"]
    with pytest.raises(FileNotFoundError):
        files.read_transactions(spark, [f"{tmp_path}/none"])
    profile = X.profile_categories(got)
    files.write_profile({"categories": profile}, f"{tmp_path}/p")
    assert files.read_profile(spark, f"{tmp_path}/p", "categories", profile.schema).count() == 2
    assert files.load_table(profile, "profile_table") == 2 == files.load_table(profile, "profile_table")
    assert files.missing_tables(spark, ("profile_table", "no_table")) == ["no_table"]
    files.write_csv(profile, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    assert files.seed_products(spark).where("interest_rate is null").count() == 2


def test_allocation_of_a_large_group_and_of_none(spark):
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit(3))).alias("g"),
        "id", (F.col("id") % 13 + 1).cast("decimal(15,2)").alias("w"), F.lit("1000.01").cast("decimal(15,2)").alias("total"),
    )
    got = X.allocate_total(rows, "g", "w", "total", ["id"], "part")
    assert got.columns == ["g", "id", "w", "total", "part"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    sums = {r.g: (r.n, r.s) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.sum("part").alias("s")).collect()}
    assert sums == {7: (270_000, Decimal("1000.01")), 3: (24_000, Decimal("1000.01")), None: (6_000, Decimal("1000.01"))}
    last = got.where("g = 7").agg(F.max_by("part", "id").alias("last"), F.max(F.abs(F.when(F.col("id") < 299_999, F.col("part")))).alias("most")).first()
    assert last.most <= Decimal("0.01") and last["last"] != last.most


def test_seeded_campaigns(spark):
    got = files.seed_campaigns(spark)
    assert got.schema.names == [f.name for f in schema.DIM_CAMPAIGN] and got.count() == 5
    assert got.agg(F.sum("budget")).first()[0] == 2_650_000 and got.where("end_date > start_date").count() == 5
