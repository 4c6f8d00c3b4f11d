"""Suites against their single checks, on good and on damaged warehouses, and stored warehouses."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerline import schema
from ledgerline.functions.ranking import percentiles
from ledgerline.operators.calendar import dim_date
from ledgerline.plans import business, quality
from ledgerline.sources import adapter, files, storage, warehouse

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["check"], r["table"], r["category"], r["status"], r["detail"], r["is_critical"]) for r in df.collect())


def near(a, b):
    assert [x[:4] + x[5:] for x in a] == [x[:4] + x[5:] for x in b]
    assert [x[4] for x in a] == pytest.approx([x[4] for x in b], abs=2e-6, nan_ok=True)


@pytest.fixture(scope="module")
def damaged(spark):
    """A warehouse with repeated and missing keys, orphans, nulls and broken rules."""
    s = warehouse.load(spark, SF)
    people = s.dim_customer.where("customer_id % 7 <> 0").unionByName(s.dim_customer.where("customer_id = 1"))
    people = people.withColumn("age", F.when(F.col("customer_id") % 5 == 0, 7).otherwise(F.col("age")))
    people = people.withColumn("gender", F.when(F.col("customer_id") % 3 > 0, F.col("gender")))
    nobody = lambda df, n: df.withColumn("customer_id", F.when(F.col("customer_id") % n > 0, F.col("customer_id")))
    return replace(
        s, dim_customer=people, dim_product=s.dim_product.where("product_id > 20"),
        fact_transactions=nobody(s.fact_transactions, 11).withColumn("amount", F.when(F.col("product_id") == 9, -F.col("amount")).otherwise(F.col("amount"))),
        fact_service_logs=nobody(s.fact_service_logs, 4).withColumn("csat_score", F.when(F.col("csat_score") != 2, F.col("csat_score"))),
        fact_campaign_responses=s.fact_campaign_responses.withColumn("was_opened", F.col("was_opened") & (F.col("customer_id") % 2 == 0)),
    )


SINGLE = (quality.dqv_tables_present, quality.dqv_row_minimum, quality.dqv_pk_unique, quality.dqv_nulls, quality.dqv_foreign_keys,
          quality.dqv_ranges, quality.dqv_funnel, quality.dqv_future_dates)


@pytest.mark.parametrize("kind", ["good", "damaged"])
def test_dq_suite_equals_single_checks(spark, damaged, kind):
    s = damaged if kind == "damaged" else warehouse.load(spark, SF)
    found = rows(quality.dq_suite(s))
    near(found, rows(quality.union([job(s) for job in SINGLE])))
    lost = {(f"fk_{key}", child): quality.orphan_count(s, child, key, parent).first()[0] for child, key, parent in quality.FOREIGN_KEYS}
    assert {(c, t): detail for c, t, kind, _, detail, _ in found if kind == "foreign_key"} == lost
    assert len(found) > 40
    if kind == "damaged":
        status = {(c, t): x for c, t, _, x, _, _ in found}
        assert status["pk_customer_id", "dim_customer"] == status["fk_customer_id", "fact_transactions"] == "FAIL"
        assert status["positive_amounts", "fact_transactions"] == status["funnel_logic", "fact_campaign_responses"] == "FAIL"


@pytest.mark.parametrize("kind", ["good", "damaged"])
def test_business_suite_equals_single_checks(spark, damaged, kind):
    s = damaged if kind == "damaged" else warehouse.load(spark, SF)
    if kind == "damaged":  # a customer that stands twice counts twice beside its facts
        s = replace(s, dim_customer=s.dim_customer.dropDuplicates(["customer_id"]))
    near(rows(business.business_suite(s)), rows(quality.union([job(s) for job in business.JOBS])))
    if kind == "damaged":
        status = {r["check"]: r["status"] for r in business.business_suite(s).collect()}
        assert status["reconcile_amount"] == status["revenue_total"] == status["star_schema"] == "FAIL"


def test_suites_read_each_table_once(spark):
    s = warehouse.load(spark, SF)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(quality.measured(s)) == len(schema.TABLES)
    assert scans(business.business_suite(s)) == len(schema.TABLES) + 4


def test_stored_warehouses(spark, tmp_path):
    s = warehouse.load(spark, SF)
    again = warehouse.open_warehouse(spark, s.folder)
    assert again.fact_transactions.count() == s.fact_transactions.count() and again.stored() == set(schema.TABLES)
    with pytest.raises(FileNotFoundError, match="dim_product"):
        files_only = {t: getattr(s, t) for t in schema.TABLES if t != "dim_product"}
        for t, df in files_only.items():
            df.limit(3).write.parquet(f"file://{tmp_path}/part/{t}")
        warehouse.open_warehouse(spark, f"file://{tmp_path}/part")
    lacking = replace(s, folder=f"file://{tmp_path}/part")
    status = {r["table"]: r["status"] for r in quality.dqv_tables_present(lacking).collect()}
    assert status.pop("dim_product") == "FAIL" and set(status.values()) == {"PASS"}
    spark.sql("CREATE DATABASE IF NOT EXISTS star_tests")
    for t in schema.TABLES:
        getattr(s, t).limit(5).write.mode("overwrite").saveAsTable(f"star_tests.{t}")
    inside = warehouse.open_catalog(spark, "star_tests")
    assert inside.dim_date.count() == 5 and inside.stored() == set(schema.TABLES)
    spark.sql("DROP TABLE star_tests.dim_date")
    assert "dim_date" not in inside.stored()
    with pytest.raises(FileNotFoundError):
        warehouse.open_catalog(spark, "star_tests")
    spark.sql("DROP DATABASE star_tests CASCADE")


def test_warehouse_from_raw_files(spark, tmp_path):
    one = {c: 1 for c in files.CUSTOMER_COLUMNS} | {
        "Gender": "M", "Attrition_Flag": "Existing Customer", "Income_Category": "$120K +", "Education_Level": "Unknown",
        "Marital_Status": "Single", "Card_Category": "Blue", "Months_on_book": 12,
    }
    spark.createDataFrame([one]).write.csv(f"{tmp_path}/raw", header=True)
    people = files.localise(files.read_customers(spark, f"{tmp_path}/raw"), "2024-12-31")
    sale = spark.sql("SELECT 1L AS transaction_id, 1L AS customer_id, 1L AS product_id, 20240105 AS date_key, TIMESTAMP '2024-01-05 10:00:00' AS transaction_date, 83.00 AS amount, 'Travel' AS merchant_category, true AS extra")
    tables = {"dim_customer": people, "dim_product": files.seed_products(spark), "dim_campaign": adapter.dim_campaign(spark),
              "dim_date": dim_date(spark, "2024-01-01", "2024-01-31"), "fact_transactions": sale}
    files.write_star(tables, f"file://{tmp_path}/star")
    s = warehouse.open_warehouse(spark, f"file://{tmp_path}/star", as_of="2024-12-31")
    assert s.fact_service_logs.count() == 0 and s.dim_product.count() == 12
    assert quality.dq_reconciliation(s).collect()[0]["within"] == 1
    assert rows(quality.dq_suite(s)) == rows(quality.union([job(s) for job in SINGLE]))
    with pytest.raises(ValueError, match="no_table"):
        files.write_star({"no_table": people}, f"file://{tmp_path}/none")


def test_percentiles_by_group(spark):
    data = [("a", float(v)) for v in (5, 1, 1, 9, 2)] + [(None, 4.0), (None, 8.0), ("b", None), ("c", 7.0), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    want = {r.g: r[1:] for r in df.groupBy("g").agg(*(F.percentile("v", p) for p in (0.1, 0.5, 0.75))).collect()}
    got = {r.g: r[1:] for r in percentiles(df, F.col("v"), {"x": 0.1, "y": 0.5, "z": 0.75}, "g").collect()}
    assert got == {g: tuple(v) for g, v in want.items()}
    assert percentiles(df.limit(0), F.col("v"), {"x": 0.5}).collect()[0].x is None
    many = spark.range(5000).select((F.col("id") * 7919 % 4999).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert percentiles(many, F.col("v"), {"x": 0.333}).collect()[0].x == many.agg(F.percentile("v", 0.333)).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_views_of_a_session_and_of_a_database(spark):
    from ledgerline.plans import views

    s = warehouse.load(spark, SF)
    names = views.create_views(s, "v_executive_kpis", "v_customer_360", "bi_customer_overview")
    assert names == sorted(names, key=list(views.view_jobs()).index) and len(names) == 3
    assert spark.sql("SELECT count(*) FROM v_customer_360").first()[0] == s.dim_customer.count()
    assert set(views.view_jobs()) >= {"v_campaign_funnel", "v_transaction_heatmap", "bi_transaction_timeline"}
    spark.sql("CREATE DATABASE IF NOT EXISTS view_tests")
    assert views.save_views(s, "view_tests", "v_campaign_funnel") == ["v_campaign_funnel"]
    assert spark.table("view_tests.v_campaign_funnel").count() == views.v_campaign_funnel(s).count()
    spark.sql("DROP DATABASE view_tests CASCADE")
    with pytest.raises(ValueError, match="v_none"):
        views.create_views(s, "v_none")
