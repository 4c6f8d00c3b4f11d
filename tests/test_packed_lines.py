"""Order lines that are packed to move come out as they were."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import adapter

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(1998, 3, 29)
LINE = (7, 1, 5, False, DAY, Decimal("12.34"))
ODD = [
    LINE, (None, 1, 5, False, DAY, Decimal("1.00")), (7, None, 5, True, DAY, None), (7, 256, None, True, None, Decimal("0.00")),
    (7, 255, 2**62, True, DAY + dt.timedelta(hours=5), Decimal("10737418.23")), (7, -1, 5, False, DAY, Decimal("10737418.24")),
    (7, 255, -5, True, DAY, Decimal("10737418.23")), (7, 0, 5, False, dt.datetime(1969, 12, 31), Decimal("-0.01")),
    (7, 1, 5, True, dt.datetime(1970, 1, 1), Decimal("0.01")), (7, 1, 5, True, dt.datetime(2149, 6, 6), Decimal("9999999999999.99")),
    (7, 1, 5, True, dt.datetime(2149, 6, 7), Decimal("-9999999999999.99")),
]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_lines_come_out_as_they_were(spark, kind):
    rows = spark.createDataFrame(ODD, "l_orderkey long, l_linenumber int, l_partkey long, returned boolean, l_shipdate timestamp, amount decimal(15,2)")
    rows = rows.withColumn("l_shipdate", F.col("l_shipdate").cast(kind))
    moved = adapter.packed(rows)
    assert 0 < moved.where("__line is not null").count() < len(ODD)
    got = adapter.unpacked(moved)
    assert dict(got.dtypes) == dict(rows.dtypes)
    assert sorted(map(tuple, got.select(rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_lines_move_packed(spark):
    found = adapter.fact_transactions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = found[found.index("l_orderkey#", found.index("Join Inner, (l_orderkey")):]
    assert "__line" in join
    line = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("returned", F.col("l_returnflag") == "R")
    line = line.withColumn("amount", F.col("l_extendedprice").cast("decimal(15,2)"))
    assert adapter.packed(line).where("__line is null").isEmpty()
