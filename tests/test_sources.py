"""Raw files with malformed lines, loads that fail half way, and tables behind JDBC."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import checked, files, jdbc

HEADER = "trans_date_trans_time,category,amt,merchant,note"
LINES = [
    "2024-01-01 10:00:00,travel,5.0,m,", "2024-01-01 10:00:00,travel,oops,m,x", "not a time,travel,1e9999x,m,x", "2024-01-01 10:00:00,travel",
    "2024-01-01 10:00:00,travel,1,m,x,one,too,many", ",travel,5.0,m,x", "2024-01-01 10:00:00,,5.0,,x", "2024-02-30 10:00:00,travel,5,m,x",
    '2024-01-01 10:00:00,"a,b",7.5,"say ""x""",', "2024-01-01 10:00:00,travel, ,m,x",
]


def write(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return f"file://{path}"


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    one, two = write(tmp_path / "a.csv", LINES), write(tmp_path / "b.csv", LINES[:2])
    found = files.check_transactions(spark, [one, two, f"{tmp_path}/none.csv"])
    rows, rejects = found.rows.collect(), found.rejects.collect()
    assert len(rows) + len(rejects) == len(LINES) + 2
    assert sorted(r.amt for r in rows) == [5.0, 5.0, 5.0, 7.5] and {r.merchant for r in rows} == {"m", None, 'say "x"'}
    problems = {(r.file.rsplit("/", 1)[1], p.column, p.value, p.reason) for r in rejects for p in r.problems}
    assert problems == {
        ("a.csv", "amt", "oops", "no double"), ("b.csv", "amt", "oops", "no double"), ("a.csv", "amt", "1e9999x", "no double"),
        ("a.csv", "trans_date_trans_time", "not a time", "no timestamp"), ("a.csv", None, None, "too few or too many fields"),
        ("a.csv", "trans_date_trans_time", None, "empty"), ("a.csv", "trans_date_trans_time", "2024-02-30 10:00:00", "no timestamp"),
        ("a.csv", "amt", " ", "no double"),
    }
    assert LINES[3] in {r.record for r in rejects} and LINES[4] in {r.record for r in rejects}
    torn = [r.lines for r in checked.problem_counts(found.rejects).where("column is null").collect()]
    assert torn == [2]
    files.write_rejects(found.rejects, f"{tmp_path}/rejects")
    files.write_rejects(found.rejects, f"{tmp_path}/rejects")
    assert spark.read.json(f"{tmp_path}/rejects").count() == 2 * len(rejects)
    with pytest.warns(UserWarning, match="8 lines"):
        assert files.read_transactions(spark, [one, two]).count() == 4


def test_malformed_customers(spark, tmp_path):
    names = [*files.CUSTOMER_COLUMNS, "Naive_Bayes_1", "extra"]
    good = dict.fromkeys(names, "1") | {"Gender": "F", "Credit_Limit": "12.5"}
    bad = [good | {"CLIENTNUM": ""}, good | {"CLIENTNUM": "99999999999999999999"}, good | {"Customer_Age": "4x", "Credit_Limit": "?"}]
    path = write(tmp_path / "c.csv", [",".join(r.values()) for r in (good, *bad, good)], ",".join(names))
    found = files.check_customers(spark, path)
    assert found.rows.count() == 2 and found.rows.columns == [*files.CUSTOMER_COLUMNS, "extra"]
    assert found.rows.schema["Credit_Limit"].dataType.typeName() == "double"
    assert sorted(len(r.problems) for r in found.rejects.collect()) == [1, 1, 2]
    assert files.localise(found.rows, "2024-12-31").count() == 2
    empty = files.check_customers(spark, write(tmp_path / "e.csv", [], ",".join(names)))
    assert empty.rows.count() == empty.rejects.count() == 0


def test_load_table_replaces_whole_or_not_at_all(spark, monkeypatch):
    name = f"t_{uuid.uuid4().hex}"
    assert files.load_table(spark.range(5).withColumn("x", F.lit(1)), name, surrogate="id") == 5
    assert spark.table(name).columns == ["x"]
    assert files.load_table(spark.table(name).union(spark.table(name)), name) == 10  # from itself
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("int").alias("x"))
    with pytest.raises(Exception, match="half way"):
        files.load_table(broken, name)
    assert spark.table(name).count() == 10
    real = spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: 1 / 0 if q.endswith(f"RENAME TO {name}") and "__before" not in q else real(q, *a, **k))
    with pytest.raises(ZeroDivisionError):
        files.load_table(spark.range(3), name)
    monkeypatch.undo()
    assert spark.table(name).count() == 10
    real(f"ALTER TABLE {name} RENAME TO {name}__before")  # as if the exchange had been cut off
    assert files.load_table(spark.range(2), name) == 2
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith(name)]
    assert left == [name]


@pytest.fixture(scope="module")
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_jdbc_scan_by_ranges(spark, url):
    rows = spark.range(1000).select(
        (F.col("id") * F.col("id")).alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    ).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'none' AS v, CAST(NULL AS DATE) AS d"))
    rows.write.jdbc(url, "things")
    for key in ("k", "d"):
        got = jdbc.scan(spark, url, "things", key=key, partition_rows=200)
        assert got.rdd.getNumPartitions() == 6 and got.exceptAll(rows).isEmpty() and got.count() == 1001
    filtered = jdbc.scan(spark, url, "things", key="k", partition_rows=200).where("k >= 640000").select("v")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,640000)" in plan and "ReadSchema: struct<v:string>" in plan
    assert filtered.count() == 200
    some = jdbc.scan(spark, url, 'SELECT * FROM things WHERE "v" LIKE \'v1%\'', key="k", partition_rows=50)
    assert some.count() == 111 and some.rdd.getNumPartitions() == 3
    assert jdbc.scan(spark, url, "things").rdd.getNumPartitions() == 1
    none = jdbc.scan(spark, url, 'SELECT * FROM things WHERE "k" < 0', key="k")
    assert none.count() == 0 and none.rdd.getNumPartitions() == 1


def test_jdbc_load_is_seen_whole_or_not_at_all(spark, url):
    df = spark.range(12000).select("id", (F.col("id") % 7).alias("x"))
    assert jdbc.load(df, url, "facts", surrogate="id") == 12000
    there = jdbc.scan(spark, url, "facts")
    assert there.columns == ["x"]
    assert jdbc.load(there.where("x = 3"), url, "facts") == jdbc.scan(spark, url, "facts").where("x = 3").count() == 1714
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("x"))
    with pytest.raises(Exception, match="half way"):
        jdbc.load(broken, url, "facts")
    assert jdbc.count(spark, url, "facts") == 1714
    with pytest.raises(ValueError, match="lacks columns: y"):
        jdbc.load(spark.range(3).select(F.col("id").alias("y")), url, "facts")
    assert jdbc.count(spark, url, "facts") == 1714
    assert jdbc.load(spark.range(3).select(F.col("id").alias("x")), url, "facts") == 3
