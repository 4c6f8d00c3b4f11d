"""Tables in a database behind JDBC: scans by ranges of a key, and loads that are seen whole or not at all."""

from __future__ import annotations

import contextlib
import datetime
import math
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows in a partition of a scan, about; rows in one insert.
PARTITION_ROWS = 500_000
BATCH_ROWS = 5000
MAX_PARTITIONS = 1024


def _relation(table_or_query: str) -> str:
    """A table's name, or a query as a derived table."""
    is_query = table_or_query.lstrip().lower().startswith(("select ", "with ", "select\n", "with\n"))
    return f"({table_or_query}) scanned" if is_query else table_or_query


def _bound(value: object, up: bool) -> str:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return str(math.ceil(value) if up else math.floor(value)) if isinstance(value, (int, float, Decimal)) else str(value)


def scan(
    spark: SparkSession,
    url: str,
    table_or_query: str,
    key: str | None = None,
    partition_rows: int = PARTITION_ROWS,
    properties: dict[str, str] | None = None,
    quote: str = '"',
) -> DataFrame:
    """The rows of a table or query, read in ranges of key (a number, date or timestamp), each over a connection of its
    own. The bounds and the number of ranges come from one small query: the key's least and greatest value and the rows.

    Filters and columns of what is built on top go to the database. Rows with a null key are read with the first range. No
    row, an all-null key or no key gives one partition.
    """
    relation = _relation(table_or_query)
    reader = spark.read.format("jdbc").options(**properties or {}).option("url", url)
    if key is None:
        return reader.option("dbtable", relation).load()
    column = f"{quote}{key}{quote}"
    asked = f"SELECT MIN({column}) AS {quote}low{quote}, MAX({column}) AS {quote}high{quote}, COUNT(*) AS {quote}n{quote} FROM {relation}"
    low, high, n = spark.read.format("jdbc").options(**properties or {}).option("url", url).option("query", asked).load().first()
    ranges = min(MAX_PARTITIONS, -(-int(n) // partition_rows))
    reader = reader.option("dbtable", relation)
    if low is None or ranges < 2 or low == high:
        return reader.load()
    bounds = {"partitionColumn": key, "lowerBound": _bound(low, False), "upperBound": _bound(high, True), "numPartitions": ranges}
    return reader.options(**bounds).load()


def count(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> int:
    reader = spark.read.format("jdbc").options(**properties or {}).option("url", url)
    return int(reader.option("query", f"SELECT COUNT(*) AS n FROM {table}").load().first()[0])


def _in_one_transaction(spark: SparkSession, url: str, statements: list[str], properties: dict[str, str] | None) -> None:
    settings = spark._jvm.java.util.Properties()
    for name, value in (properties or {}).items():
        settings.setProperty(name, value)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        try:
            for statement in statements:
                connection.createStatement().executeUpdate(statement)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def load(
    df: DataFrame,
    url: str,
    table: str,
    surrogate: str | None = None,
    batch_rows: int = BATCH_ROWS,
    properties: dict[str, str] | None = None,
    quote: str = '"',
) -> int:
    """Replace the rows of a table by df; the number of rows in it afterwards.

    surrogate: a key column that the database numbers itself, left out. The rows go in batches to a new table beside;
    where its count is what was written, one transaction empties the table and takes them over. Until then, and if
    anything fails, the old rows stay; df may read the table itself. The table keeps its definition; it is made from df's
    columns if there is none.
    """
    spark, beside = df.sparkSession, f"{table}_{uuid.uuid4().hex[:8]}"
    rows = df.drop(surrogate) if surrogate else df
    target = {"url": url, "dbtable": table}
    rows.limit(0).write.format("jdbc").options(**properties or {}).options(**target).mode("ignore").save()
    there = {c.lower(): c for c in spark.read.format("jdbc").options(**properties or {}).options(**target).load().columns}
    unknown = [c for c in rows.columns if c.lower() not in there]
    if unknown:
        raise ValueError(f"{table} lacks columns: {', '.join(unknown)}")
    into = ", ".join(f"{quote}{there[c.lower()]}{quote}" for c in rows.columns)
    taken = ", ".join(f"{quote}{c}{quote}" for c in rows.columns)
    written = Observation()
    writer = rows.observe(written, F.count(F.lit(1)).alias("n")).write.format("jdbc").options(**properties or {})
    try:
        writer.options(url=url, dbtable=beside, batchsize=str(batch_rows)).save()
        n = count(spark, url, beside, properties)
        if n != written.get["n"]:
            raise RuntimeError(f"{beside} has {n} rows of {written.get['n']}; {table} was left as it was")
        _in_one_transaction(spark, url, [f"DELETE FROM {table}", f"INSERT INTO {table} ({into}) SELECT {taken} FROM {beside}"], properties)
    except Exception:
        with contextlib.suppress(Exception):  # it may not be there yet; the first error is what counts
            _in_one_transaction(spark, url, [f"DROP TABLE {beside}"], properties)
        raise
    _in_one_transaction(spark, url, [f"DROP TABLE {beside}"], properties)
    return n
