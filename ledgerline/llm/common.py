"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the session names none, a temporary folder is set on one machine (tests); on a cluster, whose executors would
    not see it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, block_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so that a lost
    executor costs its own tasks only, and no branch of the plan computes df twice.

    block_bytes: what a task holds of a file before it writes it out, else the writer's own size."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    writer = df.write if block_bytes is None else df.write.option("parquet.block.size", block_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(n: int, *cols: str | Column) -> Column:
    """A number from 0 to n - 1 that depends on the row's values alone, so recomputed rows get the same."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]
