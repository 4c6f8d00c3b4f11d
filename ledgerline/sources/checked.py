"""Raw CSV lines, told apart into rows that can be typed and lines that cannot, in one pass over the files."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.storage import materialise

#: A quote within quotes is doubled.
QUOTE = '"'
CORRUPT, FILE, PROBLEMS = "__corrupt", "__file", "__problems"


class Checked(NamedTuple):
    """rows: the lines that have all types, typed. rejects: one row for each other line, with file, record (the line) and
    problems, an array of (column, value, reason). Every line that is no header is in one of the two."""

    rows: DataFrame
    rejects: DataFrame

    def warn(self, what: str) -> DataFrame:
        """rows; says how many lines are not among them."""
        n = self.rejects.count()
        if n:
            warnings.warn(f"{n} lines of {what} were rejected", stacklevel=3)
        return self.rows


def _problem(column: str | None, value: Column, reason: str) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"), value.alias("value"), F.lit(reason).alias("reason"))


def check(spark: SparkSession, path: str, columns: dict[str, str], required: tuple[str, ...] = (), dropped: tuple[str, ...] = ()) -> Checked:
    """The CSV files at path, whose header names all of columns (name to type), else an error.

    A line is rejected if it has too few or too many fields, if a value is not of its column's type, or if a required
    column is empty. Empty values of other columns are null. Columns whose names hold a word of dropped are left out; other
    extra columns stay, as text. The parsed lines are written to the shared folder once, and both results read from there.
    """
    header = spark.read.csv(path, header=True, escape=QUOTE).columns
    missing = sorted(set(columns) - set(header))
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    kind = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
    raw = spark.read.schema(kind).csv(path, header=True, escape=QUOTE, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    text = {c: F.col(f"`{c}`") for c in header}
    wrong = [
        F.when(text[c].isNotNull() & text[c].try_cast(t).isNull(), _problem(c, text[c], f"no {t}")) for c, t in columns.items() if t != "string"
    ]
    wrong += [F.when(text[c].isNull(), _problem(c, F.lit(None).cast("string"), "empty")) for c in required]
    torn = F.array(_problem(None, F.lit(None).cast("string"), "too few or too many fields"))
    found = F.when(F.col(CORRUPT).isNotNull(), torn).otherwise(F.filter(F.array(*wrong), lambda p: p.isNotNull()))
    lines = materialise(raw.select("*", F.col("_metadata.file_path").alias(FILE), found.alias(PROBLEMS)), "lines")
    kept = [c for c in header if not any(word in c for word in dropped)]
    rows = lines.where(F.size(PROBLEMS) == 0).select(*((text[c].cast(columns[c]) if c in columns else text[c]).alias(c) for c in kept))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*text.values()), {"escape": QUOTE}))
    rejects = lines.where(F.size(PROBLEMS) > 0).select(F.col(FILE).alias("file"), record.alias("record"), F.col(PROBLEMS).alias("problems"))
    return Checked(rows, rejects)


def problem_counts(rejects: DataFrame) -> DataFrame:
    """file, column, reason, lines: how often each problem stands in each file."""
    each = rejects.select("file", F.explode("problems").alias("p"))
    return each.groupBy("file", "p.column", "p.reason").agg(F.count(F.lit(1)).alias("lines"))
