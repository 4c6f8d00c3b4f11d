"""The corpus pipeline: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import packing, quality, secrets, simhash
from ledgerline.llm.common import materialise, read_table

REDACTED = "[SECRET]"


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, __row, so that none of them meets a column that a stage adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")


def _without_order(kind: T.DataType) -> bool:
    """Whether values of the type, or parts of them, cannot be sorted."""
    if isinstance(kind, T.ArrayType):
        return _without_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_without_order(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def in_order(docs: DataFrame, column: str) -> Column:
    """The column of __row to sort by; its JSON where the type has no order."""
    value = F.col(f"__row.`{column}`")
    return F.to_json(F.struct(value.alias("c"))) if _without_order(docs.schema[column].dataType) else value


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns as they were, whatever these are called. Null and
    empty texts go, as do all of under 50 words; rows that repeat are judged alike."""
    judged = quality.quality(docs.select("text", whole_row(docs)))
    return judged.where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, then fingerprint, then hash
    of the text. A document without id stays where no document of its group has an id. Of rows that repeat with id and
    text, the first by the other columns stays; maps, variants and intervals, which have no order, go by their JSON.
    """
    # A struct is never null, so a null id is an id like others in the join.
    key = F.struct("doc_id", F.xxhash64("text").alias("text")).alias("__key")
    marked = simhash.near_duplicates(docs.select("doc_id", "text", key), carried=("__key",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "__key")).alias("first")
    stay = marked.groupBy("root").agg(first).select("first.__key")
    others = [in_order(docs, c) for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__key").orderBy(*others, F.lit(0))
    return (
        docs.select(key, whole_row(docs))
        .join(stay, "__key", "left_semi")
        .withColumn("__n", F.row_number().over(order))
        .where("__n = 1")
        .select("__row.*")
    )


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by REDACTED and n_chars set anew where text changed.

    Other columns stay as they were, whatever these are called. A null text stays null; rows that repeat are redacted
    alike; an empty table gives an empty table.
    """
    numbered = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # so that no column meets the scan's own
    renamed = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in numbered.items()))
    found = secrets.with_spans(renamed, secrets.fit(docs), text_col=numbered["text"], redact=REDACTED)
    columns = {c: F.col(name) for c, name in numbered.items()}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.size("spans") > 0, F.char_length(numbered["text"])).otherwise(columns["n_chars"])
        columns["n_chars"] = n_chars.cast(kind)
    return found.select(*(column.alias(c) for c, column in columns.items()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their place in a training sequence; a null text has the
    end id alone, rows that repeat are packed once each, and columns other than doc_id and text are left out."""
    return packing.pack(packing.token_pieces(docs), "length")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash components, inferred grammars and tokenizer ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
