"""BPE encoding and decoding as distributed jobs (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary, encoder
from .common import read_table

#: Rows leave a task in batches of about this many bytes.
OUT_BYTES = 8 << 20
#: Rows that a round trip works on at once.
SLICE_ROWS = 256


def with_column(batch: pa.RecordBatch, drop: str, name: str, values: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """batch without column drop and with values as its last column, cut into batches of bounded size."""
    keep = [i for i, n in enumerate(batch.schema.names) if n != drop]
    begin = size = 0
    for i, value in enumerate([*values, None]):
        if i == len(values) or (size > OUT_BYTES and i > begin):
            part = batch.slice(begin, i - begin)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(values[begin:i], kind)],
                names=[*(batch.schema.names[k] for k in keep), name],
            )
            begin, size = i, 0
        size += len(value or b"")


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Replace text_col by ids_col: binary, each id as a little-endian unsigned 32-bit integer.

    The ids are those of the tokenizers library without added special tokens, truncation or padding. A null or
    empty text gives no ids (empty binary). Texts of any length are encoded whole. Other columns stay, repeated
    rows stay, an empty table gives an empty table. No shuffle; one pass.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            values = list(bpe.encode_array(batch.column(text_col)))
            yield from with_column(batch, text_col, ids_col, values, pa.binary())

    schema = T.StructType([*(f for f in docs.schema if f.name != text_col), T.StructField(ids_col, T.BinaryType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Replace ids_col by text_col, the text that the ids stand for; special tokens stay. Null ids: empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            values = [bpe.decode(x or b"") for x in batch.column(ids_col).to_pylist()]
            yield from with_column(batch, ids_col, text_col, values, pa.string())

    schema = T.StructType([*(f for f in encoded.schema if f.name != ids_col), T.StructField(text_col, T.StringType())])
    return encoded.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", vocabulary: str | None = None
) -> DataFrame:
    """docs without text_col and with ids_col as of encode and decoded_col as of decode, in one pass, so that a task
    has one Python worker. Defined as these two are."""
    path = vocabulary or default_vocabulary()
    kept = [f for f in docs.schema if f.name not in (text_col, ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for i in range(0, max(1, whole.num_rows), SLICE_ROWS):
                batch = whole.slice(i, SLICE_ROWS)
                ids = list(bpe.encode_array(batch[text_col]))
                new = [pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[f.name] for f in kept), *new], names=[*(f.name for f in kept), ids_col, decoded_col]
                )

    new = [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*kept, *new]))


def op7_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests; see encode and decode for nulls, empty texts and repeats."""
    return round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
