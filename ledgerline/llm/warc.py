"""WARC archives with an embedded Zstandard dictionary (operator 5).

Every archive is written by one task: a dictionary is trained on a bounded sample of the task's own records and put
in a leading skippable frame, then each record is compressed as a frame of its own. Pages with a payload that an
earlier page has become revisit records without payload. The archives go to a folder that all executors share; the
file names hold the task attempt, and only files of attempts that Spark has committed are listed, so a lost executor
or a second attempt leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read_table, scratch_path

# Fixed values of the format: magic numbers of the skippable frame that holds the dictionary and of a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Smaller payloads are always stored.
MIN_REVISIT_BYTES = 100
#: Sample that a dictionary is trained on, at most, and the dictionary's largest and least size.
SAMPLE_RECORDS = 512
SAMPLE_BYTES = 4 << 20
#: The least records that a dictionary is trained on, and how much of each one is, so that as many always fit.
LEAST_RECORDS = 8
LONGEST_BYTES = SAMPLE_BYTES // LEAST_RECORDS
DICTIONARY_BYTES, LEAST_BYTES = 64 << 10, 1 << 10
#: Lengths of the pieces that a dictionary is put together from; the shorter one serves small samples.
SEGMENTS = (256, 64)
LEVEL = 3
#: A task starts a new archive when one has so many bytes.
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 128 << 10
DATE = "2024-01-01T00:00:00Z"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to a revisit, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case; "" holds the version) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {"": version} | {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def train(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like those of sample; None if they are too few or too short for one."""
    if len(sample) < LEAST_RECORDS:
        return None
    size = max(LEAST_BYTES, min(DICTIONARY_BYTES, sum(map(len, sample)) // 8))
    while size >= LEAST_BYTES:  # records that repeat much fill small dictionaries only
        for segment in SEGMENTS:
            try:
                return zstandard.train_dictionary(size, sample, k=segment, d=8)
            except zstandard.ZstdError:
                continue
        size //= 4
    return None


class Archive:
    """A .warc.zst file that is being written; its name is told once it is whole."""

    def __init__(self, folder: str, name: str, dictionary: zstandard.ZstdCompressionDict | None):
        files, path = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.uri, self.out, self.size = f"{folder}/{name}", files.open_output_stream(f"{path}/{name}", compression=None), 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            content = dictionary.as_bytes()
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))

    def close(self) -> str:
        self.out.close()
        return self.uri


def records(uri: str) -> Iterator[bytes]:
    """The records of an archive, one at a time; frames end where the compressed stream says so."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as source:
        dictionary, held = None, source.read(8)
        if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_FRAME:
            content = source.read(struct.unpack("<I", held[4:])[0])
            if content[:4] != DICTIONARY_MAGIC:  # the format also allows a compressed dictionary
                content = zstandard.ZstdDecompressor().decompress(content)
            dictionary, held = zstandard.ZstdCompressionDict(content), b""
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        frame, parts = decompressor.decompressobj(), []
        while held or (held := source.read(READ_BYTES)):
            parts.append(frame.decompress(held))
            held = b""
            if frame.eof:
                yield b"".join(parts)
                held = frame.unused_data
                frame, parts = decompressor.decompressobj(), []
        if any(parts):
            raise ValueError(f"{uri} ends within a record")


def with_types(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null: the page is stored).

    Only payloads that several rows share are joined back, by digest; all other rows have join keys of their own,
    so that many empty pages do not meet in one task. The join splits the rows of a payload that is very common.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    marked = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", F.sha2(payload.cast("binary"), 256)
    )
    large = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    first = (
        marked.where(large)
        .groupBy("payload_digest")
        .agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(F.col("payload_digest").alias("__key"), "__first")
    )
    own = F.concat(F.lit("-"), F.xxhash64(id_col, "payload_digest").cast("string"))
    revisits: Column = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(id_col))
    return (
        marked.withColumn("__key", F.when(large, F.col("payload_digest")).otherwise(own))
        .join(first, "__key", "left")
        .withColumn("refers_to", F.when(revisits, F.col("__first")))
        .drop("__key", "__first")
    )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write a record for every row of pages to archives in folder; the archives' addresses, (archive, records).

    The payload is payload_col in UTF-8, a null is empty. Of rows with equal payloads of at least MIN_REVISIT_BYTES
    those with the smallest id are stored (response), the others are revisits of it; a row without id revisits a
    row that has one. A null url is replaced by a name. folder must be reachable by all executors through pyarrow's
    file systems. An empty table gives no archive.
    """
    typed = with_types(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    rows = typed.select(
        id_col, url_col, F.when(F.col("refers_to").isNull(), F.col(payload_col)).alias(payload_col),
        "payload_bytes", "payload_digest", "refers_to",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        stream = (
            record(page, url, (html or "").encode(), size, digest, first)
            for batch in batches
            for page, url, html, size, digest, first in zip(*((x.as_py() for x in c) for c in batch.columns))
        )
        sample, size = [], 0
        for data in stream:
            sample.append(data)
            size += min(len(data), LONGEST_BYTES)
            if len(sample) == SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                break
        if not sample:
            return
        dictionary = train([data[:LONGEST_BYTES] for data in sample])
        done, archive, n = [], None, 0

        def every() -> Iterator[bytes]:
            while sample:
                yield sample.pop(0)
            yield from stream

        for data in every():
            if archive is None:
                archive, n = Archive(folder, f"{name}-{len(done)}.warc.zst", dictionary), 0
            archive.add(data)
            n += 1
            if archive.size >= ARCHIVE_BYTES:
                done.append((archive.close(), n))
                archive = None
        if archive is not None:
            done.append((archive.close(), n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["archive", "records"]
        )

    return materialise(rows.mapInArrow(run, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for every record: id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are taken from the payload that is read and must equal its header; those of a
    revisit are in its header. One task reads one archive at a time, record by record.
    """
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for data in records(uri):
                    fields, payload = parse(data)
                    size, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].partition(":")[2]
                    if fields["warc-type"] == "response":
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{uri}: payload of {fields['warc-record-id']} is damaged")
                    page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                    rows.append((page and int(page), size, digest, fields["warc-type"], first and int(first)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    spark_kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(a, b) for a, b in zip(names, spark_kinds)])
    return archives.select("archive").repartition(max(1, n)).mapInArrow(run, schema)


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; see write_archives for nulls, empty payloads, ties and repeats."""
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN f.first_id IS DISTINCT FROM p.page_id AND p.payload_bytes >= {MIN_REVISIT_BYTES} THEN f.first_id END
         AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= {MIN_REVISIT_BYTES}
"""
