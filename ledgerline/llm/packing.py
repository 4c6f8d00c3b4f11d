"""Best-fit packing of token sequences into fixed-size rows (operator 2).

Bulk-synchronous best fit. A piece of over half a sequence opens a sequence of its own; what is left of those are the
first gaps. A round range-sorts the unplaced pieces and the gaps by size, pieces before gaps. Every range is swept
upwards by one task: a gap takes the largest piece below it that is still free, so each piece gets its successor among
the gaps and each gap one piece. What a range leaves over is numbered in its order; the ranges' numbers of left pieces
and gaps settle which gaps of higher ranges take which pieces of lower ones, and these meet in a join by range and
rank. Then the gaps are updated, sequences are opened if the gaps' room is short of what is left, and the next round
starts. Wide gaps are swept as several, so that rounds stay few. Only numbers by range reach the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary, encoder
from .common import materialise, read_table

SEQUENCE_TOKENS = 1024
#: Id that ends a document.
END_ID = 2
#: A round that places a smaller share of the pieces opens sequences although there is room.
SLOW_ROUND = 0.05
#: Sequences are opened by at least this share of those that there are, so that the last rounds do not open them singly.
OPEN_SHARE = 0.0005
#: Pieces and gaps in a range, about: what one task holds.
RANGE_ROWS = 100_000


class Interval(NamedTuple):
    """Pieces of one length with ranks from first_rank on lie, `each` to a sequence, from sequence first_sequence
    on, beginning at `offset`."""

    length: int
    first_rank: int
    first_sequence: int
    each: int
    offset: int


def best_fit_rounds(counts: dict[int, int], capacity: int) -> tuple[list[Interval], int]:
    """Best fit of counts[length] pieces of every length, one after another on one machine: the intervals and the
    number of sequences. pack is measured against it.
    """
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> runs [first sequence, number]
    placed: list[Interval] = []
    sequences = 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        updated: dict[int, list[list[int]]] = defaultdict(list)

        def take(first: int, number: int, gap: int) -> None:
            """Fill up to number sequences from first on, which have gap tokens free."""
            nonlocal left, rank
            each = gap // length
            full = min(number, left // each)
            if full:
                placed.append(Interval(length, rank, first, each, capacity - gap))
                if gap - each * length:
                    updated[gap - each * length].append([first, full])
                rank, left = rank + full * each, left - full * each
            if left and full < number:  # fewer than one sequence takes are left
                placed.append(Interval(length, rank, first + full, left, capacity - gap))
                updated[gap - left * length].append([first + full, 1])
                rank, left, full = rank + left, 0, full + 1
            if full < number:
                updated[gap].append([first + full, number - full])

        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            for first, number in gaps.pop(gap):
                take(first, number, gap)
        if left:
            number = -(-left // (capacity // length))
            first, sequences = sequences, sequences + number
            take(first, number, capacity)
        for gap, runs in updated.items():
            gaps[gap].extend(runs)
    return placed, sequences


def swept(items: DataFrame, ranges: int | None = None) -> DataFrame:
    """What the sweep of each range of items (size, kind: 0 piece or 1 gap, id, used) finds, by size within a range.

    ranges: their number, else as the session deals; each is held by one task.

    found: 0 a piece and the gap that takes it (row, length, sequence_id, used), 1 a piece left, 2 a gap left. range
    and rank number what is left: pieces from the largest down, gaps from the smallest up. In a range all gaps left
    are smaller than all pieces left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        size, kind, id_, used = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        pieces, gaps, pairs = [], [], []
        for i, gap in enumerate(kind.tolist()):
            if not gap:
                pieces.append(i)
            elif pieces:
                pairs.append((pieces.pop(), i))
            else:
                gaps.append(i)
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        piece, gap = np.array(pieces[::-1], np.int64), np.array(gaps, np.int64)
        found = np.repeat(np.arange(3), [len(a), len(piece), len(gap)])
        rank = np.concatenate([np.zeros(len(a), np.int64), np.arange(len(piece)), np.arange(len(gap))])
        row, to = np.concatenate([a, piece, gap]), np.concatenate([b, piece, gap])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()), pa.array(id_[row]), pa.array(size[row]), pa.array(id_[to]), pa.array(used[to]),
                pa.array(np.full(len(found), TaskContext.get().partitionId()), pa.int32()), pa.array(rank),
            ],
            names=["found", "row", "length", "sequence_id", "used", "range", "rank"],
        )

    by = ("size", "kind", "id")
    schema = "found int, row long, length int, sequence_id long, used int, range int, rank long"
    dealt = items.select(*by, "used")
    dealt = dealt.repartitionByRange(*by) if ranges is None else dealt.repartitionByRange(ranges, *by)
    return dealt.sortWithinPartitions(*by).mapInArrow(run, schema)


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which gaps take the pieces that smaller ranges have left: (range of the pieces, first rank, rank after the last,
    range of the gaps, rank of the first gap less that of the first piece).

    left: (range, pieces, gaps) that each range has left. Each gap takes the nearest piece below that is free.
    """
    free: list[list[int]] = []  # range, pieces taken, pieces
    found = []
    for at, pieces, gaps in sorted(left):
        done = 0
        while done < gaps and free:
            of = free[-1]
            n = min(gaps - done, of[2] - of[1])
            found.append((of[0], of[1], of[1] + n, at, done - of[1]))
            of[1] += n
            done += n
            if of[1] == of[2]:
                free.pop()
        if pieces:
            free.append([at, 0, pieces])
    return found


def best_fit(pieces: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence_id, offset) of every row of pieces (row, length: at most half of capacity).

    gaps (sequence_id from 0 on, free) are the sequences there are; those that are opened get ids below 0.
    """
    spark = pieces.sparkSession
    done, opened = [], 0
    sequences = gaps.count()
    while True:
        n, smallest, largest, tokens = pieces.agg(
            F.count(F.lit(1)), F.min("length"), F.max("length"), F.sum("length")
        ).first()
        if not n:
            break
        gaps = gaps.where(F.col("free") >= smallest)
        room = gaps.agg(F.coalesce(F.sum("free"), F.lit(0))).first()[0]
        short = tokens if done and placed < SLOW_ROUND * (placed + n) else tokens - room
        if short > 0:
            more = max(-(-short // capacity), int(OPEN_SHARE * (sequences + opened)))
            new = spark.range(opened, opened + more).select((-1 - F.col("id")).alias("sequence_id"), F.lit(capacity).alias("free"))
            gaps, opened = gaps.unionByName(new), opened + more
        wide = F.greatest(F.lit(1), F.floor(F.col("free") / largest)).cast("int")
        slots = gaps.select("*", wide.alias("n")).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("slot")).select(
            F.when(F.col("slot") == 1, F.col("free") - (F.col("n") - 1) * largest).otherwise(F.lit(largest)).alias("size"),
            F.lit(1).alias("kind"), F.col("sequence_id").alias("id"), (capacity - F.col("free")).alias("used"),
        )
        items = pieces.select(
            F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("row").alias("id"), F.lit(0).alias("used")
        ).unionByName(slots)
        n_slots = slots.count()
        found = materialise(swept(items, -(-(n + n_slots) // RANGE_ROWS)), "swept")
        left = found.where("found > 0").groupBy("range").agg(F.count_if(F.col("found") == 1), F.count_if(F.col("found") == 2))
        carry = spark.createDataFrame(
            carried([tuple(r) for r in left.collect()]),  # a row for each range
            "of int, first long, end long, range int, shift long",
        )
        going = found.where("found = 1").select("row", "length", F.col("range").alias("of"), "rank").join(
            F.broadcast(carry), "of"  # at most two rows for each range
        ).where("rank >= first and rank < end").select("row", "length", "range", (F.col("rank") + F.col("shift")).alias("rank"))
        taking = found.where("found = 2").select("range", "rank", "sequence_id", "used")
        met = going.join(taking, ["range", "rank"]).select("row", "length", "sequence_id", "used")
        before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        both = found.where("found = 0").select("row", "length", "sequence_id", "used").unionByName(met)
        offset = (F.col("used") + F.coalesce(F.sum("length").over(before), F.lit(0))).cast("long")
        now = materialise(both.select("row", "length", "sequence_id", offset.alias("offset")), "placed")
        filled = now.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("filled"))
        gaps = materialise(
            gaps.join(filled, "sequence_id", "left")
            .select("sequence_id", (F.col("free") - F.coalesce("filled", F.lit(0))).alias("free"))
            .where("free > 0"),
            "gaps",
        )
        gone = carry.groupBy("of").agg(F.max("end").alias("end"))
        pieces = found.where("found = 1").join(F.broadcast(gone), F.col("range") == F.col("of"), "left").where(
            "rank >= coalesce(end, 0)"
        ).select("row", "length")
        placed = now.count()
        done.append(now.select("row", "sequence_id", "offset"))
    if not done:
        return pieces.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return reduce(DataFrame.unionByName, done)


def pack(
    pieces: DataFrame, length_col: str, key_cols: list[str] | None = None, capacity: int = SEQUENCE_TOKENS
) -> DataFrame:
    """pieces with sequence_id and offset: each lies whole in one sequence, gapless from offset 0.

    pieces is written once, with a number for each row, sorted by key_cols in each task. length_col must be 1 to
    capacity; a piece with any other length raises an error. Rows that repeat are placed once each, and nulls in any
    other column stay. Ties go by row number. An empty table gives an empty table. Columns of pieces named sequence_id
    or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    ordered = pieces.sortWithinPartitions(*key_cols) if key_cols else pieces
    rows = materialise(ordered.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    length = F.col(length_col)
    wrong = rows.where(length.isNull() | ~length.between(1, capacity) | (length != F.floor(length)))
    if not wrong.isEmpty():
        raise ValueError(f"{length_col} must be 1 to {capacity}")
    opens = 2 * length > capacity  # no two of these share a sequence
    zero = F.lit(0).cast("long").alias("offset")
    first = rows.where(opens).select(*pieces.columns, F.col("__row").alias("sequence_id"), zero)
    rest = rows.where(~opens)
    gaps = rows.where(opens & (length < capacity)).select(
        F.col("__row").alias("sequence_id"), (F.lit(capacity) - length).cast("int").alias("free")
    )
    found = best_fit(rest.select(F.col("__row").alias("row"), length.cast("int").alias("length")), gaps, capacity)
    placed = rest.join(found.withColumnRenamed("row", "__row"), "__row").select(*pieces.columns, "sequence_id", "offset")
    return first.unionByName(placed)


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 and, if asked for, ids (packed).

    A document is its text's ids and END_ID; a null text counts as empty and so has the one id. Only a document of
    over capacity ids is cut; all pieces but the first then have capacity ids. A null id stays null.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            docs_of = batch.column(id_col)
            owner, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [
                    docs_of.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, packed in enumerate(bpe.encode_array(batch.column(text_col))):
                packed += end
                n = len(packed) // 4
                cut = [0, *range((n % capacity) or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    part = packed[4 * a : 4 * b]
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                        size += len(part)
                if size > 8 << 20:
                    yield out()
                    owner, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0
            yield out()

    schema = T.StructType([
        docs.schema[id_col],
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places; see token_pieces and pack for nulls, empty and repeated rows."""
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), with_ids=False)
    return pack(pieces, "length")
