"""Spelling variants grouped through an index of variable-length grams (operator 13).

Words stand between a start and an end mark. A gram begins at every place of a word and grows until it is rare, so common
grams are long and rare ones short; the dictionary of the frequent grams, pruned by count to a bounded size, says how far.
One edit can only touch the grams that cover its place: their greatest number in a word is the word's affected-gram
bound B. Of the grams in an order that all words share, rarest first, two near words must then have one in common among
the first B + 1 of each, at most one place apart. The posting lists of these grams are merged and every pair that comes
up is verified.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Lengths of grams, marks counted. A word of LEAST_LENGTH has a gram more than one edit can touch while the longest are
#: no longer than the shortest word.
LEAST_GRAM, LONGEST_GRAM = 2, 6
#: A gram is frequent from so many places on; more where over DICTIONARY grams would be.
FREQUENT = 16
DICTIONARY = 100_000
START, END = "^", "$"
#: A word takes part from so many code points and so many occurrences on, and has a form that is so many times its n.
LEAST_LENGTH, LEAST_N, FORM_TIMES = 6, 5, 5
#: One occurrence in so many, by its hash, loses a code point.
DAMAGED = 199
#: Grams that a task counts before it hands them on.
HELD_GRAMS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: one row for each run of letters of at least LEAST_LENGTH code points, A-Z lower-cased, damaged by hash.

    A null text has none; a null id counts as an empty one. Shorter runs cannot become words and are left out at once.
    """
    run = F.explode(F.regexp_extract_all(text_col, F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0)))
    runs = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), run.alias("run"))
    low = runs.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    h = F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run"), "UTF-8"))
    hashed = low.select("run", h.alias("h"))
    gone = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.char_length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of each gram, summed up over batches as far as HELD_GRAMS lets."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])
        held.clear()
        return batch

    for batch in batches:
        for word in batch["word"].to_pylist():
            marked = START + word + END
            for q in range(LEAST_GRAM, LONGEST_GRAM):
                held.update(marked[p : p + q] for p in range(len(marked) - q + 1))
            if len(held) >= HELD_GRAMS:
                yield out()
    if held:
        yield out()


def dictionary(words: DataFrame) -> dict[str, int]:
    """The frequent grams with their counts, at most DICTIONARY of them.

    Only lengths that can still grow are looked at. A gram's beginnings are at least as frequent as the gram, so what
    is left after pruning by count holds all beginnings of its grams. The threshold comes from a histogram of counts.
    """
    counts = words.select("word").mapInArrow(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = materialise(counts.where(F.col("n") > FREQUENT), "grams")
    bucket = F.floor(F.log2("n") * 8).alias("bucket")
    left, least = DICTIONARY, FREQUENT
    for b, n in sorted(((r["bucket"], r["n"]) for r in frequent.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            least = max(least, math.ceil(2 ** ((b + 1) / 8)) - 1)
            break
    return {r["gram"]: r["n"] for r in frequent.where(F.col("n") > least).collect()}


def variable_grams(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram at each place of a word, and the most of them that cover one place of the word."""
    marked = START + word + END
    n, grams, cover = len(marked), [], [0] * (len(marked) + 1)
    for p in range(n - LEAST_GRAM + 1):
        q = LEAST_GRAM
        while q < LONGEST_GRAM and p + q < n and marked[p : p + q] in frequent:
            q += 1
        grams.append(marked[p : p + q])
        cover[p] += 1
        cover[p + q] -= 1
    most = now = 0
    for place, change in enumerate(cover[: n - 1]):
        now += change
        most = max(most, now) if place else most
    return grams, most


def rare_grams(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """(gram, place) of the word's grams that its affected-gram bound asks for: B + 1, rarest first."""
    grams, bound = variable_grams(word, frequent)
    order = sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), zlib.crc32(grams[p].encode()), grams[p], p))
    return [(grams[p], p) for p in order[: bound + 1]]


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: all pairs of words (word, n) that differ by exactly one inserted, deleted or replaced code point,
    each once, with a < b. Words are distinct and have at least LEAST_LENGTH code points."""
    frequent = words.sparkSession.sparkContext.broadcast(dictionary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rare_grams(word, frequent.value) for word in batch["word"].to_pylist()]
            rows = pa.array([i for i, grams in enumerate(found) for _ in grams], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["word"].take(rows), batch["n"].take(rows),
                    pa.array([g for grams in found for g, _ in grams], pa.string()),
                    pa.array([p for grams in found for _, p in grams], pa.int32()),
                ],
                names=["word", "n", "gram", "place"],
            )

    lists = materialise(words.select("word", "n").mapInArrow(run, "word string, n long, gram string, place int"), "postings")
    places = F.explode(F.array(*(F.col("place") + d for d in (-1, 0, 1)))).alias("place")
    a = lists.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "gram", places)
    b = lists.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "gram", "place")
    alike = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    pairs = a.join(b, ["gram", "place"]).where(alike & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root: where following forms (word, form) ends, by pointer jumping. Each form's n is FORM_TIMES its word's
    n or more, so no chain is longer than the logarithm of the greatest n, most."""
    now = forms.select("word", F.col("form").alias("root"))
    longest = max(1, int(math.log(max(most, 1), FORM_TIMES)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        now = materialise(now, "roots")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def group_variants(occurring: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words (one row an occurrence) with at least LEAST_N occurrences.

    A word's form is its near word with the largest n, the smaller in code-point order among equals, if that is at least
    FORM_TIMES the word's own n, else null; root is the last of the forms that follow, the word itself if there is none.
    Null and shorter words take no part; an empty table gives an empty table.
    """
    long_enough = occurring.where(F.char_length("word") >= LEAST_LENGTH)
    words = materialise(long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_N), "words")
    pairs = materialise(near_words(words), "near")
    ends = ("word", "n", "near", "near_n")
    both = pairs.toDF(*ends).unionByName(pairs.select("b", "b_n", "a", "a_n").toDF(*ends))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    follows = -F.col("best.n") >= FORM_TIMES * F.col("n")
    form, form_n = F.when(follows, F.col("best.word")), F.when(follows, -F.col("best.n"))
    near = materialise(near.select("word", "n_near", form.alias("form"), form_n.alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    return (
        words.join(near, "word", "left")
        .join(roots(near.where("form is not null"), most), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )


def op13_variable_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents; see occurrences for nulls and group_variants for ties."""
    return group_variants(occurrences(read_table(spark, sf_dir, "documents")))
